"""Patches against a plain reader that goes through their lines with a state."""

import random
import re

from pyspark.sql import functions as F

from riskweave.functions import mining
from riskweave.sources import patches as P


class Reader:
    """One file of a patch, line by line."""

    def __init__(self, script):
        self.script, self.name, self.level, self.depth = script, None, None, 0

    def define(self, text):
        m = re.match(P.PYTHON_DEF, text)
        return m and m[1]

    def python(self, text):
        indent, bare, kind = len(text) - len(text.lstrip(" ")), text.strip(), re.match(P.PYTHON_CLASS, text)
        if kind:
            self.name, self.level = kind[1], indent
        elif self.name and bare and bare[0] not in "@#" and indent <= self.level and not self.define(text):
            self.name = None
        got = self.define(text)
        return got and (f"{self.name}.{got}" if self.name and indent > self.level else got)

    def javascript(self, text, head):
        step, kind = text.count("{") - text.count("}"), re.match(P.JS_CLASS, text)
        if head:
            self.name, self.level = (kind[1], max(1, step)) if kind else (None, None)
            return None
        if kind:
            self.name, self.level = kind[1], self.depth + step
        got = re.match(P.JS_FUNCTION, text) or re.match(P.JS_VARIABLE, text)
        symbol = got[1] if got else None
        if not got and self.name and (got := re.match(P.JS_METHOD, text)):
            symbol = f"{self.name}.{got[1]}"
        self.depth += step
        if self.name and self.depth < self.level:
            self.name = None
        return symbol


def brute(patch, script):
    out, reader, file = [], None, ""
    for line in patch.splitlines():
        if line.startswith("diff --git "):
            file = ""
        elif line.startswith("+++ "):
            file = line[4:].strip().removeprefix("b/")
            reader = Reader(script)
        elif file and line.startswith("@@"):
            text = line.split("@@", 2)[-1].strip()
            got = reader.javascript(text, True) if script else reader.python(text)
            out += [(got, file, P.CONTEXT)] if got else []
        elif file and line[:1] in "+- " and line and not line.startswith(("+++", "---")):
            got = reader.javascript(line[1:], False) if script else reader.python(line[1:])
            out += [(got, file, P.CHANGED)] if got and line[0] != " " else []
    return out


PY = ["class {n}:", "class {n}(x):", "def {n}(a):", "    def {n}(self):", "        def {n}(self):", "    x = 1", "y = 2", "", "# c", "@deco", "    class {n}:", "async def {n}(a):"]
JS = ["class {n} {{", "export default class {n} extends b {{", "  {n}(a) {{", "  async {n}(a, b) {{", "}}", "  }}", "x = {{", "function {n}(a) {{", "const {n} = async (a) => b", "let {n} = function (", "return 1;", "if (a) {{ b }}", ""]


def patch(r, script):
    lines = []
    for f in range(r.randint(1, 3)):
        name = r.choice(["src/a/m{}.py", "tests/t{}.py", "pkg/core{}.py"] if not script else ["src/u{}.js", "lib/index{}.ts", "docs/d{}.js"]).format(f)
        lines += [f"diff --git a/{name} b/{name}", "index 1..2", f"--- a/{name}", f"+++ b/{name}"] if r.random() < 0.9 else [f"+++ b/{name}\t"]
        for _ in range(r.randint(0, 3)):
            shape = r.choice(JS if script else PY)
            lines.append(f"@@ -{r.randint(1, 90)},3 +{r.randint(1, 90)},4 @@ " + shape.format(n=f"h_{r.randint(0, 9)}"))
            for _ in range(r.randint(0, 8)):
                lines.append(r.choice("+- ") + r.choice(JS if script else PY).format(n=f"n_{r.randint(0, 30)}"))
            if r.random() < 0.2:
                lines.append(r.choice(["\\ No newline at end of file", "", "--- x", "+++", "-- "]))
    return r.choice(["\n", "\r\n"]).join(lines)


def test_symbols_against_a_reader(spark):
    r = random.Random(5)
    rows = [(i, ["pypi", " NPM "][i % 2], "pack", patch(r, i % 2)) for i in range(300)]
    rows += [(1000, "pypi", "p", None), (1001, "pypi", "p", ""), (1002, "cargo", "p", rows[0][3]), (1003, None, None, rows[0][3])]
    df = spark.createDataFrame(rows, "id long, ecosystem string, package string, patch string")
    files = spark.createDataFrame([(f, s) for f, s in {(f, s) for i, _, _, t in rows[:300] for _, f, _ in brute(t, i % 2) for s in (0, 1)}], "file string, script int")
    module = F.when(F.col("script") == 0, F.array(mining.python_module(F.col("file")))).otherwise(mining.npm_modules(F.col("file"), F.lit("pack")))
    known = {(x.file, x.script): (x.skip, [m for m in x.modules if m] or [None]) for x in files.select("file", "script", mining.skipped_in_patches(F.col("file")).alias("skip"), module.alias("modules")).collect()}
    want = {}
    for i, _, _, text in rows[:300]:
        found = {}
        for symbol, file, source in brute(text, i % 2):
            skip, modules = known[(file, i % 2)]
            for m in [] if skip else modules:
                found.setdefault((symbol, m), set()).add(source)
        if any(P.CHANGED in s for s in found.values()):
            found = {k: s for k, s in found.items() if P.CHANGED in s}
        else:
            found = {k: s for k, s in found.items() if k[1] or "." in k[0]}
        want |= {(i, *k): sorted(s) for k, s in found.items()}
    got = {(x.id, x.symbol, x.import_path): x.sources for x in P.patch_symbols(df).collect()}
    assert got == want and len(want) > 300
    few = P.patch_symbols(df, limit=1).groupBy("id").count().collect()
    assert len(few) == len({k[0] for k in want}) and all(x["count"] == 1 for x in few)


def test_lines_of_rows_with_one_id(spark):
    text = "+++ b/a.py\n@@ -5 +7,2 @@ def f():\n x\n-y\n+z\n+w\n@@ odd\n v\n"
    df = spark.createDataFrame([(1, text), (1, text), (2, " no file\n+x")], "id int, patch string")
    rows = P.diff_lines(df).orderBy("row", "at").collect()
    assert len(rows) == 14 and all(x.file == "a.py" for x in rows)
    assert [(x.mark, x.content, x.hunk, x.old_line, x.new_line) for x in rows[:7]] == [("@", "def f():", 1, None, None), (" ", "x", 1, 5, 7), ("-", "y", 1, 6, None), ("+", "z", 1, None, 8), ("+", "w", 1, None, 9), ("@", "", 2, None, None), (" ", "v", 2, None, None)]
