"""Symbols, imports, calls and routes of source files, and the parts of Android manifests.

Python is parsed by its own grammar; other languages by the patterns of their declarations in code
without strings and comments, and by the brackets, or words, that end what is declared. One Arrow pass yields facts of all kinds:
(path, kind, name, detail, owner, line, end_line)."""

from __future__ import annotations

import ast
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scopes

SCHEMA = "path string, kind string, name string, detail string, owner string, line int, end_line int"
HTTP = "get post put delete patch"

# Words that mark what a symbol has to do with security.
TAGS = {
    "auth": "authenticate|authorize|login|logout|session|jwt|oauth|rbac",
    "crypto": "encrypt|decrypt|hash|sign|verify|hmac|aes|rsa|sha",
    "db_access": "query|execute|cursor|select|insert|update|delete|orm|model",
    "file_io": "open|read|write|upload|download|file|stream|path",
    "command_exec": "exec|spawn|system|popen|subprocess|shell|cmd",
    "deserialization": "deseriali[sz]e|unmarshal|unpickle|loads|parse|fromjson",
    "network": "http|request|fetch|socket|connect|url|endpoint",
    "template": "render|template|jinja|mustache|ejs|handlebars",
    "input_handling": r"request\.|req\.|params|body|query|form|input|args",
}
# Words before a parenthesis that are no calls.
NO_CALLS = frozenset("if for while switch catch return function new typeof sizeof await yield super this def class import print len range str int float list dict set tuple isinstance elif else try except with lambda not and or in is".split())

# Patterns of imports, declarations and routes of each language.
_js = {"import": r"import\s+(?:([\w*{}\s,$]+?)\s+from\s+)?['\"]([^'\"]+)['\"]|(?:(?:const|let|var)\s+([\w{}\s,$]+?)\s*=\s*)?require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", "class": r"\bclass\s+(\w+)", "function": r"\bfunction\s*\*?\s*(\w+)\s*\(|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>", "route": r"\b(?:app|router|server)\.\s*(get|post|put|delete|patch|use)\s*\(\s*['\"]([^'\"]+)['\"]"}
_java = {"import": r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;?", "class": r"\b(?:class|interface|object)\s+(\w+)", "function": r"(?m)^\s*(?:(?:public|private|protected|static|final|override|suspend|abstract|synchronized)\s+)*(?:fun\s+|[\w<>\[\], ]+\s+)(\w+)\s*\([^;{}]*\)\s*[^;{}]*\{", "route": r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?['\"]([^'\"]+)['\"]"}
_php = {"import": r"(?m)^\s*use\s+([\w\\]+)|(?:include|require)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]", "class": r"\bclass\s+(\w+)", "function": r"\bfunction\s+(\w+)\s*\(", "route": r"(?:\$app|\$router|Route)(?:::|->)\s*(get|post|put|delete|patch|map)\s*\(\s*['\"]([^'\"]+)['\"]"}
# Patterns of the other languages' own grammars.
_go = {"import": r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", "class": r"\btype\s+(\w+)\s+(?:struct|interface)", "function": r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]"}
_rust = {"import": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", "class": r"\b(?:struct|enum|trait)\s+(\w+)", "function": r"\bfn\s+(\w+)\s*[<(]", "block": r"\bimpl\b(?:\s*<[^<>{}]*>)?\s+(?:[\w:]+(?:<[^<>{}]*>)?\s+for\s+)?(\w+)"}
_ruby = {"import": r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "class": r"(?m)^\s*(?:class|module)\s+(\w+)", "function": r"(?m)^\s*def\s+(?:self\.)?(\w+[!?]?)"}
_c = {"import": r"(?m)^\s*#\s*include\s*[<\"]([^>\"\n]+)[>\"]", "class": r"\b(?:struct|union|enum)\s+(\w+)\s*\{"}
_cpp = {"import": _c["import"], "class": r"\b(?<!enum )(?:class|struct|union|enum(?:\s+class)?)\s+(\w+)(?=[^;(){}=<>]*\{)"}
_csharp = {"import": r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", "class": r"\b(?:class|struct|interface|record|enum)\s+(\w+)", "route": r"\[Http(Get|Post|Put|Delete|Patch)\s*\(\s*\"([^\"]+)\""}
_kotlin = _java | {"function": r"\bfun\s+(?:<[^<>{}()]*>\s*)?(?:[\w<>?, ]+\.)?(\w+)\s*\("}
_scala = {"import": r"(?m)^\s*import\s+([\w.]+)", "class": r"\b(?:class|object|trait)\s+(\w+)", "function": r"\bdef\s+(\w+)"}
_swift = {"import": r"(?m)^\s*import\s+(?:(?:class|struct|enum|protocol|func|var)\s+)?([\w.]+)", "class": r"\b(?:class|struct|enum|protocol|actor)\s+(?!func\b|var\b|let\b)(\w+)", "function": r"\bfunc\s+(\w+)|(?<![.\w])(init)\s*[?!]?\s*\(", "block": r"\bextension\s+(\w+)"}
RULES = {"javascript": _js, "typescript": _js, "java": _java, "kotlin": _kotlin, "php": _php, "go": _go, "rust": _rust, "ruby": _ruby, "c": _c, "cpp": _cpp, "csharp": _csharp, "scala": _scala, "swift": _swift}
#: Words that declare a function, also before the parenthesis of what it belongs to.
DECLARING = frozenset("func fun fn".split())
_call = re.compile(r"(?:(\$?\w+)\s*(?:\.|::|->)\s*)?(\w+)\s*\(")


def python_facts(content: str):
    """Facts of a Python file; none where it does not parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return
    spans = sorted(((n.lineno, n.end_lineno, n.name) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), key=lambda s: (s[1] - s[0], -s[0]))
    inside = lambda line: next((s[2] for s in spans if s[0] <= line <= s[1]), None)
    for n in ast.walk(tree):
        if isinstance(n, ast.ClassDef):
            yield "class", n.name, None, None, n.lineno, n.end_lineno
            for f in n.body:
                if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield "method", f.name, None, n.name, f.lineno, f.end_lineno
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield "function", n.name, ", ".join(a.arg for a in n.args.args), None, n.lineno, n.end_lineno
            for d in n.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ("route", *HTTP.split()) and d.args and isinstance(d.args[0], ast.Constant):
                    yield "route", str(d.args[0].value), "ANY" if d.func.attr == "route" else d.func.attr.upper(), n.name, d.lineno, None
        elif isinstance(n, ast.Import):
            for a in n.names:
                yield "import", a.name, a.asname or a.name.split(".")[-1], None, n.lineno, None
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                yield "import", "." * n.level + (n.module or ""), a.asname or a.name, None, n.lineno, None
        elif isinstance(n, ast.Call):
            name = getattr(n.func, "attr", getattr(n.func, "id", None))
            owner = getattr(getattr(n.func, "value", None), "id", getattr(getattr(n.func, "value", None), "attr", None))
            if name and name not in NO_CALLS:
                yield "call", name, owner, inside(n.lineno), n.lineno, None


def pattern_facts(content: str, language: str):
    """Facts by patterns, of code only: what stands in strings and comments declares and calls nothing.
    A function lasts until its body ends; its owner is the class around it, a call's owner the innermost
    function around it."""
    rules = RULES.get(language, {})
    if not rules:
        return
    from bisect import bisect_left

    ends = [m.start() for m in re.finditer("\n", content)]
    at = lambda pos: bisect_left(ends, pos) + 1
    code = scopes.blanked(content, language)
    declared = []
    for kind, rule in rules.items():
        quoting = kind in ("import", "route")
        for m in re.finditer(rule, content if quoting else code):
            groups = [g for g in m.groups() if g]
            # a word like new is a name where another word declares it
            if not groups or groups[-1] in NO_CALLS and (kind != "function" or language in ("java", "javascript", "typescript", "php")):
                continue
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            if quoting and code[first] != content[first]:
                continue
            if kind == "route":
                yield "route", groups[1], groups[0].upper(), None, at(first), None
            elif kind == "import" and language in ("javascript", "typescript"):
                names = re.findall(r"[\w$]+", " ".join(groups[:-1])) or [groups[-1].rsplit("/", 1)[-1]]
                for name in names:
                    if name not in ("as", "type"):
                        yield "import", groups[-1], name, None, at(first), None
            elif kind == "import":
                yield "import", groups[0], re.split(r"[./\\:]+", groups[0])[-1], None, at(first), None
            else:
                place = m.start(next(i for i, g in enumerate(m.groups(), 1) if g))
                word = re.search(r"(\w+)\s+$", code[max(0, place - 40) : place])
                if kind != "function" or not word or word[1] not in scopes.BEFORE_CALLS:
                    declared.append((kind, groups[0], first, place))
    found = scopes.scopes(code, language, declared, _call)
    for s in found:
        if s.kind == "function":
            yield "function", s.name, None, s.around.owner("class") if s.around else _receiver(code, s, language), at(s.start), at(max(s.start, s.end - 1))
        elif s.kind == "class":
            yield "class", s.name, None, None, at(s.start), at(max(s.start, s.end - 1))
    names, index, no_calls = {s.at for s in found}, scopes.Index(found), scopes.CONTROL_OF.get(language, set())
    typed = language in scopes.BARE and language not in ("javascript", "typescript")
    for m in _call.finditer(code):
        if m.start(2) in names or m[2] in NO_CALLS or m[2] in DECLARING or m[2] in no_calls or re.search(r"(?:function|func|fn|fun|def|class)\s+$", code[max(0, m.start(2) - 12) : m.start(2)]):
            continue
        inner = index.around(m.start(2))
        if typed and not (inner and inner.owner("function")) and not m[1] and scopes.declares(code, m.start(2)):
            continue
        yield "call", m[2], m[1], inner.owner("function") if inner else None, at(m.start(2)), None


def _receiver(code: str, scope: scopes.Scope, language: str) -> str | None:
    """The type that a Go method is declared for."""
    m = re.match(r"func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)", code[scope.start : scope.at]) if language == "go" else None
    return m[1] if m else None


def facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, language, content)."""

    def run(frames):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for f in frames:
            rows = [(p, *x) for p, lang, c in zip(f["path"], f["language"], f["content"], strict=True) if c for x in (python_facts(c) if lang == "python" else pattern_facts(c, lang))]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"line": "Int32", "end_line": "Int32"})

    return files.select("path", "language", "content").mapInPandas(run, SCHEMA)


def tags(source: Column) -> Column:
    """Security tags of a symbol's text (name, signature, body)."""
    return F.array_compact(F.array(*[F.when(source.rlike(f"(?i)({p})"), F.lit(t)) for t, p in TAGS.items()]))


ANDROID = "{http://schemas.android.com/apk/res/android}"


def android_facts(manifest: str):
    """(kind, name, detail) of an Android manifest: package, permissions, flags, exported parts."""
    try:
        root = ET.fromstring(manifest)
    except ET.ParseError:
        return
    yield "package", root.get("package", ""), None
    for p in root.iter("uses-permission"):
        yield "permission", p.get(ANDROID + "name", ""), None
    for app in root.iter("application"):
        for flag in ("debuggable", "allowBackup", "usesCleartextTraffic"):
            if app.get(ANDROID + flag) is not None:
                yield "flag", flag, app.get(ANDROID + flag)
        for kind in ("activity", "service", "receiver", "provider"):
            for c in app.iter(kind):
                exported = c.get(ANDROID + "exported")
                if exported == "true" or exported != "false" and c.find("intent-filter") is not None:
                    yield "exported", c.get(ANDROID + "name", ""), kind


def android(manifests: DataFrame) -> DataFrame:
    """Facts of manifests (path, content)."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(p, *x) for p, c in zip(f["path"], f["content"], strict=True) for x in android_facts(c or "")], columns=["path", "kind", "name", "detail"])

    return manifests.select("path", "content").mapInPandas(run, "path string, kind string, name string, detail string")


def block_end(content: Column, start_line: Column, indent: Column) -> Column:
    """The last line of the Python block that begins at a line: what follows belongs to it until a line
    that is no comment is indented as little."""
    after = F.slice(F.split(content, "\n", -1), start_line + 1, F.lit(2**30))
    lines = F.transform(after, lambda x, i: F.struct((i + 1).alias("at"), (F.length(x) - F.length(F.ltrim(F.translate(x, "\t", " ")))).alias("indent"), F.btrim(x, F.lit(" \t\r")).alias("text")))
    told = F.filter(lines, lambda x: x["text"] != "")
    stop = F.try_element_at(F.filter(told, lambda x: (x["indent"] <= indent) & ~x["text"].startswith("#")), F.lit(1))["at"]
    last = F.try_element_at(F.filter(told, lambda x: stop.isNull() | (x["at"] < stop)), F.lit(-1))["at"]
    return start_line + F.coalesce(last, F.lit(0))


def android_summary(facts: DataFrame) -> DataFrame:
    """One row for each manifest (path): its package, permissions, exported parts and flags, in order."""
    of = lambda kind, value: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, value)))
    name, pair = F.col("name"), F.concat_ws("=", "name", "detail")
    return facts.groupBy("path").agg(F.max(F.when(F.col("kind") == "package", name)).alias("package"), of("permission", name).alias("permissions"), of("exported", name).alias("exported"), of("flag", pair).alias("flags"))


def component_sources(components: DataFrame, files: DataFrame, limit: int = 5) -> DataFrame:
    """(component, path) of the source files of Android parts (component, package): files whose path ends
    in the class's file name, else those that declare a class of that name, the first so many.

    The ends of file names that are as long as a wanted name meet it by equality. Both sides may be as large as
    the tree, whatever a plan expects of them, so neither is broadcast."""
    full = F.when(F.col("component").startswith("."), F.concat(F.coalesce("package", F.lit("")), "component")).otherwise(F.trim("component"))
    wanted = components.select("component", F.regexp_extract(full, r"([^.]+)$", 1).alias("class")).distinct()
    named = wanted.select("component", F.explode(F.array(F.concat("class", F.lit(".java")), F.concat("class", F.lit(".kt")))).alias("end"))
    base = F.regexp_extract("path", "([^/]*)$", 1)
    sizes = F.broadcast(named.agg(F.collect_set(F.length("end")).alias("_sizes")))
    sources = files.where(F.col("path").rlike(r"\.(java|kt)$")).select("path", base.alias("_base")).crossJoin(sizes)
    ends = sources.select("path", F.explode(F.transform(F.filter("_sizes", lambda n: n <= F.length("_base")), lambda n: F.right("_base", n))).alias("end"))
    by_name = named.join(ends.hint("merge"), "end").select("component", "path").distinct()
    rest = wanted.join(by_name.select("component").distinct().hint("merge"), "component", "left_anti")
    declared = files.where(F.col("path").endswith(".java")).select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"class\s+(\w+)\s"), F.lit(1)))).alias("class"))
    by_class = rest.join(declared.hint("merge"), "class").select("component", "path").distinct()
    few = by_class.withColumn("_r", F.row_number().over(Window.partitionBy("component").orderBy("path"))).where(F.col("_r") <= limit).drop("_r")
    return by_name.unionByName(few)


def body(content: Column, line: Column, end_line: Column) -> Column:
    """A symbol's own lines."""
    from ..functions.text import lines_between

    return lines_between(content, line, F.coalesce(end_line, line))


def routes(facts: DataFrame) -> DataFrame:
    """Routes with their methods and handlers, and how many a file has."""
    w = Window.partitionBy("path")
    return facts.where("kind = 'route'").select("path", F.col("name").alias("route"), F.col("detail").alias("method"), F.col("owner").alias("handler"), "line", F.count("*").over(w).alias("in_file"))
