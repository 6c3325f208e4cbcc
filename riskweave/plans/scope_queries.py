"""Queries of nested declarations: whose a function is, where it ends, and which one makes a call."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import spread, table
from ..sources import structure
from .registry import query
from .source_queries import filled

#: A source of each language, with its functions (name, class, first and last line) and calls (name,
#: caller). Strings and comments hold what would be functions and calls.
NESTED = {
    "javascript": ("class CKEY {\n  async outKEY(a) {\n    const s = 'function fake() {'\n    const inKEY = (b) => {\n      lowKEY(b)\n    }\n    return highKEY(`${ midKEY() }`)\n  }\n}\nlastKEY()\n", [("outKEY", "CKEY", 2, 8), ("inKEY", "CKEY", 4, 6)], [("lowKEY", "inKEY"), ("highKEY", "outKEY"), ("midKEY", "outKEY"), ("lastKEY", None)]),
    "java": ("class CKEY {\n  int x = firstKEY();\n  void outKEY(int a) throws E {\n    // } fake()\n    new Thread() {\n      public void inKEY() { lowKEY(); }\n    };\n    highKEY('}');\n  }\n}\n", [("outKEY", "CKEY", 3, 9), ("inKEY", "CKEY", 6, 6)], [("firstKEY", None), ("Thread", "outKEY"), ("lowKEY", "inKEY"), ("highKEY", "outKEY")]),
    "c": ('static int declKEY(int a);\nint outKEY(char *a)\n{\n  if (a) { lowKEY("} fake("); }\n  return highKEY(a);\n}\n/* fake() { */\nint lastKEY(void) { return 0; }\n', [("outKEY", None, 2, 6), ("lastKEY", None, 8, 8)], [("lowKEY", "outKEY"), ("highKEY", "outKEY")]),
    "cpp": ('class CKEY {\n public:\n  CKEY(int a) : b{a} { lowKEY(R"(} fake()"); }\n  int outKEY() const {\n    auto f = [](int q) { return highKEY(q); };\n    return 1;\n  }\n};\n', [("CKEY", "CKEY", 3, 3), ("outKEY", "CKEY", 4, 7)], [("lowKEY", "CKEY"), ("highKEY", "outKEY")]),
    "csharp": ('class CKEY {\n  int outKEY(int a) {\n    int inKEY(int b) { return lowKEY(b); }\n    using (x) { highKEY(@"""} fake("); }\n    return 2;\n  }\n  int lastKEY(int a) => midKEY(a);\n}\n', [("outKEY", "CKEY", 2, 6), ("inKEY", "CKEY", 3, 3), ("lastKEY", "CKEY", 7, 7)], [("lowKEY", "inKEY"), ("highKEY", "outKEY"), ("midKEY", "lastKEY")]),
    "kotlin": ("class CKEY(val x: Int) {\n  fun outKEY(a: Int) {\n    /* a /* b */ fake() */\n    fun inKEY() = lowKEY()\n    a.also { highKEY(it) }\n  }\n}\n", [("outKEY", "CKEY", 2, 6), ("inKEY", "CKEY", 4, 4)], [("lowKEY", "inKEY"), ("highKEY", "outKEY")]),
    "scala": ('object CKEY {\n  def outKEY(a: Int)(b: Int): Int = {\n    def inKEY = lowKEY(a)\n    """fake() {"""\n    highKEY(b)\n  }\n  midKEY()\n}\n', [("outKEY", "CKEY", 2, 6), ("inKEY", "CKEY", 3, 3)], [("lowKEY", "inKEY"), ("highKEY", "outKEY"), ("midKEY", None)]),
    "swift": ('struct CKEY {\n  func outKEY(_ a: Int) -> Int {\n    func inKEY() { lowKEY() }\n    return highKEY("} fake(")\n  }\n}\nextension CKEY {\n  func lastKEY() { midKEY() }\n}\n', [("outKEY", "CKEY", 2, 5), ("inKEY", "CKEY", 3, 3), ("lastKEY", "CKEY", 8, 8)], [("lowKEY", "inKEY"), ("highKEY", "outKEY"), ("midKEY", "lastKEY")]),
    "go": ("package p\nfunc (t *CKEY) outKEY(a int) int {\n\tf := func(q int) { lowKEY(q) }\n\ts := `} fake(`\n\treturn highKEY(f)\n}\nvar x = lastKEY()\n", [("outKEY", "CKEY", 2, 6)], [("lowKEY", "outKEY"), ("highKEY", "outKEY"), ("lastKEY", None)]),
    "rust": ("impl Tr for CKEY {\n  fn outKEY<'a>(x: &'a str) {\n    fn inKEY() { lowKEY('}') }\n    highKEY(r#\"} fake(\"#)\n  }\n}\nfn lastKEY() { midKEY() }\n", [("outKEY", "CKEY", 2, 5), ("inKEY", "CKEY", 3, 3), ("lastKEY", None, 7, 7)], [("lowKEY", "inKEY"), ("highKEY", "outKEY"), ("midKEY", "lastKEY")]),
    "php": ("<?php\nclass CKEY {\n  function outKEY($a) {\n    # } fake()\n    $g = function ($b) { lowKEY($b); };\n    return highKEY('} fake(');\n  }\n}\nlastKEY();\n", [("outKEY", "CKEY", 3, 7)], [("lowKEY", "outKEY"), ("highKEY", "outKEY"), ("lastKEY", None)]),
    "ruby": ("class CKEY\n  def outKEY(a)\n    lowKEY(a) if a # end fake()\n    [1].each do |i|\n      highKEY(i)\n    end\n  end\nend\nlastKEY(1)\n", [("outKEY", "CKEY", 2, 7)], [("lowKEY", "outKEY"), ("highKEY", "outKEY"), ("lastKEY", None)]),
}
_LANGUAGES = list(NESTED)


def _facts(spark, sf_dir):
    key, some = F.col("p_partkey"), (F.col("p_partkey") % len(_LANGUAGES)).cast("int")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), some)
    path = F.concat(F.lit("m"), key.cast("string"))
    return structure.facts(spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(path.alias("path"), pick(_LANGUAGES).alias("language"), filled(pick([NESTED[n][0] for n in _LANGUAGES]), key).alias("content")))


def _values(rows, *types: str) -> str:
    """Rows of each language, with part keys for KEY."""
    cell = lambda v, t: f"NULL::{t}" if v is None else f"{v}::{t}" if isinstance(v, int) else f"'{v}'"
    listed = ", ".join(f"({i}, {', '.join(cell(v, t) for v, t in zip(row, types, strict=True))})" for i, name in enumerate(_LANGUAGES) for row in rows(name))
    return f"part JOIN (VALUES {listed}) v(i, a, b, c, d) ON p_partkey % {len(_LANGUAGES)} = i"


_KEYED = "replace({}, 'KEY', p_partkey::VARCHAR)"


@query("q249_nested_functions", f"SELECT 'm' || p_partkey AS path, {_KEYED.format('a')} AS name, {_KEYED.format('b')} AS class, c AS line, d AS end_line FROM " + _values(lambda n: NESTED[n][1], "VARCHAR", "VARCHAR", "INT", "INT"))
def nested_functions(spark, sf_dir):
    """Functions with the class around them and the lines that they take."""
    return _facts(spark, sf_dir).where("kind = 'function'").select("path", "name", F.col("owner").alias("class"), "line", "end_line")


@query("q247_calls_of_nested_functions", f"SELECT 'm' || p_partkey AS path, {_KEYED.format('a')} AS name, {_KEYED.format('b')} AS caller FROM " + _values(lambda n: [(*x, None, None) for x in NESTED[n][2]], "VARCHAR", "VARCHAR", "INT", "INT"))
def calls_of_nested_functions(spark, sf_dir):
    """Calls with the innermost function that makes them; none for calls of the module or a class."""
    return _facts(spark, sf_dir).where("kind = 'call'").select("path", "name", F.col("owner").alias("caller"))
