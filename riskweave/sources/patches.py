"""Unified diffs as rows, and the symbols that a patch touches.

A patch is exploded into its lines; what a reader would remember between them (the file, the hunk, the
class that is open, the depth of braces) is a window over the lines before, so a patch of any length
is read by sorting, without a loop. Rows that share an id are read apart from each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mining

# Declarations in patched lines, and how sure each place makes a symbol.
PYTHON_DEF = r"^\s*(?:async\s+def|def)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
PYTHON_CLASS = r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\b"
JS_FUNCTION = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function(?:\s*\*)?\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
JS_VARIABLE = r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?(?:function(?:\s*\*)?\s*\(|\([^)]*\)\s*=>|[A-Za-z_$][A-Za-z0-9_$]*\s*=>)"
JS_CLASS = r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)\b"
JS_METHOD = r"^\s*(?:async\s+)?(?:static\s+)?([A-Za-z_$][A-Za-z0-9_$]*)\s*\([^;=]*\)\s*\{"
CHANGED, CONTEXT = "patch_fix_ref", "patch_hunk_context"
CONFIDENCE = {("pypi", CHANGED): 0.86, ("pypi", CONTEXT): 0.78, ("npm", CHANGED): 0.84}

LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def _before(*keys: str, now: bool = True):
    return Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if now else -1)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def diff_lines(patches: DataFrame) -> DataFrame:
    """Lines of patches (id, patch, and what else they have): at (place in the patch), file and segment (which
    of the patch's files), hunk (its number in the patch), mark (``@`` for a hunk's head, ``+``, ``-`` or a
    blank for its lines), content, and the line's number before and after the change. Lines of no file
    are left out."""
    kept = [c for c in patches.columns if c != "patch"]
    rows = patches.withColumn("row", F.monotonically_increasing_id()).select(*kept, "row", F.posexplode(F.split("patch", LINE_ENDS, -1)).alias("at", "line"))
    line = F.col("line")
    named, head = line.startswith("+++ "), line.startswith("@@")
    starts = named | line.startswith("diff --git ")
    mark = F.when(head, "@").when(line.startswith("+++") | line.startswith("---"), None).when(F.substring(line, 1, 1).isin("+", "-", " "), F.substring(line, 1, 1))
    rows = rows.withColumn("segment", F.count_if(starts).over(_before("row"))).withColumn("hunk", F.count_if(head).over(_before("row"))).withColumn("mark", F.when(~starts, mark))
    name = F.regexp_replace(_strip(F.substring(line, 5, 2**30)), "^b/", "")
    rows = rows.withColumn("file", F.first(F.when(named, name).otherwise("")).over(_before("row", "segment"))).where((F.col("file") != "") & F.col("mark").isNotNull())
    content = F.when(head, _strip(F.regexp_replace(line, "^@@(?:[^@]|@(?!@))*(?:@@)?", ""))).otherwise(F.substring(line, 2, 2**30))
    number = lambda group, marks: (
        F.first(F.when(head, F.regexp_extract(line, HUNK, group))).over(_before("row", "segment", "hunk")).try_cast("int") + F.count_if(F.col("mark").isin(*marks)).over(_before("row", "segment", "hunk", now=False)).cast("int")
    )
    old, new = (F.when(F.col("mark").isin(*marks), number(g, marks)) for g, marks in ((1, [" ", "-"]), (2, [" ", "+"])))
    return rows.withColumns({"old_line": old, "new_line": new}).withColumn("content", content).drop("line")


def _declared(content: Column, *patterns: str) -> Column:
    """The first name that a pattern finds."""
    return F.coalesce(*[F.nullif(F.regexp_extract(content, p, 1), F.lit("")) for p in patterns])


def _python(lines: DataFrame) -> DataFrame:
    """A method belongs to the class above it that is less indented; a line at most as far in as the class,
    unless it is a definition, ends it."""
    content, file = F.col("content"), ["row", "segment"]
    bare = _strip(content)
    indent = F.length(content) - F.length(F.regexp_replace(content, "^ +", ""))
    lines = lines.withColumns({"class": _declared(content, PYTHON_CLASS), "def": _declared(content, PYTHON_DEF), "indent": indent})
    lines = lines.withColumn("part", F.count("class").over(_before(*file)))
    own = _before(*file, "part")
    lines = lines.withColumn("in_class", F.first("class").over(own)).withColumn("class_indent", F.first("indent").over(own))
    ends = F.col("class").isNull() & F.col("def").isNull() & (bare != "") & ~bare.rlike("^[@#]") & (F.col("indent") <= F.col("class_indent"))
    open_ = (F.col("part") > 0) & ~F.max(ends).over(own)
    inner = open_ & (F.col("indent") > F.col("class_indent"))
    symbol = F.when(inner, F.concat_ws(".", "in_class", "def")).otherwise(F.col("def"))
    return lines.withColumn("symbol", symbol).where(F.col("def").isNotNull() & (F.col("mark") != " "))


def _script(lines: DataFrame) -> DataFrame:
    """A method belongs to the class whose braces are open; a hunk's head closes it, or opens the one it
    names."""
    content, file, head = F.col("content"), ["row", "segment"], F.col("mark") == "@"
    count = lambda c: F.length(content) - F.length(F.replace(content, F.lit(c), F.lit("")))
    lines = lines.withColumns({"class": _declared(content, JS_CLASS), "step": count("{") - count("}")})
    lines = lines.withColumn("depth", F.coalesce(F.sum(F.when(~head, F.col("step"))).over(_before(*file)), F.lit(0)))
    lines = lines.withColumn("part", F.count_if(head | F.col("class").isNotNull()).over(_before(*file)))
    own = _before(*file, "part")
    at = F.when(head, F.greatest(F.lit(1), F.col("step"))).otherwise(F.col("depth"))
    lines = lines.withColumn("in_class", F.first("class").over(own)).withColumn("class_depth", F.first(at).over(own))
    closed = F.coalesce(F.max(~head & (F.col("depth") < F.col("class_depth"))).over(_before(*file, "part", now=False)), F.lit(False))
    open_ = (F.col("part") > 0) & F.col("in_class").isNotNull() & ~closed
    method = F.when(open_, F.concat_ws(".", "in_class", _declared(content, JS_METHOD)))
    symbol = F.coalesce(_declared(content, JS_FUNCTION, JS_VARIABLE), F.when(_declared(content, JS_METHOD).isNotNull(), method))
    return lines.withColumn("symbol", symbol).where(F.col("mark").isin("+", "-"))


def patch_symbols(patches: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, symbol, import_path, sources, confidence) of patches (id, ecosystem, package, patch) of Python
    and JavaScript packages: functions whose declarations changed, or where none did, those that heads
    of hunks name, if they are methods or their module is known. limit: the first so many of an id."""
    lines = diff_lines(patches.select("id", F.lower(F.trim("ecosystem")).alias("ecosystem"), F.coalesce("package", F.lit("")).alias("package"), "patch"))
    lines = lines.where(~mining.skipped_in_patches(F.col("file")))
    python, script = lines.where("ecosystem = 'pypi'"), lines.where("ecosystem = 'npm'")
    module = F.array(mining.python_module(F.col("file")))
    found = _python(python).withColumn("modules", module).unionByName(_script(script).withColumn("modules", mining.npm_modules(F.col("file"), F.col("package"))), allowMissingColumns=True)
    source = F.when(F.col("mark") == "@", CONTEXT).otherwise(CHANGED)
    sure = F.coalesce(*[F.when((F.col("ecosystem") == e) & (source == s), c) for (e, s), c in CONFIDENCE.items()])
    rows = found.select("id", "row", "at", mining.candidate(F.col("symbol"), F.lit(True)).alias("symbol"), F.explode_outer("modules").alias("module"), source.alias("source"), sure.alias("confidence")).where("symbol is not null")
    rows = rows.withColumn("import_path", mining.import_path(F.col("module")))
    each = rows.groupBy("id", "symbol", "import_path").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.max("confidence").alias("confidence"), F.min(F.struct("row", "at")).alias("first"))
    changed = F.array_contains("sources", CHANGED)
    any_changed = F.max(changed).over(Window.partitionBy("id"))
    told = F.col("import_path").isNotNull() | F.col("symbol").contains(".")
    each = each.withColumn("_any", any_changed).where(F.when(F.col("_any"), changed).otherwise(told)).drop("_any")
    if limit is not None:
        each = each.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("first", "symbol", "import_path"))).where(F.col("_r") <= limit).drop("_r")
    return each.drop("first")
