"""Queries of patches: lines of unified diffs and the symbols that they touch. Patches are made from the
rows of ``documents``: a frame of declarations around each text, whose lines are the patch's context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources import patches
from .registry import query

_PY = "From: a\ndiff --git a/src/pkg/mod.py b/src/pkg/mod.py\n--- a/src/pkg/mod.py\n+++ b/src/pkg/mod.py\n@@ -3,9 +3,11 @@ def ctx_KEY(a):\n+class BoxKEY(Base):\n+    def inner(self):\n-        def deep(x):\n TEXT\n+    def after_KEY(self):\n     def untouched(self):\ndiff --git a/tests/t.py b/tests/t.py\n+++ b/tests/t.py\n+def in_a_test():\n"
_JS = "diff --git a/lib/util.js b/lib/util.js\n--- a/lib/util.js\n+++ b/lib/util.js\n@@ -10 +12,4 @@ class HeadKEY extends X {\n+  top_KEY(a) {\n+  }\n+}\n+  closed_KEY(a) {\n@@ -40,2 +44,9 @@\n+export default class BoxKEY {\n+  async open_KEY(a, b) {\n TEXT\n+  }\n+}\n+const arrow_KEY = async (x) => x\n-export function gone_KEY(y) {\n"
#: Does a text have a line that begins at the margin and is no comment or decorator?
_ENDS = r"(^|\n)[^\s@#]"


def made(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("KEY"), key), F.lit("TEXT"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n ")))
    python = F.col("doc_id") % 2 == 0
    return docs.select(F.col("doc_id").alias("id"), F.when(python, "PyPI").otherwise("npm").alias("ecosystem"), F.lit("pack").alias("package"), F.when(python, fill(_PY)).otherwise(fill(_JS)).alias("patch"))


_COUNTS = "(length(text) - length(replace(text, '{', ''))) - (length(text) - length(replace(text, '}', '')))"


@query(
    "q276_patch_symbols",
    f"""WITH d AS (SELECT doc_id, regexp_matches(coalesce(text, ''), '{_ENDS}') AS ends FROM documents),
s AS (
  SELECT doc_id, unnest(['Box' || doc_id || '.inner', 'Box' || doc_id || '.deep', CASE WHEN ends THEN '' ELSE 'Box' || doc_id || '.' END || 'after_' || doc_id]) AS symbol,
    ['pkg.mod'] AS paths, 0.86 AS confidence FROM d WHERE doc_id % 2 = 0
  UNION ALL
  SELECT doc_id, unnest(['Head' || doc_id || '.top_' || doc_id, 'Box' || doc_id || '.open_' || doc_id, 'arrow_' || doc_id, 'gone_' || doc_id]),
    ['pack/lib/util', 'pack/util'], 0.84 FROM d WHERE doc_id % 2 = 1)
SELECT doc_id AS id, symbol, unnest(paths) AS import_path, ['patch_fix_ref'] AS sources, confidence::DOUBLE AS confidence FROM s""",
)
def patch_symbols(spark, sf_dir):
    return patches.patch_symbols(made(spark, sf_dir))


@query(
    "q276_diff_lines",
    "WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents WHERE doc_id % 2 = 0) "
    "SELECT doc_id AS id, (i + 8)::INT AS at, (i + 5)::INT AS new_line, (i + 4)::INT AS old_line, content FROM d",
)
def diff_lines(spark, sf_dir):
    """Where the lines of a text stand before and after the patch that holds them as context."""
    rows = patches.diff_lines(made(spark, sf_dir).where("ecosystem = 'PyPI'"))
    return rows.where("hunk = 1 and mark = ' ' and file = 'src/pkg/mod.py' and content <> '    def untouched(self):'").select("id", "at", "new_line", "old_line", "content")
