"""Queries of rules of regular expressions over files: as many rules as there are parts, over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import spread, table
from ..sources import rules
from .registry import query
from .source_queries import filled

_RULE = """rules:
- id: rKEY
  languages: [regex]
  severity: ERROR
  patterns:
  - pattern-regex: 'tok_(KEY)_(?P<rest>[a-z]*)'
  - pattern-not-regex: 'tok_\\w+ # nosec'
  - metavariable-regex: {metavariable: $rest, regex: '$|a'}
  paths: {exclude: [EXCLUDED]}
"""
_SEEDED = "TEXT\nuse tok_A_ here\nmine tok_A_ # nosec\nkey = tok_B_abc\nother = tok_B_xyz"


@query(
    "q067_rule_hits",
    """WITH d AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'vendor/f' ELSE 'src/f' END || doc_id || '.py' AS path,
    len(string_split(coalesce(text, ''), chr(10))) AS n, doc_id % 500 AS a, doc_id % 7 AS b FROM documents),
h AS (SELECT doc_id, path, n + 1 AS line, a AS k FROM d UNION ALL SELECT doc_id, path, n + 3, b FROM d)
SELECT path, line::INT AS line, 'r' || k AS rule_id, 'ERROR' AS severity FROM h JOIN part ON p_partkey = k
WHERE NOT (doc_id % 4 = 0 AND k % 2 = 0)""",
)
def rule_hits(spark, sf_dir):
    """Lines of documents that rules made from parts match: paths, groups and what must not match count."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    excluded = F.when(F.col("p_partkey") % 2 == 0, "vendor").otherwise("none")
    yaml = F.replace(filled(F.lit(_RULE), F.col("p_partkey")), F.lit("EXCLUDED"), excluded)
    corpus = rules.read(part.select(filled(F.lit("rKEY.yaml"), F.col("p_partkey")).alias("path"), yaml.alias("content")))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    text = F.lit(_SEEDED)
    for word, value in (("_A_", F.concat(F.lit("_"), (F.col("doc_id") % 500).cast("string"), F.lit("_"))), ("_B_", F.concat(F.lit("_"), (F.col("doc_id") % 7).cast("string"), F.lit("_"))), ("TEXT", F.coalesce("text", F.lit("")))):
        text = F.replace(text, F.lit(word), value)
    path = F.concat(F.when(F.col("doc_id") % 4 == 0, "vendor/f").otherwise("src/f"), F.col("doc_id").cast("string"), F.lit(".py"))
    return rules.matches(docs.select(path.alias("path"), text.alias("content")), corpus)
