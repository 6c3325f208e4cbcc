"""Queries of JSON in free text: replies are made from ``conversations``, whose texts stand around values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources import replies
from .registry import query

_KINDS = [
    'TEXT {"a": {"b": KEY}} and {"id": KEY, "turn": TURN, "size": SIZE} TEXT',
    'TEXT\n```json\n{"id": KEY, "text": QUOTED}\n```\nTEXT',
    '<think>TEXT {"draft": KEY, "turn": TURN}</think> [1, {"id": KEY}]',
    'TEXT {"id": KEY, "list": [1, 2, {"turn": TURN},',
    "TEXT [TURN] TEXT",
]


@query(
    "q307_json_of_replies",
    """SELECT conv_id, turn, CASE (conv_id + turn) % 5
  WHEN 0 THEN '{"id": ' || conv_id || ', "size": ' || length(text) || ', "turn": ' || turn || '}'
  WHEN 1 THEN '{"id": ' || conv_id || ', "text": ' || to_json(text) || '}'
  WHEN 2 THEN '{"draft": ' || conv_id || ', "turn": ' || turn || '}'
  WHEN 3 THEN '{"id": ' || conv_id || ', "list": [1, 2, {"turn": ' || turn || '}]}' END AS json,
  CASE (conv_id + turn) % 5 WHEN 3 THEN 'closed' WHEN 4 THEN 'none' ELSE 'parsed' END AS how
FROM conversations""",
)
def json_of_replies(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), ((F.col("conv_id") + F.col("turn")) % len(_KINDS)).cast("int"))
    quoted = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    filled = kind
    for word, value in (("KEY", F.col("conv_id").cast("string")), ("TURN", F.col("turn").cast("string")), ("SIZE", F.length("text").cast("string")), ("QUOTED", quoted), ("TEXT", F.col("text"))):
        filled = F.replace(filled, F.lit(word), value)
    # of a text that was cut off, the end is made up
    cut_off = (F.col("conv_id") + F.col("turn")) % len(_KINDS) == 3
    return replies.json_of(rows.select("conv_id", "turn", filled.alias("content"), cut_off.alias("cut_off"))).select("conv_id", "turn", "json", "how")
