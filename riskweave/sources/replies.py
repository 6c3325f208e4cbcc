"""The JSON object that a free text holds: fenced, bare, among reasoning, or cut off at the end.

An opener's partner is found by a scan that knows strings and escapes. Scans that meet in the same
state are one, so a text takes a few scans however many openers it has. Of what parses, the largest
object counts; a text that was cut off may be closed at its end instead."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks of visible reasoning.
REASONING = "think thinking reasoning analysis scratchpad thought chain_of_thought".split()
FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)

_marks = [re.compile(p.format(t), re.DOTALL | re.IGNORECASE) for t in REASONING for p in (r"<{0}\b[^>]*>.*?</{0}>", r"\[{0}\b[^\]]*\].*?\[/{0}\]")]
_unended = re.compile(r"\s*[<\[](?:{})".format("|".join(REASONING[:-1])), re.IGNORECASE)
_opener = re.compile(r"\{{|\[(?!/?(?:{})\b)".format("|".join(REASONING)), re.IGNORECASE)
_token = re.compile(r'[{}\[\]"\\]')


def without_reasoning(text: str) -> str:
    """The text without marked reasoning. If its mark is not ended, from the first opener on."""
    text = text.strip()
    for mark in _marks:
        text = mark.sub("", text).strip()
    if _unended.match(text) and (first := _opener.search(text)):
        text = text[first.start() :].strip()
    return text


def partners(text: str) -> dict[int, int | None]:
    """For each ``{`` and ``[``, read as if no string were open before it, the end of what it opens; None
    if it is not closed, or by the wrong sign."""
    tokens = [(m.start(), m[0]) for m in _token.finditer(text)]
    known: dict[int, int | None] = {}
    for first, (start, sign) in enumerate(tokens):
        if sign not in "{[" or start in known:
            continue
        stack, inside, skip = [], False, -1
        for at, sign in tokens[first:]:
            if at == skip:
                continue
            if inside:
                if sign == "\\":
                    skip = at + 1
                elif sign == '"':
                    inside = False
            elif sign == '"':
                inside = True
            elif sign in "{[":
                stack.append((at, sign))
            elif sign in "}]" and stack:
                opened, kind = stack.pop()
                if kind + sign not in ("{}", "[]"):
                    known |= dict.fromkeys([opened, *(x for x, _ in stack)])
                    stack = []
                else:
                    known[opened] = at + 1
        known |= dict.fromkeys(x for x, _ in stack)
    return known


def _parsed(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _closed(text: str):
    """A text without its last comma and with closing signs for what is open."""
    open_ = [max(0, text.count(a) - text.count(b)) for a, b in ("[]", "{}")]
    return _parsed(text.rstrip().removesuffix(",") + "]" * open_[0] + "}" * open_[1])


def found(content: str, cut_off: bool) -> tuple[object, str]:
    """The value of a text and how it came about: parsed, closed (only where the text was cut off) or
    none."""
    sources = list(dict.fromkeys([without_reasoning(content), content]))
    whole = [m[1].strip() for s in sources for m in FENCE.finditer(s)]
    best, size = None, -1

    def consider(value):
        nonlocal best, size
        n = len(json.dumps(value, sort_keys=True)) if isinstance(value, dict) else -1
        if n > size:
            best, size = value, n

    def tried(text):
        value = _parsed(text)
        consider(value)
        return _closed(text) if value is None and cut_off and text != "null" else None

    for text in whole:
        if (value := tried(text)) is not None:
            return value, "closed"
    for source in sources:
        if source.strip() and (value := tried(source.strip())) is not None:
            return value, "closed"
        ends, done = partners(source), 0
        for start in sorted(ends):
            # parts of an object that was read are smaller than it
            if ends[start] and ends[start] > done:
                value = _parsed(source[start : ends[start]])
                consider(value)
                done = ends[start] if isinstance(value, dict) else done
        rest = next((s for s in sorted(ends) if not ends[s]), None)
        if rest is not None and (value := tried(source[rest:].strip())) is not None:
            return value, "closed"
    if best is not None:
        return best, "parsed"
    value = _closed(sources[0]) if cut_off else None
    return (value, "closed") if value is not None else (None, "none")


def json_of(replies: DataFrame) -> DataFrame:
    """Replies (content, cut_off and what else they have) with ``json`` (the value with sorted keys, null if
    there is none) and ``how``. A null content has none."""
    kept = [c for c in replies.columns if c.lower() not in ("json", "how")]
    rows = replies.select(*kept).withColumn("cut_off", F.coalesce("cut_off", F.lit(False)))

    def run(batches):
        for batch in batches:
            got = [found(c, x) if c else (None, "none") for c, x in zip(batch.column("content").to_pylist(), batch.column("cut_off").to_pylist(), strict=True)]
            value = pa.array([json.dumps(v, sort_keys=True, ensure_ascii=False) if v is not None else None for v, _ in got], pa.string())
            how = pa.array([h for _, h in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, value, how], names=[*batch.schema.names, "json", "how"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("json", T.StringType()), T.StructField("how", T.StringType())]))
