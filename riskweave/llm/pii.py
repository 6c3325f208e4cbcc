"""Personal data: fixed patterns, and identifiers found by bootstrapping from their contexts.

The fixed patterns find e-mail addresses, IP addresses, card numbers and phone numbers. They are
the seeds. Tokens with digits are the candidate instances. An instance has up to three lexical
patterns: the two words before it (``w``), a label (the word before it, and the ``:``, ``#`` or
``=`` between them: ``l``), and its frame (the words before and after it and the shape of its
letters and digits: ``f``). Spark scores the graph of patterns and instances iteratively: a pattern
is as good as its instances are on average, an instance as its patterns together (noisy or), seeds
stay certain. Candidates in a pattern of confidence CONFIDENT that SUPPORT different instances have
induced are new identifiers (kind ``id``). Seeds and new identifiers give support, so these find
further patterns, until there are no more. What a fixed pattern looked at and refuted (a card
number's length with a wrong check digit, say) is never an identifier; it counts against its patterns.

Candidates are tokens with a digit, of LEAST characters and more: shorter numbers are counts, years and
list marks far more often than identifiers. A frame's following word is looked for behind at most 16
characters that belong to no word.

The patterns found are broadcast if there are few (MOST_PATTERNS, MOST_CHARS), and then each row
finds its own new identifiers; more of them meet their instances in joins.

Spans count code points, the end is exclusive. Defined cases: null and empty texts have no spans;
repeated rows each give a row and add nothing to a pattern's support; an empty table gives an
empty table. All input columns stay, but those named ``base`` or ``spans`` are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone")
ROUNDS, CONFIDENT, SUPPORT, SMOOTH, LEAST = 3, 0.8, 5, 1.0, 5
#: Most patterns, and their code points together, that are broadcast.
MOST_PATTERNS, MOST_CHARS = 1 << 16, 8 << 20

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits can only start a match at its first digit, so the runs are taken whole.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_candidate = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]*[0-9][A-Za-z0-9]*(?:[-/][A-Za-z0-9]+)*")
_word = re.compile(r"\w+")
_letters = re.compile(r"[^\W\d_]")
_after = re.compile(r"\W{0,16}(\w+)")
#: What may stand between a label and its identifier.
LABELS = frozenset([":", "#", "=", ":#", "#:"])

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
CANDIDATE = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("instance", T.StringType()), T.StructField("seed", T.BooleanType()), T.StructField("refuted", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def emails(text: str) -> list[tuple[int, int]]:
    """E-mail spans; each at sign is looked at once, so a long run costs no more than its length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _local:
            a -= 1
        m = _domain.match(text, at) if a < at else None
        if m:
            out.append((a, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start and then in the order of KINDS."""
    out: list[tuple[int, int, int]] = []
    if text and "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if text and _digit.search(text):
        for m in _ip.finditer(text):
            # zeros first: int() refuses very long numbers
            if all(len(p := q.lstrip("0")) <= 3 and int(p or "0") <= 255 for q in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _card.finditer(text):
            if 12 <= m.end() - m.start() <= 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def _last_words(text: str, end: int, n: int) -> list[re.Match]:
    """The last n words of a text before a place, or all; it looks back as far as needed for that."""
    look = 64
    while True:
        start = max(0, end - look)
        found = list(_word.finditer(text, start, end))
        # the first word of the part may be cut
        if start and found and found[0].start() == start:
            found = found[1:]
        if len(found) >= n or not start:
            return found[-n:]
        look *= 4


def pattern_before(text: str, start: int) -> str | None:
    """The two words before a place, lower-cased; None if there are fewer or digits in them."""
    words = [m[0].lower() for m in _last_words(text, start, 2)]
    return " ".join(words) if len(words) == 2 and not _digit.search(" ".join(words)) else None


def shape(instance: str) -> str:
    """Letters and digits of an instance as a and 9, the rest as it is."""
    return _letters.sub("a", _digit.sub("9", instance))


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of an instance at a place, each led by its form."""
    last = _last_words(text, start, 2)
    before = [m[0].lower() for m in last]
    if not before or _digit.search(before[-1]):
        return []
    out = ["w " + " ".join(before)] if len(before) == 2 and not _digit.search(before[0]) else []
    mark = text[last[-1].end() : start].strip(" \t\"'")
    if mark in LABELS:
        out.append(f"l {before[-1]} {mark}")
    after = _after.match(text, end)
    if after and not _digit.search(after[1]):
        out.append(f"f {before[-1]} {shape(text[start:end])} {after[1].lower()}")
    return out


def refuted(token: str) -> bool:
    """Is this a number that a fixed pattern covers but its check rejects?"""
    return token.isascii() and token.isdigit() and 12 <= len(token) <= 19


def instances(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple[str, str, bool, bool, int, int]]:
    """(pattern, instance, is a seed, is refuted, start, end) of the seeds and of the other tokens
    with digits."""
    out = [(p, text[a:b].lower(), True, False, a, b) for _, a, b in base for p in patterns_of(text, a, b)]
    if text and _digit.search(text):
        i, taken = 0, sorted((a, b) for _, a, b in base)
        for m in _candidate.finditer(text):
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if m.end() - m.start() >= LEAST and not (i < len(taken) and taken[i][0] < m.end()):
                out += [(p, m[0].lower(), False, refuted(m[0]), m.start(), m.end()) for p in patterns_of(text, m.start(), m.end())]
    return out


def extract(df: DataFrame, text_col: str = "text", base: str = "base", found: str = "found") -> DataFrame:
    """Adds ``base`` (spans of the fixed patterns) and ``found`` (pattern instances)."""
    fields = [T.StructField(base, T.ArrayType(SPAN, False), False), T.StructField(found, T.ArrayType(CANDIDATE, False), False)]

    def run(texts):
        spans = [base_spans(x) for x in texts]
        some = [instances(x, s) for x, s in zip(texts, spans, strict=True)]
        named = lambda rows, names: [[dict(zip(names, r, strict=True)) for r in x] for x in rows]
        return [named(spans, ("kind", "start", "end")), named(some, ("pattern", "instance", "seed", "refuted", "start", "end"))]

    return common.with_columns(df, fields, run, text_col)


def induced(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(instance, score): the noisy or of each instance's patterns; without those that have none, or
    that are refuted."""
    doubt = edges.where("not refuted").join(patterns.where("confidence > 0"), "pattern").groupBy("instance").agg(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999)))).alias("doubt"))
    return doubt.select("instance", (1 - F.exp("doubt")).alias("score"))


def confident(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The patterns of confidence CONFIDENT and more, from edges (pattern, instance, seed, refuted).
    Each generation starts from the seeds and from what the patterns found so far induce, and scores
    for some rounds; the last is the one that finds no more patterns."""
    edges = common.written(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("refuted").alias("refuted")))
    seeds = edges.where("seed").select("instance", F.lit(1.0).alias("score"))
    held, known = seeds, 0
    while True:
        # what is held at a generation's start gives support; the rounds' own scores do not
        own = held.groupBy("instance").agg(F.max("score").alias("held"))
        own = common.written(edges.join(own, "instance", "left").select("pattern", "instance", "refuted", F.coalesce("held", F.lit(0.0)).alias("held")))
        scored = own.withColumn("score", F.col("held"))
        for i in range(rounds):
            patterns = scored.groupBy("pattern").agg(F.sum("score").alias("sum"), F.count("*").alias("n"), F.count_if(F.col("held") >= CONFIDENT).alias("support"))
            patterns = common.written(patterns.select("pattern", (F.col("sum") / (F.col("n") + SMOOTH)).alias("confidence"), "support"))
            if i < rounds - 1:
                # an instance without a scored pattern stays, with 0: it counts against its pattern
                scored = own.join(common.written(induced(own, patterns)), "instance", "left").withColumn("score", F.greatest("held", "score"))
        good = patterns.where((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT))
        # scores and support only rise from one generation to the next, so no pattern is lost
        if (n := good.count()) == known:
            return good
        known, held = n, seeds.unionByName(induced(edges, good))


def _in_order(spans) -> list[dict]:
    names = (*KINDS, "id")
    return [{"kind": names[k], "start": a, "end": b} for a, k, b in sorted((s["start"], names.index(s["kind"]), s["end"]) for s in spans)]


def _in_rows(rows: DataFrame, known: frozenset, base: str, found: str, spans: str, mask: str | None) -> DataFrame:
    """Adds all spans, each row by its own instances; or with mask, masks them in that column, in the
    same pass."""
    sent = rows.sparkSession.sparkContext.broadcast(known)
    rows = rows if known else rows.drop(found)
    at, where = rows.columns.index(base), rows.columns.index(found) if known else None
    field = T.StructField(spans, T.ArrayType(SPAN, False), False)
    kind = common._arrow([field])

    def every(part):
        own = part.column(at).to_pylist()
        some = part.column(where).to_pylist() if known else [()] * len(own)
        for x, y in zip(own, some, strict=True):
            new = {(f["start"], f["end"]) for f in y if not f["seed"] and not f["refuted"] and f["pattern"] in sent.value}
            yield _in_order([*x, *({"kind": "id", "start": a, "end": b} for a, b in new)])

    def run(batches):
        for batch in batches:
            for part in common.steps(batch, mask):
                if mask is None:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(every(part)), kind[0].type)], schema=pa.schema([*part.schema, *kind]))
                else:
                    yield _mask(part, mask, every(part))

    return rows.mapInArrow(run, rows.schema if mask else T.StructType([*rows.schema.fields, field]))


def _mask(part: pa.RecordBatch, text_col: str, spans) -> pa.RecordBatch:
    """A batch with the spans of each row masked in its text."""
    at = part.schema.get_field_index(text_col)
    texts = [x if x is None or not s else masked(x, [(y["kind"], y["start"], y["end"]) for y in s]) for x, s in zip(part.column(at).to_pylist(), spans, strict=True)]
    columns = [*part.columns]
    columns[at] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_arrays(columns, names=part.schema.names)


def _by_join(rows: DataFrame, good: DataFrame, key: str, base: str, found: str, spans: str) -> DataFrame:
    """Adds all spans; the instances meet the patterns, and then their rows."""
    some = rows.where(F.size(found) > 0).select(F.col(key).alias("_key"), F.explode(found).alias("f")).select("_key", "f.*")
    new = some.where("not seed and not refuted").join(good.select("pattern"), "pattern")
    (more,) = common.free(rows, "more")
    new = new.groupBy("_key").agg(F.collect_set(F.struct(F.lit("id").alias("kind"), F.col("start"), F.col("end"))).alias(more)).withColumnRenamed("_key", key)
    order = F.create_map(*[x for i, k in enumerate((*KINDS, "id")) for x in (F.lit(k), F.lit(i))])
    both = F.concat(base, F.coalesce(more, F.array().cast(T.ArrayType(SPAN, False))))
    ordered = F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    plain = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.join(new, key, "left").withColumn(spans, plain).drop(more)


def _spans(df: DataFrame, id_col: str, text_col: str, keep_text: bool, base: str, spans: str, mask: bool = False) -> DataFrame:
    """Adds the base spans and all spans under free names; with mask, masks the text instead."""
    key, found = common.free(df, "key", "found")
    rows = extract(df.withColumn(key, common.row_key(id_col, text_col)), text_col, base, found)
    rows = common.written(rows if keep_text else rows.drop(text_col))
    some = rows.where(F.size(found) > 0).select(F.explode(found).alias("f")).select("f.*")
    good = confident(some.select("pattern", "instance", "seed", "refuted"))
    # patterns in which there is nothing to discover need no look at any row
    good = common.written(good.join(some.where("not seed and not refuted").select("pattern").distinct(), "pattern", "left_semi"))
    size = good.agg(F.count("*").alias("n"), F.sum(F.length("pattern")).alias("chars")).first()
    if size.n <= MOST_PATTERNS and (size.chars or 0) <= MOST_CHARS:
        if not size.n and not mask:
            return rows.withColumn(spans, F.col(base)).drop(key, found)
        known = frozenset(r.pattern for r in good.select("pattern").collect()) if size.n else frozenset()
        return _in_rows(rows.drop(key), known, base, found, spans, text_col if mask else None).drop(found)
    out = _by_join(rows, good, key, base, found, spans).drop(key, found)
    if not mask:
        return out

    def run(batches):
        for batch in batches:
            for part in common.steps(batch, text_col):
                yield _mask(part, text_col, part.column(part.schema.get_field_index(spans)).to_pylist())

    return out.mapInArrow(run, out.schema)


def with_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``base`` and ``spans`` (base and discovered ones, by start, then by kind as listed)."""
    return _spans(df.drop(*[c for c in df.columns if c.lower() in ("spans", "base")]), id_col, text_col, keep_text, "base", "spans")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """A text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, done, end = [], 0, 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[done:a], f"[{kind.upper()}]"]
        end = max(end, b)
        done = end
    return "".join([*out, text[done:]])


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all spans masked in the text; all columns stay, whatever their names."""
    base, spans = common.free(df, "base", "spans")
    return _spans(df, id_col, text_col, True, base, spans, mask=True).select(*df.columns)
