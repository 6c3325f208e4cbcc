"""Secret scans: fixed patterns, and candidates of high entropy, in DataFrame functions only.

Fixed patterns find assignments of secrets, access keys and long hexadecimal strings. Beyond them,
runs of 20 and more characters of letters, digits and ``+/_-`` with a digit are candidates. A window
slides over a candidate; the counts of its characters and the sum of c log2 c change by the
character that enters and the one that leaves, which gives each window's Shannon entropy. A
candidate whose best window reaches the threshold of its character class is a span of kind
``entropy``, unless fixed spans cover it already or it is on the allow-list (UUIDs, plain numbers
and dates, paths, runs and series, documentation samples). A candidate that goes beyond a fixed span
is reported beside it.

Spans count code points, the end is exclusive. The fixed patterns take the leftmost matches, and
matches too short for a kind are dropped. Every pattern takes time in proportion to the text.
Defined cases: null and empty texts have no spans; repeated rows each give a row; an empty table
gives an empty table. All input columns stay, but those named ``base`` or ``spans`` are replaced;
inner columns take names that are free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "api_?key")
WINDOW = 20
#: Least bits of the best window: hexadecimal; two, and three, of lower case, upper case, digits. Of two
#: classes that alternate a window of random keys reaches 3.4 almost always, and 4.0 seldom.
HEX_BITS, TWO_BITS, MIXED_BITS, THREE_BITS = 3.0, 4.0, 3.4, 3.7
#: Letters and digits that alternate without a separator, which slugs and names with numbers do not; in
#: upper case, where those are rare, less will do (base32 has few digits).
MIXED = "[a-z][0-9]+[a-z]+[0-9]|[0-9][a-z]+[0-9]+[a-z]|[A-Z][0-9]+[A-Z]|[0-9][A-Z]+[0-9]"

_either = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in WORDS)
PATTERNS = {
    "assign": rf"({_either})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    # maximal runs only, so a least length in the pattern drops what it would drop after it
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Of a path every part but the last is a word, or a number, in plain spelling.
_part = r"(?:[A-Z]?[a-z]+[0-9]{0,3}(?:[_-](?:[A-Z]?[a-z]+|[0-9]+))*|[0-9]{1,4})"
#: Each is held against a whole candidate, so that a long key is not let through for a part of it; samples
#: alone count anywhere, which chance hardly makes.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_-]+$",
    r"^.{0,24}(.)\1{5,}.{0,24}$",
    r"(?i)example|sample|placeholder|changeme|dummy|0123456789|abcdefgh|deadbeef",
    r"^[^0-9]+(?:[0-9]{1,4})?$",
    r"^//",
    r"^[a-z0-9_-]*(?:/[a-z0-9_-]+){2,}/?$",
    rf"^/?(?:{_part}/){{2,}}[A-Za-z0-9_-]*$",
)
_BLOCK = 256


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def before(lengths: Column) -> Column:
    """For each entry of an array the sum of those before it, in blocks so that a long array costs
    little more than its length."""
    blocks = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(_BLOCK))).otherwise(_empty("int"))
    start = lambda t: F.struct(t.alias("t"), _empty("int").alias("x"))
    push = lambda s, n: F.struct((s["t"] + n).alias("t"), F.array_append(s["x"], s["t"]).alias("x"))
    part = lambda b: F.slice(lengths, b + 1, F.lit(_BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda s, n: s + n))
    heads = F.aggregate(sums, start(F.lit(0)), push)["x"]
    pairs = F.arrays_zip(blocks.alias("b"), heads.alias("h"))
    return F.flatten(F.transform(pairs, lambda p: F.aggregate(part(p["b"]), start(p["h"]), push)["x"]))


def located(df: DataFrame, text: str, name: str, pattern: str, group: int = 0) -> DataFrame:
    """Adds ``name``: array of (start, end, value, group) of a pattern's matches. Matches and the
    gaps between them give the places; texts without a match skip the work."""
    some = F.col(text).rlike(pattern)
    raw = F.lit(pattern)
    df = df.withColumn(f"{name}_m", F.when(some, F.regexp_extract_all(text, raw, F.lit(0))).otherwise(_empty("string")))
    got = F.size(f"{name}_m") > 0
    df = df.withColumn(f"{name}_g", F.when(got, F.split(text, pattern, -1)).otherwise(_empty("string")))
    df = df.withColumn(f"{name}_v", F.when(got, F.regexp_extract_all(text, raw, F.lit(group))).otherwise(_empty("string")) if group else F.col(f"{name}_m"))
    gaps = F.transform(F.slice(f"{name}_g", 1, F.size(f"{name}_m")), F.length)
    df = df.withColumn(f"{name}_l", F.transform(f"{name}_m", F.length)).withColumn(f"{name}_s", gaps)
    df = df.withColumn(f"{name}_p", before(F.zip_with(f"{name}_s", f"{name}_l", lambda a, b: a + b)))
    zipped = F.arrays_zip(*[F.col(f"{name}_{c}").alias(c) for c in "pslmv"])
    spot = F.transform(zipped, lambda z: F.struct((z["p"] + z["s"]).alias("start"), (z["p"] + z["s"] + z["l"]).alias("end"), z["m"].alias("value"), z["v"].alias("part")))
    return df.withColumn(name, spot).drop(*[f"{name}_{c}" for c in "mgvlsp"])


def best_window(value: Column, window: int = WINDOW) -> Column:
    """The largest entropy, in bits, of a string's windows (ASCII; at least a window long)."""
    codes = F.transform(F.split(value, ""), F.ascii)
    weigh = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(0.0)
    none = F.lit(-1)
    state = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("s"), F.lit(9e9).alias("least"), F.lit(0).alias("i"))
    pairs = F.zip_with(codes, F.concat(F.array_repeat(none, window), codes), lambda a, b: F.struct(F.coalesce(a, none).alias("a"), b.alias("b")))

    def step(s, p):
        # the last entries of the shifted series have no partner
        at = lambda c: F.when(c >= 0, F.element_at(s["n"], c + 1)).otherwise(0).cast("double")
        came, left = at(p["a"]), at(p["b"])
        same = p["a"] == p["b"]
        gain = F.when(same | (p["a"] < 0), 0.0).otherwise(weigh(came + 1) - weigh(came))
        loss = F.when(same | (p["b"] < 0) | (p["a"] < 0), 0.0).otherwise(weigh(left) - weigh(left - 1))
        total = s["s"] + gain - loss
        n = F.when(same | (p["a"] < 0), s["n"]).otherwise(F.transform(s["n"], lambda c, k: c + (k == p["a"]).cast("int") - (k == p["b"]).cast("int")))
        full = (s["i"] + 1 >= window) & (p["a"] >= 0)
        return F.struct(n.alias("n"), total.alias("s"), F.when(full, F.least(s["least"], total)).otherwise(s["least"]).alias("least"), (s["i"] + 1).alias("i"))

    import math

    return F.aggregate(pairs, state, step, lambda s: F.lit(math.log2(window)) - s["least"] / window)


def _secret(value: Column) -> Column:
    kinds = sum((F.when(value.rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    least = F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), HEX_BITS).when(kinds > 2, THREE_BITS).when(value.rlike(MIXED), MIXED_BITS).otherwise(TWO_BITS)
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | value.rlike(p)
    return value.rlike("[0-9]") & ~allowed & (best_window(value) >= least)


def _outside(candidates: Column, fixed: Column) -> Column:
    """The candidates that no run of overlapping fixed spans covers. Both are in order of their
    starts, so the fixed spans are first joined into runs."""
    span = "struct<start:int,end:int>"
    start = F.struct(_empty(span).alias("done"), F.lit(None).cast(span).alias("now"))
    own = lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))

    def join(s, b):
        over = b["start"] <= s["now"]["end"]
        longer = F.struct(s["now"]["start"].alias("start"), F.greatest(s["now"]["end"], b["end"]).alias("end"))
        done = F.when(s["now"].isNull() | over, s["done"]).otherwise(F.array_append(s["done"], s["now"]))
        return F.struct(done.alias("done"), F.when(s["now"].isNull(), own(b)).when(over, longer).otherwise(own(b)).alias("now"))

    joined = F.aggregate(fixed, start, join, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["now"])))
    return F.when(F.size(candidates) > 0, F.filter(candidates, lambda m: ~F.exists(joined, lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])))).otherwise(candidates)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (kind, start, end) by start, then by kind as listed."""
    df = df.drop(*[c for c in df.columns if c.lower() in ("base", "spans")])
    columns, names = df.columns, (*KINDS, "entropy")
    text, fixed, all_, *places = common.free(df, "s_text", "s_base", "s_all", *[f"s_{k}" for k in names])
    at = dict(zip(names, places, strict=True))
    df = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    for name, pattern in PATTERNS.items():
        df = located(df, text, at[name], pattern, 2 if name == "assign" else 0)
    df = df.withColumn(at["assign"], F.filter(at["assign"], lambda m: F.length(m["part"]) >= 6))
    df = located(df, text, at["entropy"], CANDIDATE)
    ranked = lambda name: F.transform(at[name], lambda m: F.struct(m["start"].alias("start"), F.lit(names.index(name)).alias("rank"), m["end"].alias("end")))
    df = df.withColumn(fixed, F.array_sort(F.concat(*[ranked(k) for k in KINDS])))
    df = df.withColumn(at["entropy"], F.filter(_outside(F.col(at["entropy"]), F.col(fixed)), lambda m: _secret(m["value"])))
    df = df.withColumn(all_, F.array_sort(F.concat(fixed, ranked("entropy"))))
    kind = F.array(*[F.lit(k) for k in names])
    plain = lambda c: F.transform(c, lambda s: F.struct(F.element_at(kind, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return df.select(*columns, plain(fixed).alias("base"), plain(all_).alias("spans"))
