"""Fill-in-middle training texts, in Spark SQL functions alone.

A text is cut into units (lines, unless told otherwise), two places between units are drawn from
a hash of a seed and the row's id, and prefix, suffix and middle are written one after another
with a sentinel before each: prefix first (``psm``) or suffix first (``spm``). ``restored`` reads
the sentinels back and puts the text together again. Each row is worked on alone: no shuffle, no
Python, whatever the size of the table, and the same row gives the same cuts on every run.

Defined cases: a null text is empty, and an empty text is ``plain``, that is left as it is; so is a
text that holds a sentinel, which could not be told from ours, and a share of the others if ``rate``
is below 100. A null id is hashed as an empty one. Rows that repeat an id are cut alike where their
texts are. Parts may be empty. Input columns stay, but those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def draws(id_col: str, seed: int, n: int) -> list[Column]:
    """Unsigned 32-bit numbers from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(n)]


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, units: str = LINES, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Adds ``n`` (units of the text), ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (null if plain) and ``output``. Of 100 texts about ``rate`` are rearranged, of
    those about ``spm`` with the suffix first. The pattern of the units must match every character."""
    if {id_col.lower(), text_col.lower()} & set(OUTPUTS):
        raise ValueError("the id or the text is named like an output")
    df = df.drop(*[c for c in df.columns if c.lower() in OUTPUTS])
    kept = df.columns
    text, parts, h, a, b, form, pieces = (*common.free(df, "_text", "_parts", "_draws", "_first", "_second", "_form", "_pieces"),)
    t, u, n = F.col(text), F.col(parts), F.size(parts)
    held = F.lit(False)
    for s in SENTINELS:
        held = held | t.contains(s)
    # each step is a column of its own, so that nothing dear is written out twice
    out = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn(parts, F.regexp_extract_all(t, F.lit(units), F.lit(0))).withColumn(h, F.array(*draws(id_col, seed, 4)))
    x, y = (F.col(h)[k] % (n + 1) for k in (0, 1))
    out = out.withColumn(a, F.least(x, y).cast("int")).withColumn(b, F.greatest(x, y).cast("int"))
    plain = (t == "") | held | (F.col(h)[2] % 100 >= rate)
    out = out.withColumn(form, F.when(plain, "plain").when(F.col(h)[3] % 100 < spm, "spm").otherwise("psm"))
    cut = lambda start, length: F.array_join(F.slice(u, start, length), "")
    a, b = F.col(a), F.col(b)
    out = out.withColumn(pieces, F.when(F.col(form) != "plain", F.array(cut(F.lit(1), a), cut(a + 1, b - a), cut(b + 1, n - b))))
    prefix, middle, suffix = (F.col(pieces)[k] for k in range(3))
    output = (
        F.when(F.col(form) == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col(form) == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(t)
    )
    return out.select(*kept, n.cast("long").alias("n"), F.col(form).alias("form"), F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made from. No sentinel stands in the pieces, and none can arise
    where a piece meets a sentinel, so splitting at sentinels gives the pieces back."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    piece = F.split(output, "|".join(SENTINELS))
    at = lambda k: F.get(piece, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
