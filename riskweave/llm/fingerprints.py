"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A text's shingles of five words are hashed, and every hash below a fixed share of all values is
kept. Sketches of one share merge by union, and their overlap estimates containment and likeness
between texts of any lengths. A text of which no hash is below the threshold carries its least
hash instead, so that equal short texts still have equal fingerprints.

Defined cases: null and empty texts, or those without words, have an empty sketch; two empty
sketches are alike (1), an empty and another one are not (0); a text of fewer than five words is
one shingle; repeated rows each give a row; an empty table gives an empty table. Ids are whole
numbers, or texts in their own order; null is before all. Of the input only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHINGLE, SHARE = 5, 8
#: Signed numbers in order; the threshold cuts off one of SHARE parts.
LEAST = -(2**63)
THRESHOLD = LEAST + 2**64 // SHARE
#: Parts of the table for each shuffle partition, and for so many code points; parts of one step of
#: the search.
PARTS, PART_CHARS, STEP = 4, 64 << 20, 64
#: Rows of the sample for each part; code points of a text that order rows of one id.
SAMPLE, TIE = 16, 16


def shingle_hashes(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds the hashes of a text's shingles, repeats included."""
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", -1), "")
    df = df.withColumn(f"{out}_w", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(f"{out}_w")
    at = lambda i: F.get(f"{out}_w", i)
    run = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[at(i + k) for k in range(SHINGLE)]))
    few = F.when(n > 0, F.array(F.xxhash64(F.array_join(f"{out}_w", " ")))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(n >= SHINGLE, run).otherwise(few)).drop(f"{out}_w")


def sketch(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds the sketch of a text: sorted distinct hashes below the threshold."""
    df = shingle_hashes(df, text_col, f"{out}_h")
    df = df.withColumn(out, F.array_sort(F.array_distinct(F.filter(f"{out}_h", lambda h: h < THRESHOLD))))
    least = F.array_compact(F.array(F.array_min(f"{out}_h")))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(least)).drop(f"{out}_h")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    under = F.filter(both, lambda h: h < THRESHOLD)
    return F.when(F.size(under) > 0, under).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among those of both."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of a that b has too."""
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits for each hash, joined by commas."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def _fixed(values: list[str]) -> Column:
    """A constant array, of whatever length, as one small expression."""
    return F.split(F.lit(",".join(values)), ",")


def _count_upto(value: Column, heads: list[str], step: int) -> Column:
    """How many of some sorted texts are at most this one: by every step-th first, and so on."""
    levels = [heads]
    while len(levels[0]) > step:
        levels.insert(0, levels[0][::step])
    upto = lambda part: F.size(F.filter(part, lambda h: h <= value))
    n = upto(_fixed(levels[0]))
    for values in levels[1:]:
        base = F.greatest(n - 1, F.lit(0)) * step
        n = base + upto(F.slice(_fixed(values), base + 1, F.lit(step)))
    return n


def _order(df: DataFrame, id_col: str) -> Column:
    """What orders an id; null is before all."""
    if isinstance(df.schema[id_col].dataType, T.StringType):
        return F.coalesce(F.col(id_col), F.lit(""))
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST))


def _rank(df: DataFrame, id_col: str, text_col: str) -> Column:
    """Hexadecimal digits that order rows as their ids do, and rows of one id as their texts begin, so
    that a repeated or null id is cut, too."""
    order = _order(df, id_col)
    if not isinstance(df.schema[id_col].dataType, T.StringType):
        order = F.unhex(F.lpad(F.hex(order.bitwiseXOR(F.lit(LEAST))), 16, "0"))
    # the mark is before all digits
    return F.concat_ws("!", F.hex(order), F.hex(F.substring(F.col(text_col), 1, TIE)))


def with_next(df: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """Adds ``next_<c>`` of the row with the next id (after the last one, the first; equal ids by
    text). The table is cut at quantiles of a sample of its ids, whatever they look like, into parts of
    like size, as many as its code points need; the first rows of a part go to the part before, too, so
    one shuffle by part is enough. Rows that repeat both id and text stand in one part."""
    spark = df.sparkSession
    order, rank = _order(df, id_col), _rank(df, id_col, carried[0])
    chars = df.agg(F.sum(F.length(carried[0]))).first()[0] or 0
    parts = max(PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), chars // PART_CHARS)
    # the rows of least hash are a sample, the same in any partitioning; different rows only, so that rows
    # that are repeated do not take all of it
    luck = F.xxhash64(F.col(id_col), F.col(carried[0]))
    sample = df.select(luck.alias("luck"), rank.alias("rank")).groupBy("luck").agg(F.min("rank").alias("rank")).orderBy("luck").limit(SAMPLE * parts)
    ranks = sorted(r["rank"] for r in sample.collect())
    if not ranks:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    cuts = sorted({ranks[i * len(ranks) // parts] for i in range(parts)})
    # cuts are those of a sample: each part's least is exact
    heads = sorted(r["head"] for r in df.groupBy(_count_upto(rank, cuts, STEP).alias("part")).agg(F.min(rank).alias("head")).collect())
    rows = df.withColumn("_order", order).withColumn("_rank", rank)
    rows = rows.withColumn("_part", _count_upto(F.col("_rank"), heads, STEP))
    place = lambda part, at: F.struct(part.alias("part"), F.lit(at).alias("rank"))
    first, head = F.col("_rank") == heads[0], F.col("_rank") == F.get(_fixed(heads), F.col("_part") - 1)
    places = F.when(first, F.array(place(F.col("_part"), 0), place(F.lit(len(heads)), 2))).when(head, F.array(place(F.col("_part"), 0), place(F.col("_part") - 1, 1))).otherwise(F.array(place(F.col("_part"), 0)))
    rows = rows.withColumn("_place", F.explode(places)).select("*", "_place.part", "_place.rank")
    w = Window.partitionBy("part").orderBy("rank", "_order", *carried[:1])
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).where("rank = 0")
    return rows.drop("_order", "_rank", "_part", "_place", "part", "rank")


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, its edit (the second half replaced by the next text's beginning), the sketches of
    the text, of the edit and of the next text."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = with_next(sketch(docs, "text", "sketch"), "id", ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))).drop("next_text")
    return sketch(docs, "edited", "edited_sketch").withColumnRenamed("id", id_col)
