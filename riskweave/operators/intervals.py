"""Joins of places with ranges of lines by equality.

A range is cut into blocks whose lengths are powers of two, at most two of each length; a place lies in
one block of each length. So a place meets a range that holds it in exactly one block, without a
comparison and without a pair too many. Blocks also say which few rows can matter, so that a file
with very many ranges or places is no product of the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks are no longer than 2 ** TOP.
TOP = 31
KEYS = ["level", "block"]


def blocks(start: Column, end: Column) -> Column:
    """(level, block) of a range with both ends in it: block b of a level k holds [b * 2**k, (b + 1) * 2**k)."""
    a, b = start.cast("bigint"), end.cast("bigint") + 1

    def at(k):
        low, high = F.ceil(a / F.pow(F.lit(2), k)).cast("bigint"), F.floor(b / F.pow(F.lit(2), k)).cast("bigint")
        some = low < high
        take = lambda cond, block: F.when(some & cond, F.struct(k.cast("int").alias("level"), block.alias("block")))
        return F.array_compact(F.array(take(F.pmod(low, F.lit(2)) == 1, low), take(F.pmod(high, F.lit(2)) == 1, high - 1)))

    levels = F.sequence(F.lit(0), F.least(F.lit(TOP), F.floor(F.log2(F.greatest(b - a, F.lit(1)))).cast("int") + 1))
    return F.when(a < b, F.flatten(F.transform(levels, at))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))


def in_blocks(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows once for each block of their range."""
    return df.withColumn("_b", F.explode(blocks(start, end))).select("*", "_b.level", "_b.block").drop("_b")


def top(df: DataFrame, start: Column, end: Column) -> int:
    """The longest blocks that ranges of a table are cut into."""
    longest = df.agg(F.max(end.cast("bigint") - start.cast("bigint") + 1)).first()[0]
    return min(TOP, int(longest or 1).bit_length())


def at_place(df: DataFrame, place: Column, most: int) -> DataFrame:
    """Rows once for each level up to the longest, in the block that holds a place."""
    spot = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.struct(k.alias("level"), F.floor(place.cast("bigint") / F.pow(F.lit(2), k)).cast("bigint").alias("block")))
    return df.where(place.isNotNull()).withColumn("_b", F.explode(spot)).select("*", "_b.level", "_b.block").drop("_b")


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first rows of each block."""
    w = Window.partitionBy(*keys, *KEYS).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
