"""Connected components by repeated contraction.

Each round every node moves to its least neighbour (twice, so chains shorten), edges follow,
and edges inside a node go. The order is by value first and then by value and by hash in turn,
so neither stars nor sorted chains need many rounds. Each round is a written table; nothing
but the number of edges left comes to the driver. Joins meet a unique side, so a node with
very many edges is a skewed join that adaptive execution splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 64


def labels(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the edges (a, b): one label for each component."""
    edges = common.written(edges.where("a <> b").distinct())
    out = None
    for i in range(ROUNDS):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        rank = (lambda c: F.col(c)) if i % 2 == 0 or i < 2 else (lambda c, n=i: F.xxhash64(F.col(c), F.lit(n)))
        best = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("r"), F.col("v").alias("x"))).alias("m"), F.first(rank("u")).alias("own"))
        step = common.written(best.select("u", F.when(F.col("m.r") < F.col("own"), F.col("m.x")).otherwise(F.col("u")).alias("m")))
        far = step.alias("p").join(step.select(F.col("u").alias("m"), F.col("m").alias("m2")).alias("q"), "m", "left")
        step = common.written(far.select("u", F.coalesce("m2", "m").alias("m")))
        moved = edges.join(step.select(F.col("u").alias("a"), F.col("m").alias("na")), "a").join(step.select(F.col("u").alias("b"), F.col("m").alias("nb")), "b")
        edges = common.written(moved.where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
        if out is None:
            out = step.select(F.col("u").alias("node"), F.col("m").alias("label"))
        else:
            out = out.join(step.select(F.col("u").alias("label"), F.col("m").alias("next")), "label", "left")
            out = common.written(out.select("node", F.coalesce("next", "label").alias("label")))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if out is None else out
