"""Paths found from both ends against a search from one."""

import random

from pyspark.sql import functions as F

from riskweave.operators import graph


def one_way(edges, pairs, hops):
    found = graph.reach(edges, pairs.select(F.col("source").alias("node")).distinct(), hops)
    return pairs.join(found, (pairs.source == found.start) & (pairs.target == found.node)).select("source", "target", "hops", "path")


def test_both_ends_find_what_one_finds(spark):
    r = random.Random(8)
    node = lambda: f"n{r.randrange(40)}"
    edges = spark.createDataFrame([(node(), node(), r.randrange(10**6)) for _ in range(90)] + [("hub", f"n{i}", i) for i in range(40)], "caller string, callee string, edge_id long")
    pairs = spark.createDataFrame([(node(), node()) for _ in range(150)] + [("hub", "n3"), ("hub", "hub"), ("gone", "gone"), ("gone", "n1"), (None, "n1"), ("n1", None)] + [("n1", "n2")] * 2, "source string, target string")
    for hops in (0, 1, 2, 5, 6):
        rows = lambda df: sorted((x.source, x.target, x.hops, x.path) for x in df.collect())
        got, want = rows(graph.find_path(edges, pairs, hops)), rows(one_way(edges, pairs, hops))
        assert got == want and len(want) >= (2 if hops == 0 else 3)


def test_held_rows_stay_within_half_the_hops(spark):
    # of a tree with ten children a node, six hops would hold a million nodes for a source
    edges = spark.range(1, 4000).select(F.concat(F.lit("t"), F.floor((F.col("id") - 1) / 10)).alias("caller"), F.concat(F.lit("t"), F.col("id")).alias("callee"), F.col("id").alias("edge_id"))
    pairs = spark.createDataFrame([("t0", "t3999"), ("t0", "t1111"), ("t1", "t0")], "source string, target string")
    held = graph.reach(edges, pairs.select(F.col("source").alias("node")).distinct(), 2).count()
    assert held < 250
    assert sorted((x.target, x.hops) for x in graph.find_path(edges, pairs, 4).collect()) == [("t1111", 4), ("t3999", 4)]
