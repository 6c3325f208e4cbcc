"""The trie of conversations' prefixes, by preorder intervals.

Every sequence of first turns that a conversation starts with is a node; conversations that start
alike share nodes, so what a trie stores once is what caching or packing of prefixes saves.

* A turn is two 64-bit hashes of its role and text and the text's length; texts are not moved.
* A prefix of d turns is named by the exclusive or of hashes of (depth, turn), 128 bits and the depth,
  which are running sums along a conversation. Conversations are cut into chunks by a range
  partitioning of their turns, sums of chunks come before sums within them, so a conversation of any
  length is spread over the cluster.
* Nodes with the same members are a chain: they lie one below another and have one least member, so
  (least member, number of members) names a chain. A chain's path is the list of the names of the
  chains' first nodes from the root, found by doubling. Paths, turns being ordered by hash, sort in
  preorder: a node stands before its subtree. An opening key (the path) and a closing key (the path
  and a byte that sorts behind every continuation) give each chain the interval of its subtree, and
  leaves, nodes and savings of a subtree are differences of one distributed prefix sum over the sorted
  keys. Within a chain, running lengths give the rest. All paths of the chains together have
  at most 17 bytes for each turn, since no path has more chains than its least member has turns.
* Ids of the conversations that end at a node are hashed in ascending order from pieces of PIECE ids,
  as a stream, whatever their number.

Defined cases: a null role or text is empty; turns of one number stand in the order of their hashes,
a null number first, and repeated rows are repeated turns; rows without a conversation id belong to
none and are left out; a table without conversations has no nodes. Only the four columns are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PIECE, ROUNDS = 512, 64
BLOCK, MOST = 100, 6
NODE = ["d", "k1", "k2"]
CHAIN = ["conv", "n"]
BEFORE = (Window.unboundedPreceding, -1)


def _chunks(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns as (c, part, i, h1, h2, chars): the i-th of conversation c in chunk part."""
    what = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text)]
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("c"),
        F.col(turn).alias("t"),
        F.xxhash64(*what).alias("h1"),
        F.xxhash64(F.lit(2), *what).alias("h2"),
        F.length(what[1]).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("u"),
    )
    # rows that are alike in all else are told apart, so that chunks can cut between them
    rows = rows.repartitionByRange("c", "t", "h1", "h2", "u").withColumn("part", F.spark_partition_id()).drop("u")
    within = Window.partitionBy("c", "part").orderBy("t", "h1", "h2")
    return common.written(rows).withColumn("i", F.row_number().over(within)).drop("t")


def rebuilt(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int | None = BLOCK, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Turns (c, part, d, h1, h2, chars) at their depths and all conversations (c). With a block, a
    conversation c starts with the first h turns of the first of its block, c - c % block, instead of
    its own, h being crc32(c) % most."""
    rows = _chunks(turns, conv_id, turn, role, text)
    before = Window.partitionBy("c").orderBy("part").rowsBetween(*BEFORE)
    chunks = rows.groupBy("c", "part").agg(F.count("*").alias("n"))
    chunks = common.written(chunks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))))
    convs = chunks.select("c").distinct()
    at = (F.col("offset") + F.col("i")).alias("d")
    if block is None:
        return rows.join(chunks, ["c", "part"]).select("c", "part", at, "h1", "h2", "chars"), convs
    head = rows.where((F.col("c") % block == 0) & (F.col("i") < most)).join(chunks, ["c", "part"]).select("c", F.struct(at, "h1", "h2", "chars").alias("x")).where(F.col("x.d") < most)
    head = head.groupBy(F.col("c").alias("b")).agg(F.array_sort(F.collect_list("x")).alias("head"))
    taken = F.crc32(F.col("c").cast("string")) % most
    convs = convs.withColumn("b", F.col("c") - F.col("c") % block).join(head, "b", "left")
    first = F.when(taken > 0, F.slice("head", F.lit(1), F.greatest(taken, F.lit(1)).cast("int")))
    convs = common.written(convs.select("c", F.coalesce(first, F.array().cast(head.schema["head"].dataType)).alias("head")))
    shift = chunks.join(convs.select("c", F.size("head").alias("m")), "c").select("c", "part", "offset", (F.col("m") - taken).alias("shift"))
    own = rows.join(shift, ["c", "part"]).where(at > taken).select("c", "part", (at + F.col("shift")).alias("d"), "h1", "h2", "chars")
    given = convs.select("c", F.explode("head").alias("x")).select("c", F.lit(-1).alias("part"), "x.d", "x.h1", "x.h2", "x.chars")
    return own.unionByName(given), convs.select("c")


def _prefixes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each turn with the names of its prefix (k1, k2) and of the one before (p1, p2) and the running
    length s; and each conversation's whole prefix (d, k1, k2)."""
    rows = common.written(rows.select("c", "part", "d", "chars", F.xxhash64("d", "h1", "h2").alias("g1"), F.xxhash64(F.lit(2), "d", "h2", "h1").alias("g2")))
    run = Window.partitionBy("c", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("part").rowsBetween(*BEFORE)
    chunk = common.written(rows.groupBy("c", "part").agg(F.count("*").alias("n"), F.bit_xor("g1").alias("a1"), F.bit_xor("g2").alias("a2"), F.sum("chars").alias("length")))
    offset = chunk.select("c", "part", *[F.coalesce(f.over(before), F.lit(0)).alias(x) for f, x in ((F.bit_xor("a1"), "o1"), (F.bit_xor("a2"), "o2"), (F.sum("length"), "os"))])
    sums = rows.select("c", "part", "d", "chars", "g1", "g2", F.bit_xor("g1").over(run).alias("x1"), F.bit_xor("g2").over(run).alias("x2"), F.sum("chars").over(run).alias("s"))
    xor = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    out = sums.join(offset, ["c", "part"]).select("c", "d", "chars", "g1", "g2", xor("x1", "o1").alias("k1"), xor("x2", "o2").alias("k2"), (F.col("s") + F.col("os")).alias("s"))
    out = out.select("c", "d", "chars", "s", "k1", "k2", xor("k1", "g1").alias("p1"), xor("k2", "g2").alias("p2"))
    return out, chunk.groupBy("c").agg(F.sum("n").alias("d"), F.bit_xor("a1").alias("k1"), F.bit_xor("a2").alias("k2"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """For each node, the digest of the ids that end there, ascending and joined by commas."""
    rows = ends.repartitionByRange(*NODE, "c").withColumn("part", F.spark_partition_id())
    lists = rows.groupBy("part", *NODE).agg(F.array_sort(F.collect_list("c")).alias("ids"))
    join = lambda i: F.array_join(F.transform(F.slice("ids", i * PIECE + 1, PIECE), lambda x: x.cast("string")), ",")
    pieces = lists.select(*NODE, "part", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / PIECE).cast("int")), join)).alias("at", "piece"))
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "part", "at").select(*NODE, "piece")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            for *node, piece in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if node != now:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(piece.encode())
                else:
                    digest.update(f",{piece}".encode())
            yield _rows(done)
        if now:
            yield _rows([(*now, digest.hexdigest())])

    return pieces.mapInArrow(run, "d long, k1 long, k2 long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[*NODE, "ends_sha256"])


def _paths(chains: DataFrame) -> DataFrame:
    """Each chain's path: the names of the chains from below the root's to it."""
    half = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    name = F.concat(F.lit(b"\0"), half("k1"), half("k2"))
    # the root's chain alone has all conversations
    most = chains.agg(F.max("n")).first()[0] or 0
    up = lambda c: F.when(F.col("pn") < most, F.col(c)).alias(f"a{c[1:]}")
    known = common.written(chains.select(*CHAIN, F.when(F.col("d0") > 0, name).otherwise(F.lit(b"")).alias("path"), up("pconv"), up("pn")))
    for _ in range(ROUNDS):
        ready, rest = known.where("an is null"), known.where("an is not null")
        if rest.isEmpty():
            return ready.select(*CHAIN, "path")
        above = known.select(F.col("conv").alias("aconv"), F.col("n").alias("an"), F.col("path").alias("apath"), F.col("aconv").alias("bconv"), F.col("an").alias("bn"))
        rest = rest.join(above, ["aconv", "an"]).select(*CHAIN, F.concat("apath", "path").alias("path"), F.col("bconv").alias("aconv"), F.col("bn").alias("an"))
        known = common.written(ready.unionByName(rest))
    raise RuntimeError("paths did not settle")


def _intervals(chains: DataFrame, paths: DataFrame) -> DataFrame:
    """Each chain's start in preorder and what its subtree holds: nodes, leaves, savings."""
    values = ["nodes", "leaves", "saved"]
    one = chains.join(paths, CHAIN).select(*CHAIN, "path", (F.col("d1") - F.col("d0") + 1).alias("nodes"), F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n") - 1) * (F.col("s1") - F.col("s0"))).alias("saved"))
    ends = F.array(F.struct(F.lit(False).alias("close"), F.col("path").alias("key"), *values), F.struct(F.lit(True).alias("close"), F.concat("path", F.lit(b"\1")).alias("key"), *[F.lit(0).cast("long").alias(v) for v in values]))
    keys = one.select(*CHAIN, F.explode(ends).alias("x")).select(*CHAIN, "x.*").repartitionByRange("key")
    keys = common.written(keys.withColumn("part", F.spark_partition_id()))
    # one row for each partition, so a single task and a broadcast hold them all
    parts = keys.groupBy("part").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy("part").rowsBetween(*BEFORE)
    parts = parts.select("part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"o_{v}") for v in values])
    run = Window.partitionBy("part").orderBy("key").rowsBetween(*BEFORE)
    sums = keys.select(*CHAIN, "close", "part", *[F.coalesce(F.sum(v).over(run), F.lit(0)).alias(v) for v in values])
    sums = sums.join(F.broadcast(parts), "part").select(*CHAIN, "close", *[(F.col(v) + F.col(f"o_{v}")).alias(v) for v in values])
    sign: Column = F.when(F.col("close"), 1).otherwise(-1)
    start = F.sum(F.when(~F.col("close"), F.col("nodes"))).alias("start")
    return sums.groupBy(*CHAIN).agg(start, *[F.sum(sign * F.col(v)).alias(f"t_{v}") for v in values])


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations (c) whose turns (c, part, d, h1, h2, chars) stand at depths from 1,
    in chunks of ascending depth."""
    prefixes, whole = _prefixes(rows)
    ends = convs.join(whole, "c", "left").select("c", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in NODE])
    nodes = prefixes.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("c").alias("conv"), *[F.first(x).alias(x) for x in ("chars", "s", "p1", "p2")])
    zero = [F.lit(0).cast("long").alias(x) for x in (*NODE, "chars", "s", "p1", "p2")]
    root = convs.agg(F.count("*").alias("n"), F.min("c").alias("conv")).where("n > 0").select("*", *zero)
    nodes = nodes.withColumn("d", F.col("d").cast("long")).unionByName(root)
    nodes = common.written(nodes.join(_end_digests(ends), NODE, "left"))

    head = F.min(F.struct(*NODE, "p1", "p2")).alias("head")
    chains = nodes.groupBy(*CHAIN).agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min(F.col("s") - F.col("chars")).alias("s0"), F.max("s").alias("s1"), head)
    chains = chains.select(*CHAIN, "d0", "d1", "s0", "s1", "head.k1", "head.k2", "head.p1", "head.p2", (F.col("d0") - 1).alias("pd"))
    above = nodes.select(F.col("d").alias("pd"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("pconv"), F.col("n").alias("pn"))
    chains = common.written(chains.join(above, ["pd", "p1", "p2"], "left").drop("pd", "p1", "p2"))
    kids = chains.groupBy(F.col("pconv").alias("conv"), F.col("pn").alias("n")).agg(F.count("*").alias("kids"))
    chains = common.written(chains.join(kids, CHAIN, "left").withColumn("kids", F.coalesce("kids", F.lit(0))))
    spans = common.written(chains.drop("k1", "k2").join(_intervals(chains, _paths(chains)), CHAIN))

    out = nodes.join(spans, CHAIN)
    d, d0 = F.col("d"), F.col("d0")
    return out.select(
        F.col("conv").alias("conv_id"),
        d.alias("depth"),
        F.when(d == d0, F.col("pconv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(d == F.col("d1"), F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        F.col("t_leaves").alias("n_leaves"),
        (F.col("t_saved") - (F.col("n") - 1) * (F.col("s") - F.col("chars") - F.col("s0"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        (F.col("start") + d - d0).alias("preorder"),
        (F.col("start") + F.col("t_nodes")).alias("subtree_end"),
    )


def prefix_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int | None = BLOCK, most: int = MOST) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (of the conversations as they are, without a
    block): least member and depth, parent's least member, members, children, leaves and saved code
    points of the subtree, digest of the ids that end there, and the interval
    [preorder, subtree_end) of the subtree in preorder."""
    return trie(*rebuilt(turns, conv_id, turn, role, text, block, most))
