"""Call graphs: edges from call sites, degrees, and bounded searches by frontier joins.

An edge is (caller, callee, edge_id); nodes are ``file::symbol``. Searches keep a visited set and
take one join for each hop. Among shortest paths the one of the least edge ids is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Call sites (caller_file, enclosing, callee_name, callee_object, line) to definitions: in the
    same file, through an import of the name, through an imported object, or by a name that only
    one other file defines. The first that holds gives resolution and confidence.
    symbols: (file, name, kind); imports: (file, name, target)."""
    defined = symbols.select(F.col("file").alias("d_file"), F.col("name").alias("d_name")).distinct()
    methods = symbols.where(F.col("kind").isin("method", "function")).select(F.col("file").alias("m_file"), F.col("name").alias("m_name")).distinct()
    by_name = imports.groupBy(F.col("file").alias("i_file"), F.col("name").alias("i_name")).agg(F.max("target").alias("target"))
    homes = defined.groupBy("d_name").agg(F.count("*").alias("homes"), F.min("d_file").alias("low"), F.max("d_file").alias("high"))
    out = calls.join(defined.withColumn("own", F.lit(True)), (calls.caller_file == F.col("d_file")) & (calls.callee_name == F.col("d_name")), "left").drop("d_file", "d_name")
    out = out.join(by_name, (F.col("caller_file") == F.col("i_file")) & (F.col("callee_name") == F.col("i_name")), "left").drop("i_file", "i_name").withColumnRenamed("target", "by_import")
    out = out.join(defined.withColumn("exists", F.lit(True)), (F.col("by_import") == F.col("d_file")) & (F.col("callee_name") == F.col("d_name")), "left").drop("d_file", "d_name")
    out = out.join(by_name, (F.col("caller_file") == F.col("i_file")) & (F.col("callee_object") == F.col("i_name")), "left").drop("i_file", "i_name").withColumnRenamed("target", "by_object")
    out = out.join(methods.withColumn("has", F.lit(True)), (F.col("by_object") == F.col("m_file")) & (F.col("callee_name") == F.col("m_name")), "left").drop("m_file", "m_name")
    out = out.join(homes, F.col("callee_name") == F.col("d_name"), "left").drop("d_name")
    # no tier before found it in this file, so every home is another file
    kind = lambda t, f, r, c: F.when(t, F.struct(f.alias("callee_file"), F.lit(r).alias("resolution"), F.lit(c).alias("confidence")))
    hit = F.coalesce(
        kind(F.col("own"), F.col("caller_file"), "direct", 1.0),
        kind(F.col("by_import").isNotNull() & F.col("exists"), F.col("by_import"), "import", 0.9),
        kind(F.col("by_import").isNotNull(), F.col("by_import"), "import", 0.5),
        kind(F.col("has"), F.col("by_object"), "method", 0.7),
        kind(F.col("homes") == 1, F.col("low"), "heuristic", 0.3),
    )
    caller = F.coalesce("enclosing", F.lit("<module>"))
    return out.withColumn("hit", hit).where("hit is not null").select("caller_file", caller.alias("caller_symbol"), F.col("line").alias("caller_line"), "hit.callee_file", F.col("callee_name").alias("callee_symbol"), "hit.resolution", "hit.confidence")


def call_graph(edges: DataFrame) -> DataFrame:
    """The edges of a graph from its calls: how many join two nodes, and the first of them."""
    return edges.groupBy("caller", "callee").agg(F.count("*").alias("calls"), F.min("edge_id").alias("first_edge"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("callee").agg(F.count("*").alias("calls"))


def boosts_by_degree(edges: DataFrame, least: int = 3) -> DataFrame:
    """Files with some callers gain twice their number."""
    return in_degree(edges).where(F.col("calls") >= least).select(F.col("callee").alias("file_path"), (F.col("calls") * 2.0).alias("boost"))


def reach(edges: DataFrame, starts: DataFrame, hops: int, backward: bool = False, onward: bool = False) -> DataFrame:
    """(start, node, hops, path, edges): every node within so many hops of each start, by a shortest path.
    starts has one column, node; the path holds the nodes, start first. Of shortest paths the one of
    the least edges counts, from the start on, or with onward in the direction of the calls."""
    a, b = ("callee", "caller") if backward else ("caller", "callee")
    steps = edges.groupBy(F.col(a).alias("at"), F.col(b).alias("to")).agg(F.min("edge_id").alias("edge_id"))
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.array("node").alias("path"), F.array().cast("array<bigint>").alias("edges")).distinct()
    front = seen = cut(seen)
    steps = cut(steps)
    for i in range(1, hops + 1):
        if front.isEmpty():
            break
        grown = front.join(steps, front.node == steps.at).select("start", F.col("to").alias("node"), F.lit(i).alias("hops"), F.array_append("path", F.col("to")).alias("path"), (F.array_prepend if onward else F.array_append)("edges", F.col("edge_id")).alias("edges"))
        first = grown.withColumn("_r", F.row_number().over(Window.partitionBy("start", "node").orderBy("edges"))).where("_r = 1").drop("_r")
        # without the cut every hop would compute all hops before it again
        front = cut(first.join(seen.select("start", "node"), ["start", "node"], "left_anti").select(*seen.columns))
        seen = seen.unionByName(front)
    return seen


def find_path(edges: DataFrame, pairs: DataFrame, hops: int = 6) -> DataFrame:
    """(source, target, hops, path) of the pairs that a path of so many calls joins; a node reaches
    itself by no call.

    The search goes half the way from both ends. On a shortest path every node is as far from the source
    and from the target as the path says, so a path of each length is looked for at one node of it, its
    middle; what is held is what lies within half the hops of an end."""
    ahead = (hops + 1) // 2
    ends = lambda c: pairs.select(F.col(c).alias("node")).where("node is not null").distinct()
    out = reach(edges, ends("source"), ahead).select(F.col("start").alias("source"), "node", F.col("hops").alias("out_hops"), F.col("path").alias("out_path"), F.col("edges").alias("out_edges"))
    back = reach(edges, ends("target"), hops - ahead, backward=True, onward=True).select(F.col("start").alias("target"), "node", F.col("hops").alias("back_hops"), F.col("path").alias("back_path"), F.col("edges").alias("back_edges"))
    # the middle of a path of n calls is the node after the first half of them, rounded up
    even = (F.col("out_hops") - F.col("back_hops")).isin(0, 1)
    met = pairs.distinct().join(out, "source").join(back, ["target", "node"]).where(even)
    total = F.col("out_hops") + F.col("back_hops")
    path = F.concat("out_path", F.slice(F.reverse("back_path"), F.lit(2), F.greatest(F.size("back_path") - 1, F.lit(0))))
    best = met.groupBy("source", "target").agg(F.min(F.struct(total.alias("hops"), F.concat("out_edges", "back_edges").alias("edges"), path.alias("path"))).alias("x"))
    return pairs.join(best, ["source", "target"]).select("source", "target", "x.hops", "x.path")


def entry_points(edges: DataFrame, targets: DataFrame, hops: int = 8) -> DataFrame:
    """(target, entry, hops, path): nodes without callers from which a target is reached, each by
    one shortest path; the path begins at the entry."""
    found = reach(edges, targets, hops, backward=True).where("hops > 0")
    roots = found.join(edges.select(F.col("callee").alias("node")).distinct(), "node", "left_anti")
    # a path as long as the limit is not looked at any further, so its end is no entry
    return roots.where(F.col("hops") < hops).select(F.col("start").alias("target"), F.col("node").alias("entry"), "hops", F.reverse("path").alias("path"))


def verify_flows(flows: DataFrame, edges: DataFrame, symbols: DataFrame, hops: int = 6, each: int = 5) -> DataFrame:
    """Flows (flow_id, source_file, source_line, sink_file, sink_line) with the shortest call chain
    between symbols at their ends; symbols: (file, name, start_line, end_line)."""

    def around(side: str) -> DataFrame:
        s = symbols.select("file", F.concat_ws("::", "file", "name").alias(side), "start_line", "end_line")
        line = F.col(f"{side}_line")
        rows = flows.select("flow_id", f"{side}_file", f"{side}_line").join(s, (F.col(f"{side}_file") == s.file) & (s.start_line <= line))
        inside = F.when(line <= F.col("end_line"), 0).otherwise(1)
        w = Window.partitionBy("flow_id").orderBy(inside, F.when(inside == 0, F.col("end_line") - F.col("start_line")).otherwise(0), line - F.col("start_line"), side)
        rows = rows.withColumn("_in", F.min(inside).over(Window.partitionBy("flow_id"))).where(F.col("_in") == inside).withColumn("_r", F.row_number().over(w))
        return rows.where(F.col("_r") <= each).select("flow_id", side)

    pairs = around("source").join(around("sink"), "flow_id").withColumnRenamed("sink", "target")
    found = find_path(edges, pairs.select("source", "target").distinct(), hops)
    best = pairs.join(found, ["source", "target"]).groupBy("flow_id").agg(F.min_by("path", F.struct("hops", "path")).alias("chain"))
    return flows.join(best, "flow_id", "left").withColumn("graph_verified", F.col("chain").isNotNull())


def chain_text(path):
    """A chain as text, caller first."""
    return F.array_join(path, " -> ")


def calls_of(edges: DataFrame, node: str) -> DataFrame:
    """The calls into a node and out of it (side, other), each with its edge."""
    into = edges.where(F.col("callee") == node).select(F.lit("incoming").alias("side"), F.col("caller").alias("other"), "edge_id")
    return into.unionByName(edges.where(F.col("caller") == node).select(F.lit("outgoing").alias("side"), F.col("callee").alias("other"), "edge_id"))


def call_totals(edges: DataFrame) -> DataFrame:
    """How many calls go into each node and out of it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("callee").alias("node"), F.lit(1).alias("i")), F.struct(F.col("caller").alias("node"), F.lit(0).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.count_if(F.col("e.i") == 1).alias("incoming"), F.count_if(F.col("e.i") == 0).alias("outgoing"))
