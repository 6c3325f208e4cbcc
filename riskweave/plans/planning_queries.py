"""Queries of reads, budgets, boosts and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sinks
from ..functions import text
from ..operators import findings as ops
from ..operators import planning
from ..session import table
from .bindings import DEPENDENCIES, FINDINGS, frame, sql
from .column_queries import DEPENDENCY_RISK_SQL, dependency_risks
from .finding_queries import FIND, _sbom, found, SBOM_SQL
from .registry import query


@query("q097_query_findings", f"SELECT finding_id, severity, substr(title, 1, 10) AS title FROM {FIND} WHERE status = 'candidate' AND severity = 'high'")
def query_findings(spark, sf_dir):
    return found(spark, sf_dir).where("status = 'candidate' and severity = 'high'").select("finding_id", "severity", F.substring("title", 1, 10).alias("title"))


@query("q099_dependency_findings", f"SELECT id, severity, score FROM ({DEPENDENCY_RISK_SQL}) WHERE relevance = 'used' ORDER BY score DESC NULLS LAST, severity DESC NULLS LAST, id")
def dependency_findings(spark, sf_dir):
    """The order of the read interface: risk, then severity as text."""
    rows = dependency_risks(spark, sf_dir).where("relevance = 'used'").select("id", "severity", F.col("risk.score").alias("score"))
    return rows.orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("severity"), "id")


@query("q098_taint_flows", "SELECT l_orderkey AS flow_id, count(*) AS hops, list_sort(list(l_partkey))[1:6] AS chain FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R')")
def taint_flows(spark, sf_dir):
    """Flows that nothing sanitises, with their hops and the first six steps."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("flow_id")).agg(F.sort_array(F.collect_list("l_partkey")).alias("chain"), F.bool_or(F.col("l_returnflag") == "R").alias("sanitised"))
    return rows.where("not sanitised").select("flow_id", F.size("chain").cast("bigint").alias("hops"), F.slice("chain", 1, 6).alias("chain"))


@query("q100_newest_hits", "SELECT l_orderkey * 10 + l_linenumber AS hit_id, l_shipdate AS created_at FROM lineitem WHERE l_returnflag = 'A' ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC LIMIT 50")
def newest_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_partkey")).limit(50)
    return rows.selectExpr("l_orderkey * 10 + l_linenumber AS hit_id", "l_shipdate AS created_at")


@query("q103_scan_history", "SELECT o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_mktsegment), 'build') OR contains(lower(o_orderpriority), 'urgent') GROUP BY 1")
def scan_history(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    hit = F.contains(F.lower("c_mktsegment"), F.lit("build")) | F.contains(F.lower("o_orderpriority"), F.lit("urgent"))
    return rows.where(hit).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("q106_list_scans", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS place FROM orders")
def list_scans(spark, sf_dir):
    """The scans of every project, newest first."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@query("q192_persist_new", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_orderkey % 2 = 0 AND (l_partkey, l_returnflag) NOT IN (SELECT (l_partkey, l_returnflag) FROM lineitem WHERE l_orderkey % 2 = 1)")
def persist_new(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_orderkey")
    return ops.persist_new(rows.where("l_orderkey % 2 = 1").drop("l_orderkey"), rows.where("l_orderkey % 2 = 0").drop("l_orderkey"), ["l_partkey", "l_returnflag"])


@query("q193_flow_dedupe", "SELECT l_suppkey AS source_line, l_linenumber AS sink_line, bool_or(l_returnflag = 'R') AS sanitised, max(1 - l_discount)::DOUBLE AS confidence FROM lineitem GROUP BY ALL")
def flow_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("'a' AS source_file", "l_suppkey AS source_line", "'t' AS source_type", "'b' AS sink_file", "l_linenumber AS sink_line", "'u' AS sink_type", "l_returnflag = 'R' AS sanitised", "1 - l_discount AS confidence", "array(l_linestatus) AS intermediaries")
    return ops.dedupe_flows(rows).select("source_line", "sink_line", "sanitised", "confidence")


@query("q258_line_ranges", f"SELECT finding_id, least(start_line, end_line - 3) AS first, greatest(start_line, end_line - 3) AS last FROM {FIND} WHERE end_line > 3")
def line_ranges(spark, sf_dir):
    r = text.line_range(F.format_string("%d - %d", F.col("start_line"), F.col("end_line") - 3))
    return found(spark, sf_dir).where("end_line > 3").select("finding_id", r["start"].alias("first"), r["end"].alias("last"))


@query("q283_context_size", "SELECT conv_id, sum(CASE WHEN length(text) = 0 THEN 0 ELSE floor(length(text) / 3.2::DOUBLE)::INT + 1 END)::BIGINT AS tokens FROM conversations GROUP BY 1")
def context_size(spark, sf_dir):
    return planning.context_size(table(spark, sf_dir, "conversations"), "text", "conv_id")


@query("q284_compaction", "SELECT p_partkey, greatest(2000, floor(p_size * 1000 * 0.3::DOUBLE))::INT AS threshold, greatest(1000, floor(p_size * 1000 * 0.15::DOUBLE))::INT AS target FROM part")
def compaction(spark, sf_dir):
    c = planning.compaction(F.col("p_size") * 1000)
    return table(spark, sf_dir, "part").select("p_partkey", c["threshold"].alias("threshold"), c["target"].alias("target"))


@query("q293_iteration_budget", "SELECT p_partkey, floor(CASE m WHEN 'light' THEN 10 WHEN 'heavy' THEN 80 ELSE 30 END * greatest(1, least(2, p_size * 30 / 500::DOUBLE)))::INT AS reads, CASE m WHEN 'light' THEN 1 WHEN 'heavy' THEN 6 + (p_size > 10)::INT ELSE 3 + (p_size > 10)::INT END AS passes FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'regular' ELSE 'heavy' END AS m FROM part)")
def iteration_budget(spark, sf_dir):
    mode = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'regular' ELSE 'heavy' END")
    b = planning.iteration_budget(mode, F.col("p_size") * 30, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", b["reads"].alias("reads"), b["passes"].alias("passes"))


@query("q209_hot_files", "SELECT l_partkey AS file_path, sum(l_linenumber)::DOUBLE AS dynamic FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def hot_files(spark, sf_dir):
    boosts = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS file_path", "cast(l_linenumber as double) AS boost")
    files = table(spark, sf_dir, "part").selectExpr("p_partkey AS file_path", "0.0D AS score")
    none = files.limit(0)
    return ops.hot_files(ops.reprioritised(files, boosts, none), 10).select("file_path", "dynamic")


@query("q216_default_picks", "SELECT k AS file_path FROM (SELECT p_partkey AS k, 0 AS f, -p_size AS place FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, 1, p_size FROM part WHERE p_size < 20) GROUP BY k ORDER BY min(struct_pack(f := f, place := place)), k LIMIT 400")
def default_picks(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    pick = lambda where, place: parts.where(where).selectExpr("p_partkey AS file_path", f"{place} AS place")
    return planning.default_picks(pick("p_size > 45", "-p_size"), pick("p_size < 20", "p_size"), 400)


@query("q165_scan_coverage", "SELECT count(*) AS files, count(i) AS inspected, true AS degraded_coverage, round(count(i) / count(*), 4) AS share FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS i FROM lineitem WHERE l_quantity > 48) ON p_partkey = i")
def scan_coverage(spark, sf_dir):
    from ..operators.rollups import coverage_status

    runs = coverage_status(spark.createDataFrame([(True, []), (True, ["timeout"])], "success boolean, errors array<string>"))
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("path"))
    return planning.coverage(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path")), seen, runs)


@query("q212_related_files", "SELECT f AS file_path, max(c)::DOUBLE AS confidence FROM (SELECT l_partkey % 50 AS f, 1 - l_discount * 5 AS c FROM lineitem WHERE l_suppkey % 50 = 3 UNION ALL SELECT l_suppkey % 50, 1 - l_discount * 5 FROM lineitem WHERE l_partkey % 50 = 3) WHERE c >= 0.6 AND f <> 3 GROUP BY 1 ORDER BY 2 DESC, cast(f as string) LIMIT 3")
def related_files(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey % 50 as string) AS caller_file", "cast(l_partkey % 50 as string) AS callee_file", "cast(1 - l_discount * 5 as double) AS confidence")
    return planning.related_files(edges, "3").select(F.col("file_path").cast("bigint").alias("file_path"), "confidence")


@query("q180_usage_summary", "SELECT id, string_agg(label || ': ' || files, '; ' ORDER BY rank) AS summary FROM (SELECT l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rank, CASE l_returnflag WHEN 'A' THEN 'imports' WHEN 'N' THEN 'references' ELSE 'vulnerable functions' END AS label, array_to_string(list_sort(list_distinct(list(concat('f', cast(l_suppkey % 30 as string)))))[1:3], ', ') AS files FROM lineitem GROUP BY ALL) GROUP BY 1")
def usage_summary(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS id", "CASE l_returnflag WHEN 'A' THEN 'import' WHEN 'N' THEN 'reference' ELSE 'vulnerable_function' END AS kind", "concat('f', cast(l_suppkey % 30 as string)) AS file")
    return planning.usage_summary(hits)


@query("q315_delete_scan", "SELECT count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_scan(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("scan_id"))
    left = sinks.without_scan({"results": table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "scan_id")}, gone)["results"]
    return left.agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))


_PURL = "CASE ecosystem " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sinks.PURL.items()) + " ELSE 'generic' END"


@query("q321_sbom_export", f"SELECT CAST(to_json({{'type': 'library', 'name': name, 'version': version, 'purl': 'pkg:' || {_PURL} || '/' || replace(name, ':', '/') || '@' || version, 'scope': CASE WHEN is_dev THEN 'optional' ELSE 'required' END, 'vulnerabilities': vulnerabilities}}) AS VARCHAR) AS component FROM ({SBOM_SQL})")
def sbom_export(spark, sf_dir):
    return sinks.cyclonedx(_sbom(spark, sf_dir))


@query("q324_evidence_rows", f"SELECT finding_id, kind, ordinal, description FROM (SELECT finding_id, 'supporting' AS kind, unnest([title, category]) AS description, unnest([0, 1]) AS ordinal FROM {FIND} UNION ALL SELECT finding_id, 'opposing', status, 0 FROM {FIND})")
def evidence_rows(spark, sf_dir):
    rows = frame(spark, sf_dir, FINDINGS).select("finding_id", F.array("title", "category").alias("supporting_evidence"), F.array("status").alias("opposing_evidence"))
    return sinks.evidence_rows(rows)


@query("q109_ecosystem_filter", f"SELECT id FROM {sql(DEPENDENCIES)} WHERE ecosystem IN ('pypi', 'npm')")
def ecosystem_filter(spark, sf_dir):
    """Dependencies of the ecosystems that the scan's languages have."""
    of = spark.createDataFrame([("python", "pypi"), ("javascript", "npm"), ("typescript", "npm"), ("java", "maven"), ("elixir", "hex")], "language string, ecosystem string")
    wanted = of.where(F.col("language").isin("python", "typescript")).select("ecosystem").distinct()
    return frame(spark, sf_dir, DEPENDENCIES).join(wanted, "ecosystem", "left_semi").select("id")
