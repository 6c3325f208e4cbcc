"""Queries over findings, dependencies, events and call edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import findings as ops
from ..operators import graph, joins, rollups
from ..session import table
from .bindings import DEPENDENCIES, EDGES, FILES, FINDINGS, frame, select, sql
from .column_queries import DEPENDENCY_RISK_SQL, dependency_risks
from .registry import query

FIND = sql(FINDINGS)
RANK = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.SEVERITY_RANK.items()) + " ELSE 0 END"
ORDER = "CASE severity " + " ".join(f"WHEN '{k}' THEN {5 - v}" for k, v in fixed.SEVERITY_RANK.items()) + " ELSE 5 END"
LIVE = "status <> 'dismissed'"


def found(spark, sf_dir):
    return frame(spark, sf_dir, FINDINGS)


def weighed(table_: dict, other: int) -> str:
    return "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + f" ELSE {other} END"


RISK_SQL = f"""
SELECT scan_id, round(raw, 1) AS risk_score, CASE WHEN raw <= 5 THEN 'A' WHEN raw <= 15 THEN 'B' WHEN raw <= 35 THEN 'C' WHEN raw <= 60 THEN 'D' ELSE 'F' END AS grade FROM (
  SELECT scan_id, least(100.0, round(sum(CASE WHEN {LIVE} THEN ({weighed(fixed.RISK_WEIGHT, 3)} + CASE exploit_difficulty WHEN 'easy' THEN 10 WHEN 'moderate' THEN 5 ELSE 0 END) * confidence ELSE 0 END), 6))::DOUBLE AS raw
  FROM {FIND} GROUP BY scan_id)"""


@query("q158_risk_score", RISK_SQL)
def risk_score(spark, sf_dir):
    return rollups.risk_scores(found(spark, sf_dir), "scan_id")


@query("q094_list_findings", f"SELECT finding_id, severity, confidence FROM {FIND} WHERE status = 'confirmed' ORDER BY {ORDER}, confidence DESC, finding_id LIMIT 500")
def list_findings(spark, sf_dir):
    return ops.listed(found(spark, sf_dir), 500, None, "confirmed", "finding_id").select("finding_id", "severity", "confidence")


@query("q156_severity_counts", f"SELECT scan_id, severity, count(*) AS n FROM {FIND} WHERE severity <> 'odd' GROUP BY ALL")
def severity_counts(spark, sf_dir):
    return rollups.severity_counts(found(spark, sf_dir), "scan_id")


OWASP_SQL = (
    "coalesce(CASE cwe " + " ".join(f"WHEN '{cwe}' THEN '{code}'" for cwe, code in fixed.OWASP_OF_CWE.items()) + " END, "
    "CASE category " + " ".join(f"WHEN '{c}' THEN '{code}'" for c, code in fixed.OWASP_OF_CATEGORY.items()) + " END, 'A04')"
)


@query("q159_owasp", f"SELECT code, count(*) AS n, list_sort(list_distinct(list(title))) AS titles, arg_max(severity, {RANK}) AS max_severity, CASE code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.OWASP_NAMES.items())} END AS name FROM (SELECT *, {OWASP_SQL} AS code FROM {FIND} WHERE {LIVE}) GROUP BY code")
def owasp(spark, sf_dir):
    return rollups.owasp(found(spark, sf_dir).withColumn("cwe_ids", F.array("cwe")))


SURFACE_SQL = "coalesce(CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SURFACE_NAMES.items()) + " END, CASE coalesce(nullif(category, ''), 'other') WHEN 'other' THEN 'Other' WHEN ' Config ' THEN ' Config ' WHEN 'race_condition' THEN 'Race Condition' WHEN 'logging' THEN 'Logging' END)"


@query("q160_attack_surface", f"WITH s AS (SELECT {SURFACE_SQL} AS surface, count(*) AS n FROM {FIND} WHERE {LIVE} GROUP BY 1) SELECT * FROM s UNION ALL SELECT * FROM (VALUES ('Dependencies', 7::BIGINT), ('Secrets Exposure', 4::BIGINT)) v(surface, n) WHERE surface NOT IN (SELECT surface FROM s)")
def attack_surface(spark, sf_dir):
    hits = spark.createDataFrame([("secrets", 4), ("dep_audit", 7), ("bandit", 9)], "scanner string, n long")
    return rollups.attack_surface(found(spark, sf_dir), hits)


COMPONENTS = [("API", ["src/api"]), ("Core", ["src/core", "src/core/db"]), ("Web", ["src/web/"]), ("Nothing", ["lib"]), ("All", ["src"])]
COMPONENTS_SQL = "(VALUES " + ", ".join(f"('{c}', '{p}')" for c, ps in COMPONENTS for p in ps) + ") AS c(component, prefix)"


def components(spark):
    return spark.createDataFrame(COMPONENTS, "component string, files array<string>")


@query(
    "q161_component_scores",
    f"""
WITH o AS (SELECT DISTINCT file_path, component FROM {FIND} f JOIN {COMPONENTS_SQL} ON starts_with(f.file_path, c.prefix)),
m AS (SELECT component, severity, confidence FROM {FIND} f JOIN o ON f.file_path = o.file_path WHERE {LIVE}),
p AS (SELECT component, round(sum(({weighed(fixed.COMPONENT_PENALTY, 3)}) * confidence), 6) AS p, count(*) AS n FROM m GROUP BY 1),
r AS (SELECT c.component, greatest(0, 100 - coalesce(p, 0))::DOUBLE AS raw, coalesce(n, 0) AS n FROM (SELECT DISTINCT component FROM {COMPONENTS_SQL}) c LEFT JOIN p ON p.component = c.component)
SELECT component, round(raw, 1) AS score, CASE WHEN raw >= 90 THEN 'A' WHEN raw >= 75 THEN 'B' WHEN raw >= 55 THEN 'C' WHEN raw >= 35 THEN 'D' ELSE 'F' END AS grade, n FROM r""",
)
def component_scores(spark, sf_dir):
    return rollups.component_scores(found(spark, sf_dir), components(spark)).drop("severities")


@query(
    "q162_component_hotspots",
    f"""
WITH o AS (SELECT DISTINCT file_path, component FROM {FIND} f JOIN {COMPONENTS_SQL} ON f.file_path = c.prefix OR starts_with(f.file_path, c.prefix || '/')),
m AS (SELECT component, severity FROM {FIND} f JOIN o ON f.file_path = o.file_path WHERE {LIVE})
SELECT component, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) AS n, arg_max(severity, {RANK}) AS max_severity FROM m GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 LIMIT 8""",
)
def component_hotspots(spark, sf_dir):
    return rollups.component_hotspots(found(spark, sf_dir), components(spark))


@query("q175_category_distribution", f"SELECT coalesce(nullif(lower(trim(category)), ''), 'uncategorized') AS category, count(*) AS n FROM {FIND} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def category_distribution(spark, sf_dir):
    return rollups.category_distribution(found(spark, sf_dir))


@query("q176_severity_donut", f"SELECT severity, count(*) AS n FROM {FIND} GROUP BY 1")
def severity_donut(spark, sf_dir):
    return found(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@query("q177_confidence_histogram", f"SELECT CASE WHEN confidence >= 0.9 THEN '>=90' WHEN confidence >= 0.7 THEN '70-89' WHEN confidence >= 0.5 THEN '50-69' ELSE '<50' END AS band, count(*) AS n FROM {FIND} GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return rollups.confidence_histogram(found(spark, sf_dir))


@query("q179_report_counters", f"SELECT scan_id, count(*) AS n, count(*) FILTER (provenance = 'llm') AS from_llm, count(*) FILTER (provenance = 'scanner') AS from_scanner, sum(greatest(finding_id % 3 - 1, 0))::BIGINT AS merged_away FROM {FIND} WHERE {LIVE} GROUP BY 1")
def report_counters(spark, sf_dir):
    return rollups.report_counters(found(spark, sf_dir).withColumn("merged_count", F.expr("finding_id % 3")), "scan_id")


@query("q102_evidence_candidates", f"SELECT finding_id FROM (SELECT *, row_number() OVER (PARTITION BY title, file_path, severity ORDER BY confidence DESC, finding_id) AS r FROM {FIND} WHERE status = 'confirmed' AND ((severity IN ('critical', 'high') AND confidence >= 0.55) OR (severity = 'medium' AND confidence >= 0.75))) WHERE r = 1")
def evidence_candidates(spark, sf_dir):
    return ops.eligible_for_evidence(found(spark, sf_dir).withColumn("has_context", F.lit(False)), deep=True).select("finding_id")


KEY_SQL = "concat_ws('|', lower(file_path), nullif(substr(lower(trim(category)), 1, 60), ''), coalesce(cwe, nullif(cast(start_line AS string), '0')))"


@query("q185_canonical_key", f"SELECT finding_id, {KEY_SQL} AS canonical_key FROM {FIND}")
def canonical_key(spark, sf_dir):
    return keyed(spark, sf_dir).select("finding_id", "canonical_key")


def keyed(spark, sf_dir):
    key = ops.canonical_key(F.col("file_path"), F.col("category"), F.format_string("%d-%d", "start_line", "end_line"), F.array_compact(F.array("cwe")), F.array().cast("array<string>"), F.col("title"))
    return found(spark, sf_dir).withColumn("canonical_key", key)


@query(
    "q187_merge_by_key",
    f"""
WITH k AS (SELECT *, {KEY_SQL} AS canonical_key, repeat('h', (finding_id % 5)::INT) || title AS hypothesis, {RANK} AS r FROM {FIND})
SELECT canonical_key, arg_max(severity, r) AS severity, max(confidence) AS confidence,
  first(title ORDER BY r DESC, confidence DESC, finding_id) AS title, first(hypothesis ORDER BY length(hypothesis) DESC, finding_id) AS hypothesis,
  count(DISTINCT lower(title)) AS merged_count, CASE WHEN count(DISTINCT provenance) > 1 THEN 'hybrid' ELSE min(provenance) END AS provenance
FROM k GROUP BY 1""",
)
def merge_by_key(spark, sf_dir):
    rows = keyed(spark, sf_dir).withColumn("hypothesis", F.expr("concat(repeat('h', cast(finding_id % 5 as int)), title)"))
    return ops.merge_by_key(rows, ["canonical_key"])


@query("q183_greedy_merge")
def greedy_merge(spark, sf_dir):
    none = F.array().cast("array<string>")
    line = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    rows = found(spark, sf_dir).withColumns({"finding_id": F.col("finding_id").cast("string"), "line_range": F.concat(line("start_line"), F.lit("-"), line("end_line")), "hypothesis": F.col("title"), "cwe_ids": F.array_compact(F.array("cwe")), "sinks": none, "input_sources": none, "source_scanners": none, "source_rules": none})
    return ops.greedy_merge(rows).select("finding_id", "severity", "confidence", "provenance", "merged_count", F.size("merged_ids").alias("n"))


@query("q186_title_similarity", f"WITH t AS (SELECT scan_id, finding_id, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda t: length(t) >= 3)) AS w FROM {FIND}) SELECT a.finding_id AS a, b.finding_id AS b FROM t a JOIN t b ON a.scan_id = b.scan_id AND a.finding_id < b.finding_id WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) >= 0.9")
def title_similarity(spark, sf_dir):
    rows = found(spark, sf_dir).select("scan_id", "finding_id", text.tokens(F.col("title")).alias("w"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.scan_id") == F.col("b.scan_id")) & (F.col("a.finding_id") < F.col("b.finding_id")))
    return pairs.where(text.jaccard(F.col("a.w"), F.col("b.w")) >= 0.9).select(F.col("a.finding_id").alias("a"), F.col("b.finding_id").alias("b"))


#: Findings and hits of one project and file meet.
HIT_PATH = "concat('p', cast(l_orderkey % 500 as string), '/', " + FINDINGS["file_path"] + ")"
HIT = {
    "hit_id": "l_orderkey * 10 + l_linenumber",
    "file_path": HIT_PATH,
    "start_line": "cast(l_suppkey % 190 + 1 as int)",
    "end_line": "cast(l_suppkey % 190 + 3 as int)",
    "rule_id": "concat('rule/', l_returnflag)",
    "message": "case l_partkey % 3 when 0 then 'SQL query built from input' when 1 then 'weak cipher' else 'note' end",
    "scanner": "'semgrep'",
}


@query(
    "q138_match_hits",
    f"""
SELECT finding_id, hit_id, rule_id FROM (SELECT a.finding_id, b.hit_id, b.rule_id, row_number() OVER (PARTITION BY a.finding_id ORDER BY b.hit_id, b.rule_id) AS r
FROM (SELECT {select(FINDINGS | {"file_path": HIT_PATH})} FROM lineitem) a JOIN (SELECT {select(HIT)} FROM lineitem) b ON a.file_path = b.file_path AND ((a.start_line <= b.end_line AND b.start_line <= a.end_line) OR (a.category = 'crypto' AND b.message = 'weak cipher'))) WHERE r <= 5""",
)
def match_hits(spark, sf_dir):
    of = lambda binding: table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in binding.items()])
    return ops.match_hits(of(FINDINGS | {"file_path": HIT_PATH}), of(HIT))


@query("q113_project_scan_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def project_scan_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.with_default_counts(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query("q157_scan_counts", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def scan_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("q111_results_with_files", "SELECT l.l_orderkey * 10 + l.l_linenumber AS hit_id, p.p_name FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON l.l_partkey = p.p_partkey")
def results_with_files(spark, sf_dir):
    files = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS hit_id", "l_partkey").join(files, "l_partkey", "left").select("hit_id", "p_name")


@query("q112_files_of_findings", "SELECT l_orderkey AS scan_id, list_sort(list_distinct(list(p_name))) AS files FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def files_of_findings(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), "l_partkey").join(files, "l_partkey")
    return rows.groupBy("scan_id").agg(F.sort_array(F.collect_set("p_name")).alias("files"))


@query("q206_dependency_order", f"SELECT id, score FROM ({DEPENDENCY_RISK_SQL}) ORDER BY score DESC NULLS LAST, {ORDER}, lower(name), id")
def dependency_order(spark, sf_dir):
    rows = dependency_risks(spark, sf_dir).select("id", "severity", "name", F.col("risk.score").alias("risk_score"))
    return rows.orderBy(*ops.dependency_order(), "id").select("id", F.col("risk_score").alias("score"))


@query("q163_dependency_summary", f"SELECT count(*) AS total, count(*) FILTER (status = 'reachable') AS reachable, count(*) FILTER (relevance IN ('used', 'likely_used')) AS active, count(*) FILTER (score >= 700) AS high_risk FROM ({DEPENDENCY_RISK_SQL})")
def dependency_summary(spark, sf_dir):
    return rollups.dependency_summary(dependency_risks(spark, sf_dir).select("relevance", F.col("r.status").alias("reachability_status"), F.col("risk.score").alias("risk_score")))


@query("q178_reachability_chart", f"SELECT status, count(*) AS n FROM ({DEPENDENCY_RISK_SQL}) GROUP BY 1")
def reachability_chart(spark, sf_dir):
    return dependency_risks(spark, sf_dir).groupBy(F.col("r.status").alias("status")).agg(F.count("*").alias("n"))


VULNERABLE = "(SELECT l_partkey AS dependency_id, concat('CVE-', cast(l_suppkey % 9 as string)) AS cve_id FROM lineitem WHERE l_quantity > 40)"
SBOM_SQL = f"SELECT ecosystem, name, version, source_file, is_dev, count(DISTINCT cve_id) AS vulnerability_count, coalesce(list_sort(list(DISTINCT cve_id) FILTER (cve_id IS NOT NULL))[1:3], []) AS vulnerabilities FROM {sql(DEPENDENCIES)} d LEFT JOIN {VULNERABLE} v ON d.id = v.dependency_id GROUP BY ALL"


def _sbom(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").where("l_quantity > 40").selectExpr("l_partkey AS dependency_id", "cast(null as string) AS advisory_id", "concat('CVE-', cast(l_suppkey % 9 as string)) AS cve_id")
    return rollups.sbom(frame(spark, sf_dir, DEPENDENCIES), hits)


@query("q143_sbom", SBOM_SQL.replace("count(DISTINCT cve_id)", "count(DISTINCT cve_id)::INT"))
def sbom(spark, sf_dir):
    return _sbom(spark, sf_dir)


@query("q164_sbom_totals", f"SELECT ecosystem, count(*) AS components, count(*) FILTER (vulnerability_count > 0) AS vulnerable FROM ({SBOM_SQL}) GROUP BY 1")
def sbom_totals(spark, sf_dir):
    return rollups.sbom_totals(_sbom(spark, sf_dir))


@query("q191_dependency_identity", f"SELECT ecosystem, lower(trim(name)) AS name, version, source_file, is_dev, count(*) AS n FROM {sql(DEPENDENCIES)} GROUP BY ALL")
def dependency_identity(spark, sf_dir):
    return frame(spark, sf_dir, DEPENDENCIES).groupBy("ecosystem", F.lower(F.trim("name")).alias("name"), "version", "source_file", "is_dev").agg(F.count("*").alias("n"))


@query("q210_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def top_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ops.top_per_group(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).drop("l_extendedprice")


BOOSTS = "(SELECT l_partkey AS file_id, CASE WHEN l_linenumber = 1 THEN -1.0 ELSE l_linenumber / 2.0 END AS boost FROM lineitem)"


@query("q208_reprioritise", f"SELECT p_partkey AS file_id, round(p_size + coalesce(sum(boost), 0), 4)::DOUBLE AS effective, count(boost) AS referenced FROM part LEFT JOIN {BOOSTS} b ON p_partkey = b.file_id WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) GROUP BY p_partkey, p_size")
def reprioritise(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    files = table(spark, sf_dir, "part").selectExpr("p_partkey AS file_path", "cast(p_size as double) AS score")
    boosts = lines.selectExpr("l_partkey AS file_path", "cast(CASE WHEN l_linenumber = 1 THEN -1.0 ELSE l_linenumber / 2.0 END as double) AS boost")
    out = ops.reprioritised(files, boosts, lines.where("l_quantity > 49").select(F.col("l_partkey").alias("file_path")))
    return out.select(F.col("file_path").alias("file_id"), F.round("effective", 4).alias("effective"), "referenced")


@query("q214_event_page", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def event_page(spark, sf_dir):
    from ..streaming.events import page

    return page(table(spark, sf_dir, "events"), 500, 100).select("event_id", "event_type")


@query("q310_progress_state", "SELECT user_id AS scan_id, arg_max(event_type, event_id) AS phase, max(event_id) AS last_event, count(*) AS n FROM events GROUP BY 1")
def progress_state(spark, sf_dir):
    from ..streaming.events import progress

    return progress(table(spark, sf_dir, "events").withColumnRenamed("user_id", "scan_id"))


def edges(spark, sf_dir):
    return frame(spark, sf_dir, EDGES)


EDGE = sql(EDGES)


@query("q168_in_degree", f"SELECT callee, count(*) AS calls FROM {EDGE} GROUP BY 1")
def in_degree(spark, sf_dir):
    return graph.in_degree(edges(spark, sf_dir))


@query("q228_degree_boosts", f"SELECT callee AS file_path, (count(*) * 2)::DOUBLE AS boost FROM {EDGE} GROUP BY 1 HAVING count(*) >= 3")
def degree_boosts(spark, sf_dir):
    return graph.boosts_by_degree(edges(spark, sf_dir))


REACH_SQL = "WITH RECURSIVE e AS (SELECT DISTINCT {a} AS a, {b} AS b FROM {edge}), r(s, n, h) AS (SELECT s, s, 0 FROM {starts} UNION SELECT s, b, h + 1 FROM r JOIN e ON n = a WHERE h < {hops}) SELECT {out} FROM (SELECT s, n, min(h) AS hops FROM r GROUP BY 1, 2) WHERE {where}"


#: Pairs of functions, and functions, of a table; some are in no call.
PATH_ENDS = {"source": "concat('f', cast(s_suppkey * 7 % 997 as string))", "target": "concat('f', cast((s_suppkey * 7 + 1 + s_suppkey % 25) % 998 as string))"}


@query(
    "q224_find_path",
    f"WITH RECURSIVE e AS (SELECT DISTINCT caller AS a, callee AS b FROM {EDGE}), p AS (SELECT DISTINCT {PATH_ENDS['source']} AS source, {PATH_ENDS['target']} AS target FROM supplier), r(s, n, h) AS (SELECT DISTINCT source, source, 0 FROM p UNION SELECT s, b, h + 1 FROM r JOIN e ON n = a WHERE h < 6) SELECT source, target, min(h)::INT AS hops FROM p JOIN r ON s = source AND n = target GROUP BY 1, 2",
)
def find_path(spark, sf_dir):
    pairs = table(spark, sf_dir, "supplier").selectExpr(*[f"{e} AS {n}" for n, e in PATH_ENDS.items()]).distinct()
    return graph.find_path(edges(spark, sf_dir), pairs, 6).select("source", "target", "hops")


@query("q225_entry_points", REACH_SQL.format(a="callee", b="caller", edge=EDGE, starts=f"(SELECT DISTINCT {PATH_ENDS['target']} AS s FROM supplier)", hops=8, out="s AS target, n AS entry, hops::INT AS hops", where=f"hops > 0 AND hops < 8 AND n NOT IN (SELECT callee FROM {EDGE})"))
def entry_points(spark, sf_dir):
    targets = table(spark, sf_dir, "supplier").selectExpr(f"{PATH_ENDS['target']} AS node").distinct()
    return graph.entry_points(edges(spark, sf_dir), targets, 8).select("target", "entry", "hops")


@query("q222_callers", f"SELECT caller, callee, edge_id FROM {EDGE} WHERE callee = 'f7'")
def callers(spark, sf_dir):
    return edges(spark, sf_dir).where("callee = 'f7'").select("caller", "callee", "edge_id")


@query("q001_index_files", f"SELECT file_id, regexp_matches(lower(path), 'test|spec|__test__|fixture|mock') AS is_test FROM {sql(FILES)} WHERE line_count <= 1500 ORDER BY path, file_id LIMIT 10000")
def index_files(spark, sf_dir):
    """The size test, the flags and the cap of the file index, in a fixed order."""
    from ..functions.paths import indexed_as_test

    files = frame(spark, sf_dir, FILES).where("line_count <= 1500").orderBy("path", "file_id").limit(10000)
    return files.select("file_id", indexed_as_test(F.col("path")).alias("is_test"))


@query("q009_path_tree", "SELECT page_id, list_sort(list_distinct(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/')))) AS prefixes FROM (SELECT page_id, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS p FROM pages)")
def component_of_pages(spark, sf_dir):
    parts = F.split(F.regexp_extract("url", "://([^?#]*)", 1), "/")
    made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(F.array_distinct(made)).alias("prefixes"))


@query("q190_clusters")
def clusters(spark, sf_dir):
    return ops.clusters(found(spark, sf_dir))


@query("q291_guardrails", f"WITH g AS (SELECT *, {LIVE} AND severity IN ('critical', 'high') AND category IN ('injection', 'xss', 'ssrf') AND confidence < 0.9 AS gap, contains(file_path, '/tests/') AS low FROM {FIND}) SELECT finding_id, CASE WHEN gap AND low THEN 'dismissed' ELSE status END AS status, CASE WHEN gap AND low THEN 'info' WHEN gap THEN 'medium' ELSE severity END AS severity, CASE WHEN gap AND low THEN least(confidence, 0.1) WHEN gap THEN least(confidence, 0.6) ELSE confidence END::DOUBLE AS confidence FROM g")
def guardrails(spark, sf_dir):
    rows = found(spark, sf_dir).withColumn("needs_context", F.coalesce(F.col("category").isin("injection", "xss", "ssrf"), F.lit(False)))
    return ops.guardrails(rows, F.col("confidence") >= 0.9).select("finding_id", "status", "severity", "confidence")
