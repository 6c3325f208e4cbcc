"""Queries of reports, exports and the state of scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..session import table
from .bindings import FINDINGS, frame, sql
from .registry import query
from .source_queries import filled

FIND = sql(FINDINGS)


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("q205_export_order", f"SELECT finding_id FROM {FIND} WHERE status = 'confirmed' ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 9 END, confidence DESC, finding_id LIMIT 1000")
def export_order(spark, sf_dir):
    """The first thousand findings of an export."""
    return frame(spark, sf_dir, FINDINGS).where("status = 'confirmed'").orderBy(*reports.export_order(), "finding_id").limit(1000).select("finding_id")


_STATE = "CASE {k} % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'degraded' WHEN 2 THEN 'completed' WHEN 3 THEN 'skipped' ELSE 'odd' END"


@query("q213_scanner_run_rows", f"SELECT scan_id, scanner, status, row_number() OVER (PARTITION BY scan_id ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'degraded' THEN 1 WHEN 'completed' THEN 2 WHEN 'skipped' THEN 3 ELSE 9 END, lower(scanner), scanner) AS place FROM (SELECT DISTINCT l_orderkey AS scan_id, 'S' || l_suppkey % 7 AS scanner, {_STATE.format(k='(l_suppkey % 7)')} AS status FROM lineitem)")
def scanner_run_rows(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS scan_id", "concat('S', cast(l_suppkey % 7 as string)) AS scanner", f"{_STATE.format(k='(l_suppkey % 7)')} AS status").distinct()
    return reports.run_rows(runs)


@query("q218_surface_points", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN ['GET /a' || p_size, 'login'] WHEN 1 THEN ['login', 'GET /a' || p_size] ELSE ['login'] END AS points FROM part")
def surface_points(spark, sf_dir):
    one = filled(" GET /aSIZE", F.col("p_partkey"), F.col("p_size"))
    surface = F.when(F.col("p_partkey") % 3 == 0, F.array(one, F.lit(""), F.lit("login"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("login"), F.lit("login ")))
    entries = F.when(F.col("p_partkey") % 3 < 2, F.array(F.lit("login"), one)).otherwise(F.array(F.lit("login"), F.lit(None).cast("string")))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.array_compact(reports.surface_points(surface, entries)).alias("points"))


@query("q219_chain_steps", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN ['step ' || p_size, 'end'] WHEN 1 THEN ['first', 'then ' || p_size] ELSE [] END AS steps FROM part")
def chain_steps(spark, sf_dir):
    told = F.when(F.col("p_partkey") % 3 == 0, F.array(filled(" step SIZE", F.col("p_partkey"), F.col("p_size")), F.lit(" "), F.lit("end"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("")))
    scenario = F.when(F.col("p_partkey") % 3 < 2, filled("- first\n\n  -- then SIZE\r\n-", F.col("p_partkey"), F.col("p_size")))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), reports.chain_steps(told, scenario).alias("steps"))


@query(
    "q220_coverage_flags",
    "SELECT p_partkey AS id, list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'Scanner coverage degraded' END, CASE WHEN p_partkey % 3 = 0 THEN 'Monorepo' END, CASE WHEN p_size % 4 > 0 THEN p_size % 4 || ' obfuscated files' END, CASE WHEN p_size > 40 THEN p_size || ' skipped by scan cap' END, CASE WHEN p_partkey % 5 = 0 THEN '7 docs analysed' END], lambda x: x IS NOT NULL) AS flags FROM part",
)
def coverage_flags(spark, sf_dir):
    c = F.expr("named_struct('degraded_coverage', p_partkey % 2 = 0, 'is_apk', cast(null as boolean), 'is_monorepo', p_partkey % 3 = 0, 'obfuscated_files', p_size % 4, 'files_skipped_size', 0, 'files_skipped_cap', CASE WHEN p_size > 40 THEN p_size END, 'ignored_file_count', cast(null as int), 'has_doc_intelligence', p_partkey % 5 = 0, 'doc_files_read', 7)")
    return parts(spark, sf_dir).withColumn("c", c).select(F.col("p_partkey").alias("id"), reports.coverage_flags(F.col("c")).alias("flags"))


@query("q279_truncated", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || '... (' || 2 || ' more lines)' ELSE 'a' || p_size END AS code, CASE WHEN p_partkey % 2 = 0 THEN 'a long t...' ELSE 'short ' || p_size END AS text FROM part")
def truncated(spark, sf_dir):
    code = F.when(F.col("p_partkey") % 2 == 0, "\n a\nb\nc\r\nd\ne\nf \n").otherwise(filled(" aSIZE ", F.col("p_partkey"), F.col("p_size")))
    said = F.when(F.col("p_partkey") % 2 == 0, "  a long t  ext").otherwise(filled("short SIZE", F.col("p_partkey"), F.col("p_size")))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), reports.truncated_code(code).alias("code"), reports.truncated_text(said, 11).alias("text"))


@query("q203_merged_diagrams", "SELECT p_partkey AS report_id, unnest(['overview', 'security', 'data_flow', '']) AS kind, unnest(['o' || p_size, 's', 'd2', 'Own']) AS title, unnest([1, 2, 3, 4])::INT AS place FROM part")
def merged_diagrams(spark, sf_dir):
    row = lambda n, k, t, src="x": F.struct(F.lit(n).alias("position"), F.lit(k).alias("kind"), (t if not isinstance(t, str) else F.lit(t)).alias("title"), F.lit(src).alias("source"))
    of = lambda *rows: parts(spark, sf_dir).select(F.col("p_partkey").alias("report_id"), F.explode(F.array(*rows)).alias("d")).select("report_id", "d.*")
    own = of(row(0, "security", "s"), row(1, "overview", filled("oSIZE", F.col("p_partkey"), F.col("p_size"))), row(2, "overview", "again"), row(3, "data_flow", "no source", " "))
    more = of(row(0, "data_flow", "d2"), row(1, "", "Own"), row(2, "", "OWN"), row(3, "security", "late"))
    return reports.merged_diagrams(own, more).select("report_id", "kind", "title", "place")


@query("q198_reattached", f"SELECT a.finding_id AS candidate_id, b.finding_id FROM (SELECT *, row_number() OVER (PARTITION BY title, severity, file_path ORDER BY finding_id) AS n FROM {FIND} WHERE status <> 'dismissed') a JOIN (SELECT *, row_number() OVER (PARTITION BY title, severity, file_path ORDER BY confidence, finding_id) AS n FROM {FIND} WHERE finding_id % 3 = 0) b USING (title, severity, file_path, n)")
def reattached(spark, sf_dir):
    rows = frame(spark, sf_dir, FINDINGS)
    left = rows.select(F.col("finding_id").alias("candidate_id"), F.upper("title").alias("title"), "severity", F.concat(F.lit("./"), "file_path").alias("file_path"), "status", F.col("finding_id").alias("place"))
    return reports.reattached(left, rows.where("finding_id % 3 = 0").withColumn("ordinal", F.struct("confidence", "finding_id")))


_END = "CASE o_orderkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'cancelled' END"


@query(
    "q318_finished_scans",
    f"WITH s AS (SELECT o_orderkey AS scan_id, CASE WHEN o_custkey % 3 = 0 THEN 'cancelled' ELSE 'running' END AS status, CASE WHEN o_custkey % 2 = 0 THEN 'old' END AS error, {_END} AS e FROM orders) SELECT scan_id, CASE WHEN e IS NULL OR (status = 'cancelled' AND e <> 'cancelled') THEN status ELSE e END AS status, CASE WHEN e IS NULL OR (status = 'cancelled' AND e <> 'cancelled') THEN 'scan' WHEN e = 'completed' THEN 'done' ELSE e END AS phase, CASE WHEN e = 'failed' AND status = 'cancelled' THEN coalesce(error, 'boom') WHEN e = 'failed' THEN 'boom' ELSE error END AS error FROM s",
)
def finished_scans(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    scans = orders.selectExpr("o_orderkey AS scan_id", "CASE WHEN o_custkey % 3 = 0 THEN 'cancelled' ELSE 'running' END AS status", "'scan' AS phase", "CASE WHEN o_custkey % 2 = 0 THEN 'old' END AS error", "cast(null as timestamp_ntz) AS completed_at")
    ends = orders.where("o_orderkey % 4 < 3").selectExpr("o_orderkey AS scan_id", f"{_END} AS end_status", "CASE WHEN o_orderkey % 4 = 1 THEN 'boom' END AS end_error", "o_orderdate AS ended_at")
    return reports.finished(scans, ends).select("scan_id", "status", "phase", "error")


@query("q316_progress_snapshot", "SELECT user_id AS scan_id, arg_max(event_type, event_id) AS phase, arg_max(event_id % 50, event_id)::BIGINT AS done, round(arg_max(event_id % 50, event_id) / 60.0, 4)::DOUBLE AS share FROM events GROUP BY 1")
def progress_snapshot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS scan_id", "event_id", "event_type AS phase", "'t' AS task", "event_id % 50 AS done", "60 AS total")
    return reports.snapshot(rows).select("scan_id", "phase", "done", "share")


@query("q317_audit_log", "WITH n AS (SELECT DISTINCT l_orderkey AS scan_id, l_returnflag AS action, l_linenumber AS decided_at FROM lineitem WHERE l_linenumber > 2) SELECT l_orderkey AS scan_id, l_returnflag AS action, l_linenumber AS decided_at, l_linenumber::BIGINT AS ordinal FROM lineitem WHERE l_linenumber <= 2 UNION ALL SELECT scan_id, action, decided_at, coalesce((SELECT max(l_linenumber) FROM lineitem x WHERE x.l_orderkey = scan_id AND l_linenumber <= 2), 0) + row_number() OVER (PARTITION BY scan_id ORDER BY decided_at, action) FROM n")
def audit_log(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS scan_id", "'planner' AS agent", "l_returnflag AS action", "l_linenumber AS decided_at", "cast(l_linenumber as bigint) AS ordinal")
    new = rows.drop("ordinal")
    return reports.audit_log(new.unionByName(new.where("decided_at > 4")), rows.where("decided_at <= 2")).drop("agent")


@query("q328_minimal_reports", "SELECT o_orderkey AS scan_id, o_custkey AS total_files, o_custkey - CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END AS files_indexed, coalesce(used, []) AS scanners_used, coalesce(bad, false) AS degraded_coverage FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list_distinct(list('s' || l_linenumber % 3))) AS used, bool_or(l_returnflag = 'R') AS bad FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON l_orderkey = o_orderkey")
def minimal_reports(spark, sf_dir):
    scans = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS scan_id", "o_custkey AS files_total", "CASE WHEN o_orderkey % 2 = 0 THEN 3 END AS files_skipped_cap")
    runs = table(spark, sf_dir, "lineitem").where("l_quantity > 30").selectExpr("l_orderkey AS scan_id", "concat('s', cast(l_linenumber % 3 as string)) AS scanner", "CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status")
    return reports.minimal_report(scans, runs)


@query("q329_version_snapshot", "SELECT o_orderkey AS scan_id, unnest(['semgrep_version', 'advisory_db_ver', 'eslint_version']) AS field, unnest([CASE WHEN o_custkey % 2 = 0 THEN '1.2' END, '2024', NULL]) AS version FROM orders")
def version_snapshot(spark, sf_dir):
    config = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS scan_id", "explode(array(named_struct('scanner', 'semgrep', 'enabled', o_custkey % 2 = 0), named_struct('scanner', 'dep_audit', 'enabled', true), named_struct('scanner', 'eslint', 'enabled', true), named_struct('scanner', 'other', 'enabled', true))) AS c").select("scan_id", "c.*")
    versions = spark.createDataFrame([("semgrep", "1.2"), ("dep_audit", "2024")], "scanner string, version string")
    return reports.version_snapshot(config, versions)


@query("q172_entry_signals", "SELECT unnest(['Main entrypoint in f' || lpad(o_orderkey::VARCHAR, 9, '0'), 'Route hub in f' || lpad(o_orderkey::VARCHAR, 9, '0') || ' (2 routes)']) AS signal FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 6)")
def entry_signals(spark, sf_dir):
    path = F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    fact = lambda k, n: F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"))
    facts = table(spark, sf_dir, "orders").select(path.alias("path"), F.explode(F.array(fact("route", "/a"), fact("function", "main"), fact("route", "/b"), fact("function", "other"))).alias("f")).select("path", "f.*")
    return reports.entry_signals(facts)


@query("q174_planner_state", f"SELECT 'finding:' || status AS name, count(*) AS n FROM {FIND} GROUP BY 1 UNION ALL SELECT 'flow:unsanitised', count(*) FILTER (event_id % 3 > 0) FROM events UNION ALL SELECT 'flow:verified', count(*) FILTER (event_id % 3 > 0 AND event_id % 2 = 0) FROM events")
def planner_state(spark, sf_dir):
    flows = table(spark, sf_dir, "events").selectExpr("event_id % 3 = 0 AS sanitised", "event_id % 2 = 0 AS graph_verified")
    return reports.planner_state(frame(spark, sf_dir, FINDINGS), flows)


@query("q181_hit_provenance", "SELECT l_orderkey AS finding_id, list_sort(list_distinct(list('s' || l_linenumber % 3) FILTER (l_linenumber % 3 > 0))) AS scanners, list_sort(list_distinct(list('r' || l_suppkey % 4) FILTER (l_suppkey % 4 > 0))) AS rules FROM lineitem GROUP BY 1 HAVING scanners IS NOT NULL AND rules IS NOT NULL")
def hit_provenance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS finding_id", "CASE WHEN l_linenumber % 3 > 0 THEN concat(' s', cast(l_linenumber % 3 as string)) ELSE ' ' END AS scanner", "CASE WHEN l_suppkey % 4 > 0 THEN concat('r', cast(l_suppkey % 4 as string), ' ') END AS rule_id")
    return reports.hit_provenance(rows).where((F.size("scanners") > 0) & (F.size("rules") > 0))


@query("q202_related_defaults", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'CVE' ELSE 'ADV' END AS display_id, CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'related_by_cwe' END AS evidence_type, CASE WHEN p_size % 3 = 0 THEN 'strong' ELSE 'contextual' END AS evidence_strength, CASE WHEN p_partkey % 5 = 0 THEN 'lock' WHEN p_partkey % 2 = 1 THEN 'cwe_correlation' END AS evidence_source FROM part")
def related_defaults(spark, sf_dir):
    rows = parts(spark, sf_dir).selectExpr(
        "p_partkey AS id", "CASE WHEN p_partkey % 3 = 0 THEN 'D' ELSE '' END AS display_id", "CASE WHEN p_partkey % 3 < 2 THEN 'CVE' END AS cve_id", "'ADV' AS advisory_id", "CASE WHEN p_size % 2 = 0 THEN 'high' END AS severity",
        "CASE WHEN p_partkey % 4 = 0 THEN 'exact' END AS match_type", "CASE WHEN p_partkey % 2 = 0 THEN 'exact' END AS evidence_type", "CASE WHEN p_size % 3 = 0 THEN 'strong' END AS evidence_strength", "CASE WHEN p_partkey % 5 = 0 THEN 'lock' END AS package_evidence_source",
    )
    return reports.related_defaults(rows)


@query("q196_ordered_distinct", "SELECT o_orderkey AS id, [" + ", ".join(["'a' || o_custkey % 3", "'b'"]) + "] AS signals FROM orders")
def ordered_distinct(spark, sf_dir):
    from ..functions.text import first_distinct

    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), first_distinct(F.array(filled(" aKEY", F.col("o_custkey") % 3), F.lit("b"), F.lit(""), filled("aKEY ", F.col("o_custkey") % 3), F.lit("c")), 2).alias("signals"))


@query("q188_provenance_merge", "SELECT l_orderkey AS id, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'hybrid' ELSE lower(min(l_returnflag)) END AS provenance FROM lineitem GROUP BY 1")
def provenance_merge(spark, sf_dir):
    from ..operators.findings import merged_provenance

    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.concat(F.lit(" "), "l_returnflag")).alias("v"))
    return rows.select("id", merged_provenance(F.concat("v", F.array(F.lit("")))).alias("provenance"))


@query("q230_chain_text", "SELECT o_orderkey AS id, 'f' || o_custkey || ' -> g -> ' || o_orderstatus AS chain FROM orders")
def chain_text(spark, sf_dir):
    from ..operators.graph import chain_text as joined

    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), joined(F.array(filled("fKEY", F.col("o_custkey")), F.lit("g"), F.col("o_orderstatus"))).alias("chain"))
