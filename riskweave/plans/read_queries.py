"""Queries of what pages, tools and chats read, and of the evidence around a finding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, packages, patterns
from ..operators import findings as finding_ops
from ..operators import graph, joins, reads
from ..session import table
from .bindings import DEPENDENCIES, EDGES, FILES, FINDINGS, frame, sql
from .column_queries import _case
from .registry import query

#: Results of scanners: a file is known for three of four.
RESULTS = {
    "result_id": "l_orderkey * 10 + l_linenumber",
    "file_id": "case when l_partkey % 4 > 0 then l_partkey end",
    "scanner": "case l_returnflag when 'A' then 'semgrep' when 'N' then 'bandit' else 'codeql' end",
    "severity": "case when l_quantity > 35 then 'high' when l_quantity > 5 then 'low' end",
    "rule_id": "case when l_suppkey % 3 > 0 then concat('r', cast(l_suppkey % 3 as string)) end",
    "message": "case when l_linenumber > 1 then l_linestatus end",
    "start_line": "case when l_linenumber < 6 then cast(l_linenumber as int) end",
    "created_at": "l_shipdate",
}
_RESULTS = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in RESULTS.items()) + " FROM lineitem)"


def results(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in RESULTS.items()])


@query("q095_scanner_results", f"SELECT result_id, path AS file_path FROM {_RESULTS} r LEFT JOIN {sql(FILES)} f ON r.file_id = f.file_id WHERE scanner = 'semgrep' AND severity = 'high' ORDER BY created_at DESC, result_id DESC LIMIT 200")
def scanner_results(spark, sf_dir):
    return reads.scanner_results(results(spark, sf_dir), frame(spark, sf_dir, FILES), "semgrep", "high").select("result_id", "file_path")


#: The path of one of the files.
ONE_FILE = "src/payment/checkout36.JS"


@query("q101_hits_of_file", f"SELECT result_id, coalesce(rule_id, '') AS rule_id, coalesce(severity, 'info') AS severity, coalesce(message, '') AS message, coalesce(start_line, 0) AS start_line FROM {_RESULTS} WHERE file_id IN (SELECT file_id FROM {sql(FILES)} WHERE path IN (SELECT path FROM {sql(FILES)} WHERE file_id = 37)) ORDER BY created_at DESC, result_id DESC LIMIT 50")
def hits_of_file(spark, sf_dir):
    files = frame(spark, sf_dir, FILES)
    path = files.where("file_id = 37").first().path
    return reads.hits_of_file(results(spark, sf_dir), files, path).select("result_id", "rule_id", "severity", "message", "start_line")


@query("q096_secrets", f"SELECT o_orderkey AS id, o_orderpriority AS type, path AS file_path FROM (SELECT *, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS file_id FROM orders) o LEFT JOIN {sql(FILES)} f ON o.file_id = f.file_id")
def secrets_of_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS type", "CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS file_id")
    return reads.secrets_of_scan(rows, frame(spark, sf_dir, FILES))


@query("q105_finding_with_paths", f"SELECT l_orderkey AS finding_id, coalesce(list_sort(list_distinct(list(path))), []) AS file_paths FROM lineitem LEFT JOIN {sql(FILES)} ON l_partkey = file_id AND file_id % 3 = 0 GROUP BY 1")
def finding_with_paths(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    links = lines.select(F.col("l_orderkey").alias("finding_id"), F.col("l_partkey").alias("file_id"))
    return reads.with_paths(links.select("finding_id").distinct(), links, frame(spark, sf_dir, FILES).where("file_id % 3 = 0"))


_DEPS = "(SELECT p_partkey AS dependency_id, p_name AS name, p_brand AS version, 'npm' AS ecosystem FROM part)"
_DEP_FOUND = "(SELECT l_orderkey * 10 + l_linenumber AS finding_id, l_partkey AS dependency_id, case when l_suppkey % 4 > 0 then round(l_quantity * 7, 1) end AS risk_score, case when l_linenumber > 2 then 'high' end AS severity, concat('ADV-', cast(l_suppkey as string)) AS advisory_id, repeat('d', cast(l_quantity * 10 as int)) AS details FROM lineitem WHERE l_quantity > 20)"


def _dependency_rows(spark, sf_dir):
    deps = table(spark, sf_dir, "part").selectExpr("p_partkey AS dependency_id", "p_name AS name", "p_brand AS version", "'npm' AS ecosystem")
    found = table(spark, sf_dir, "lineitem").where("l_quantity > 20").selectExpr(
        "l_orderkey * 10 + l_linenumber AS finding_id", "l_partkey AS dependency_id", "case when l_suppkey % 4 > 0 then round(l_quantity * 7, 1) end AS risk_score", "case when l_linenumber > 2 then 'high' end AS severity",
        "concat('ADV-', cast(l_suppkey as string)) AS advisory_id", "cast(null as string) AS cve_id", "repeat('d', cast(l_quantity * 10 as int)) AS details", "array('a', 'b', 'c') AS references",
    )
    return found, deps


@query("q110_dependency_findings_joined", f"SELECT finding_id, name, risk_score FROM {_DEP_FOUND} JOIN {_DEPS} USING (dependency_id)")
def dependency_findings(spark, sf_dir):
    return reads.dependency_findings(*_dependency_rows(spark, sf_dir)).select("finding_id", "name", "risk_score")


@query("q108_dependency_cache", f"SELECT replace(lower(name), '-', '_') AS key, name AS package, version, ecosystem, advisory_id, '' AS cve_id, coalesce(severity, 'medium') AS severity, substr(details, 1, 300) AS details, ['a', 'b'] AS references, risk_score FROM {_DEP_FOUND} JOIN {_DEPS} USING (dependency_id)")
def dependency_cache(spark, sf_dir):
    return reads.dependency_cache(*_dependency_rows(spark, sf_dir))


_TOLD = "concat(title, case when finding_id % 50 = 0 then ' see Src/Web/F7.py' when finding_id % 61 = 0 then ' in f7.py' else '' end)"
_KNOWN = "lower(replace(path, chr(92), '/'))"


@query("q145_findings_of_file", f"SELECT finding_id FROM (SELECT *, {_TOLD} AS description FROM {sql(FINDINGS)}) f WHERE contains(lower(description), 'web/f7.py') OR contains(lower(description), 'f7.py') OR contains(lower(title), 'f7.py') OR finding_id IN (SELECT finding_id FROM {sql(FINDINGS)} WHERE suffix(file_path, 'web/f7.py'))")
def findings_of_file(spark, sf_dir):
    rows = frame(spark, sf_dir, FINDINGS)
    files = rows.select(F.col("file_path").alias("path")).distinct().withColumn("file_id", F.xxhash64("path"))
    links = rows.select("finding_id", F.xxhash64("file_path").alias("file_id"))
    told = rows.withColumn("description", F.expr(_TOLD)).withColumn("code_snippet", F.lit(None).cast("string"))
    return reads.findings_of_file(told, links, files, "web\\F7.py").select("finding_id")


@query("q146_finding_by_title", f"SELECT query, min(finding_id) AS finding_id FROM {sql(FINDINGS)}, (SELECT unnest(['NUMBER 7 ', 'module 3', 'number 96', 'nothing']) AS query) WHERE contains(lower(title), lower(query)) GROUP BY 1")
def finding_by_title(spark, sf_dir):
    asked = spark.createDataFrame([("NUMBER 7 ",), ("module 3",), ("number 96",), ("nothing",)], "query string")
    return reads.by_title(frame(spark, sf_dir, FINDINGS), asked)


_USED = "concat('left-pad', cast(o_custkey % 60 as string))"


@query(
    "q123_dependencies_of_files",
    f"""
WITH d AS (SELECT id, name AS package, id % 97 AS risk FROM {sql(DEPENDENCIES)} WHERE ecosystem = 'npm'),
f AS (SELECT o_orderkey AS file, {_USED} AS used, o_orderkey % 2 = 0 AS imports FROM orders),
g AS (SELECT *, imports AND used IN (SELECT lower(package) FROM d) AS known FROM f),
m AS (SELECT file, id, risk, package, CASE WHEN known THEN 0.95 ELSE 0.55 END::DOUBLE AS confidence FROM g JOIN d ON CASE WHEN known THEN lower(package) = used ELSE starts_with(used, lower(package)) END)
SELECT file, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY risk DESC, confidence DESC, package, id) AS r FROM m) WHERE r <= 5""",
)
def dependencies_of_files(spark, sf_dir):
    deps = frame(spark, sf_dir, DEPENDENCIES, "p_partkey % 4 = 1").selectExpr("id", "name AS package", "ecosystem", "id % 97 AS risk_score")
    orders = table(spark, sf_dir, "orders")
    imports = orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS file", f"concat({_USED}, '/x') AS import_module", "true AS is_external")
    files = orders.selectExpr("o_orderkey AS path", f"concat('const a = 1\\nconst b = Require(\\'', {_USED}, '\\')\\n') AS content")
    return reads.dependencies_of_files(deps, imports, files).select("file", "id", F.col("confidence"))


@query(
    "q120_best_dependency",
    f"""
WITH a AS (SELECT s_suppkey AS advisory_id, concat('my.pkg_', cast(s_suppkey % 80 as string)) AS package FROM supplier),
d AS (SELECT id, name, CASE WHEN id % 8 = 3 THEN 2 ELSE 1 END AS rank FROM {sql(DEPENDENCIES)} WHERE ecosystem = 'hex')
SELECT advisory_id, first(id ORDER BY rank DESC, id) AS id, CASE WHEN max(rank) = 2 THEN 'strong' ELSE 'medium' END AS strength FROM a JOIN d ON replace(replace(package, '.', '-'), '_', '-') = replace(name, '.', '-') GROUP BY 1""",
)
def best_dependency(spark, sf_dir):
    low = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS advisory_id", "concat('my.pkg_', cast(s_suppkey % 80 as string)) AS package", "'Hex' AS ecosystem")
    deps = frame(spark, sf_dir, DEPENDENCIES, "p_partkey % 4 = 3").selectExpr("id", "name AS package", "ecosystem", "CASE WHEN id % 8 = 3 THEN 'import_graph' ELSE 'text' END AS source")
    return reads.best_dependency(low, deps)


@query(
    "q121_best_import",
    """
WITH a AS (SELECT p_partkey AS advisory_id, p_partkey % 40 AS k, p_size % 3 AS kind FROM part),
i AS (SELECT DISTINCT s_suppkey % 50 AS k FROM supplier)
SELECT advisory_id, CASE kind WHEN 0 THEN 'pkg' || k || '/sub' WHEN 1 THEN 'hint' || k ELSE 'hint' || k END AS import_module, (CASE kind WHEN 0 THEN 0.95 WHEN 1 THEN 1.0 ELSE 0.97 END)::DOUBLE AS confidence FROM a JOIN i USING (k)""",
)
def best_import(spark, sf_dir):
    low = table(spark, sf_dir, "part").selectExpr("p_partkey AS advisory_id", "concat('Pkg', cast(p_partkey % 40 as string)) AS package", "'npm' AS ecosystem", "CASE p_size % 3 WHEN 0 THEN array('other') WHEN 1 THEN array(concat('Hint', cast(p_partkey % 40 as string))) ELSE array(concat('hint', cast(p_partkey % 40 as string), '.deep.er')) END AS hints")
    names = table(spark, sf_dir, "supplier").selectExpr("explode(array(concat('pkg', cast(s_suppkey % 50 as string), '/sub'), concat('hint', cast(s_suppkey % 50 as string)))) AS import_module", "true AS is_external")
    return reads.best_import(low, names)


@query("q150_external_imports", "SELECT o_orderkey AS id, 'm' || o_custkey % 9 AS import_module, CASE o_custkey % 3 WHEN 0 THEN ['a', 'B'] WHEN 1 THEN ['a'] ELSE [] END AS imported_names, CASE WHEN o_custkey % 4 > 0 THEN o_custkey ELSE 0 END AS line FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey % 9 > 0")
def external_imports(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_custkey % 9 > 0 THEN concat('m', cast(o_custkey % 9 as string)) ELSE '' END AS import_module", "CASE o_custkey % 3 WHEN 0 THEN array(' a ', '', 'B') WHEN 1 THEN array('a', ' ') END AS imported_names", "o_orderkey % 3 > 0 AS is_external", "CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS line")
    return reads.external_imports(rows).select("id", "import_module", "imported_names", "line")


@query("q151_import_hints", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN ['aim.' || p_size % 5] WHEN p_partkey % 3 = 1 THEN list_sort(list_distinct(['aim.' || p_size % 5, 'far.' || p_size % 4, 'path.x'])) ELSE list_sort(list_distinct(['aim.' || p_size % 5, 'far.' || p_size % 4])) END AS hints FROM part")
def import_hints(spark, sf_dir):
    symbols = F.expr("array(named_struct('symbol', 'Mod::load(x)', 'import_path', concat(' Aim.', cast(p_size % 5 as string))), named_struct('symbol', 'other', 'import_path', concat('far.', cast(p_size % 4 as string))), named_struct('symbol', 'load', 'import_path', ''))")
    paths = F.expr("CASE WHEN p_partkey % 3 = 1 THEN array('', ' path.X') END")
    word = F.expr("CASE WHEN p_partkey % 3 = 0 THEN ' Load' ELSE 'none' END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), reads.import_hints(symbols, paths, word).alias("hints"))


@query("q278_hint_confidence", "SELECT p_partkey AS id, (CASE p_partkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.99 WHEN 2 THEN 0.99 WHEN 3 THEN 0.97 ELSE 0.0 END)::DOUBLE AS confidence FROM part")
def hint_confidence(spark, sf_dir):
    module = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'A.b' WHEN 1 THEN 'a.b.c' WHEN 2 THEN 'a.b/c' WHEN 3 THEN 'a' WHEN 4 THEN 'a.bc' END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), reads.hint_confidence(module, F.lit(" a.B ")).alias("confidence"))


@query(
    "q153_entry_points_of_findings",
    f"""
WITH f AS (SELECT finding_id, file_path, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS home, 'calls handler_' || finding_id % 211 || '() now' AS snippet FROM {sql(FINDINGS)} WHERE finding_id % 5 = 0),
e AS (SELECT s_suppkey AS entry_id, 'src/' || CASE s_suppkey % 4 WHEN 0 THEN 'api2/in' WHEN 1 THEN 'web' WHEN 2 THEN 'none' ELSE 'core' END || '/f' || s_suppkey % 50 || '.py' AS file, 'handler_' || s_suppkey AS fn FROM supplier)
SELECT DISTINCT finding_id, entry_id FROM f JOIN e ON e.file = f.file_path OR starts_with(e.file, f.home) OR contains(snippet, e.fn || '()')""",
)
def entry_points_of_findings(spark, sf_dir):
    rows = frame(spark, sf_dir, FINDINGS).where("finding_id % 5 = 0").selectExpr("finding_id", "file_path", "concat('calls handler_', cast(finding_id % 211 as string), '() now') AS code_snippet", "'' AS hypothesis")
    entries = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS entry_id", "concat('src/', CASE s_suppkey % 4 WHEN 0 THEN 'api2/in' WHEN 1 THEN 'web' WHEN 2 THEN 'none' ELSE 'core' END, '/f', cast(s_suppkey % 50 as string), '.py') AS file", "concat('handler_', cast(s_suppkey as string)) AS function")
    return reads.entry_points_of_findings(rows, entries)


@query("q290_strong_signals", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 IN (1, 2, 3) THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size >= 45 THEN 1 ELSE 0 END AS signals FROM part")
def strong_signals(spark, sf_dir):
    related = F.expr("CASE p_partkey % 5 WHEN 0 THEN array() WHEN 1 THEN array(named_struct('evidence_strength', 'Strong', 'evidence_type', 'x')) WHEN 2 THEN array(named_struct('evidence_strength', 'medium', 'evidence_type', '')) WHEN 3 THEN array(named_struct('evidence_strength', 'weak', 'evidence_type', 'Confirmed_match')) ELSE array(named_struct('evidence_strength', 'weak', 'evidence_type', 'match')) END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), reads.strong_signals(F.expr("p_partkey % 2 = 0"), related.cast("array<struct<evidence_strength:string,evidence_type:string>>"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN true END"), F.expr("p_size / 50D")).alias("signals"))


_LEVEL = "case finding_id % 4 when 0 then 'hypothesis' when 1 then 'statically_verified' when 2 then 'runtime_validated' else 'strongly_verified' end"


@query("q292_finalised", f"SELECT finding_id, CASE WHEN signals >= 2 THEN 'strongly_verified' WHEN level = 'hypothesis' THEN 'statically_verified' ELSE level END AS verification_level, CASE WHEN signals = 0 AND confidence < 0.65 AND severity = 'critical' THEN 'high' WHEN signals = 0 AND confidence < 0.65 AND severity = 'high' THEN 'medium' ELSE severity END AS severity FROM (SELECT *, finding_id % 3 AS signals, {_LEVEL} AS level FROM {sql(FINDINGS)} WHERE status = 'confirmed')")
def finalised(spark, sf_dir):
    rows = frame(spark, sf_dir, FINDINGS).where("status = 'confirmed'").withColumn("signals", F.expr("finding_id % 3")).withColumn("verification_level", F.expr(_LEVEL))
    return reads.finalised(rows).select("finding_id", "verification_level", "severity")


@query("q299_dismissed", f"SELECT finding_id, CASE WHEN d THEN 'dismissed' ELSE status END AS status, CASE WHEN d THEN 'info' ELSE severity END AS severity, CASE WHEN d THEN least(confidence, 0.1) ELSE confidence END::DOUBLE AS confidence, CASE WHEN d AND finding_id % 2 = 0 THEN 'old' || chr(10) || chr(10) || 'no path' WHEN d THEN 'no path' WHEN finding_id % 2 = 0 THEN 'old' END AS verification_notes, CASE WHEN d THEN ['no path'] ELSE [] END AS opposing_evidence FROM (SELECT *, severity = 'low' AS d FROM {sql(FINDINGS)})")
def dismissed(spark, sf_dir):
    rows = frame(spark, sf_dir, FINDINGS).withColumns({"verification_notes": F.expr("CASE WHEN finding_id % 2 = 0 THEN 'old' END"), "opposing_evidence": F.array().cast("array<string>"), "verification_level": F.lit("hypothesis")})
    return reads.dismissed(rows, F.lit("no path"), F.col("severity") == "low").select("finding_id", "status", "severity", "confidence", "verification_notes", "opposing_evidence")


@query("q255_needs_flow", f"SELECT finding_id, coalesce(category IN ('injection', 'xss', 'ssrf', 'deserialization', 'command_exec'), false) AND category <> 'command_exec' OR finding_id % 7 = 0 AS needs FROM {sql(FINDINGS)}")
def needs_flow(spark, sf_dir):
    rows = frame(spark, sf_dir, FINDINGS)
    return rows.select("finding_id", reads.needs_flow(F.col("title"), F.col("category"), F.expr("CASE WHEN finding_id % 7 = 0 THEN 'a Path Traversal' ELSE '' END")).alias("needs"))


@query("q200_union_by_keys", "SELECT l_orderkey, first(l_linenumber ORDER BY l_linenumber) AS l_linenumber, lower(trim(l_shipmode)) AS mode FROM (SELECT l_orderkey, l_linenumber, CASE l_suppkey % 4 WHEN 0 THEN ' Air' WHEN 1 THEN 'AIR ' WHEN 2 THEN '' ELSE 'ship' END AS l_shipmode FROM lineitem) GROUP BY 1, 3")
def union_by_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE l_suppkey % 4 WHEN 0 THEN ' Air' WHEN 1 THEN 'AIR ' WHEN 2 THEN null ELSE 'ship' END AS mode")
    out = reads.merged_by_keys(rows, ["l_orderkey", "mode"], [F.col("l_linenumber")])
    return out.select("l_orderkey", "l_linenumber", F.lower(F.trim(F.coalesce("mode", F.lit("")))).alias("mode"))


@query("q104_scanner_config", "SELECT p_partkey AS id, NOT (p_partkey % 2 = 0) AS semgrep, p_size % 2 = 0 AS dep_audit, true AS bandit FROM part")
def scanner_config(spark, sf_dir):
    raw = F.expr("CASE WHEN p_partkey % 2 = 0 THEN map(' SemGrep', false, 'unknown', false, 'Dependencies', p_size % 2 = 0) ELSE map('dependency', true, 'dep_audit', p_size % 2 = 0) END")
    c = reads.scanner_config(raw)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[c[n].alias(n) for n in ("semgrep", "dep_audit", "bandit")])


@query("q152_components_of_findings", "SELECT DISTINCT finding_id, component FROM " + sql(FINDINGS) + " f JOIN (VALUES ('API', 'src/api'), ('Core', 'src/core/d'), ('All', 'src')) c(component, prefix) ON starts_with(f.file_path, c.prefix)")
def components_of_findings(spark, sf_dir):
    from ..operators import rollups

    parts = spark.createDataFrame([("API", ["src/api"]), ("Core", ["src/core/d"]), ("All", ["src", "src/"])], "component string, files array<string>")
    return rollups.in_component(frame(spark, sf_dir, FINDINGS), parts, separator=False).select("finding_id", "component").distinct()


@query("q141_findings_in_components", "SELECT finding_id, component FROM " + sql(FINDINGS) + " f JOIN (VALUES ('API', 'src/api'), ('Db', 'src/core/db'), ('File', 'src/web/f7.py')) c(component, prefix) ON f.file_path = prefix OR starts_with(f.file_path, prefix || '/')")
def findings_in_components(spark, sf_dir):
    from ..operators import rollups

    parts = spark.createDataFrame([("API", ["src/api"]), ("Db", ["src/core/db"]), ("File", ["src/web/f7.py"])], "component string, files array<string>")
    return rollups.in_component(frame(spark, sf_dir, FINDINGS), parts, separator=True).select("finding_id", "component")


_PATH_NODES = "(SELECT edge_id, caller, callee FROM " + sql(EDGES) + ")"


@query("q223_file_calls", f"SELECT 'incoming' AS side, caller AS other, edge_id FROM {_PATH_NODES} WHERE callee = 'f12' UNION ALL SELECT 'outgoing', callee, edge_id FROM {_PATH_NODES} WHERE caller = 'f12'")
def file_calls(spark, sf_dir):
    return graph.calls_of(frame(spark, sf_dir, EDGES), "f12").select("side", "other", "edge_id")


@query("q169_file_call_totals", f"SELECT node, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing FROM (SELECT callee AS node, 1 AS i, 0 AS o FROM {_PATH_NODES} UNION ALL SELECT caller, 0, 1 FROM {_PATH_NODES}) GROUP BY 1")
def file_call_totals(spark, sf_dir):
    return graph.call_totals(frame(spark, sf_dir, EDGES))


@query("q252_placeholder_values", "SELECT p_partkey AS id, p_partkey % 4 IN (0, 1) AS placeholder FROM part")
def placeholder_values(spark, sf_dir):
    value = F.expr("CASE p_partkey % 4 WHEN 0 THEN '\"changeme\"' WHEN 1 THEN concat('$', '{SECRET}') WHEN 2 THEN md5(p_name) ELSE 'hunter2!' END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), patterns.placeholder(value).alias("placeholder"))


@query("q085_binary_extension", "SELECT p_partkey AS id, p_partkey % 5 IN (0, 2) AS is_binary FROM part")
def binary_extension(spark, sf_dir):
    from ..functions import paths

    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), paths.is_binary(F.expr("CASE p_partkey % 5 WHEN 0 THEN 'a/b.PNG' WHEN 1 THEN 'x.py' WHEN 2 THEN 'lib.tar.gz' WHEN 3 THEN '.png' ELSE 'png' END")).alias("is_binary"))


@query("q089_match_glob", f"SELECT file_id, regexp_matches(path, '(^|/)[^/]*\\.md$') AS md, regexp_matches(path, '(^|/)test[^/]*/[^/]*thing[^/]*$') AS tests FROM {sql(FILES)}")
def match_glob(spark, sf_dir):
    from ..functions.paths import glob_regex

    p = F.col("path")
    return frame(spark, sf_dir, FILES).select("file_id", p.rlike(glob_regex("*.md")).alias("md"), p.rlike(glob_regex("test*/*thing*")).alias("tests"))


@query("q091_reviewable_path", f"SELECT p_partkey AS id, p_partkey % 5 IN (0, 1, 2) AS reviewable FROM part")
def reviewable_path(spark, sf_dir):
    from ..functions import paths

    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), paths.reviewable(F.expr("CASE p_partkey % 5 WHEN 0 THEN 'x/Dockerfile' WHEN 1 THEN ' conf/App.YAML' WHEN 2 THEN 'a\\\\.env.local' WHEN 3 THEN '.env.example' ELSE 'src/a.py' END")).alias("reviewable"))


@query("q107_upload_path", f"SELECT p_partkey AS id, p_partkey % 4 IN (1, 2) AS ignored FROM part")
def upload_path(spark, sf_dir):
    from ..functions import paths

    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), paths.skipped(F.expr("CASE p_partkey % 4 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'x\\\\node_modules\\\\y.js' WHEN 2 THEN '/dist/app.js' ELSE 'my_dist/app.js' END")).alias("ignored"))


@query("q204_severity_rank", f"SELECT finding_id, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END AS place FROM {sql(FINDINGS)}")
def severity_order(spark, sf_dir):
    return frame(spark, sf_dir, FINDINGS).select("finding_id", finding_ops.severity_order(F.col("severity")).alias("place"))


@query("q302_usage_tokens", f"SELECT id, list_sort(list_distinct([lower(name), replace(lower(name), '-', '_'), replace(lower(name), '-', '/')])) AS tokens FROM {sql(DEPENDENCIES)} WHERE ecosystem = 'npm'")
def usage_tokens(spark, sf_dir):
    return frame(spark, sf_dir, DEPENDENCIES, "p_partkey % 4 = 1").select("id", F.array_sort(packages.usage_tokens(F.col("name"), F.col("ecosystem"))).alias("tokens"))


@query("q289_normal_states", f"SELECT p_partkey AS id, {_case('raw', {k.upper(): v for k, v in fixed.RELEVANCE_NAMES.items()}, "'unknown'")} AS relevance, CASE WHEN p_size % 2 = 0 THEN 'no_path_found' ELSE 'unknown' END AS reachability FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'IN_USE' WHEN 1 THEN 'TRANSITIVE' WHEN 2 THEN 'LIKELY-IN-USE' WHEN 3 THEN 'TEST_ONLY' ELSE 'WHAT' END AS raw FROM part)")
def normal_states(spark, sf_dir):
    from ..functions import scores

    raw = F.expr("CASE p_partkey % 5 WHEN 0 THEN ' in_use' WHEN 1 THEN 'Transitive' WHEN 2 THEN 'likely-in-use ' WHEN 3 THEN 'test_only' ELSE 'what' END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scores.normal_relevance(raw).alias("relevance"), scores.normal_reachability(F.expr("CASE WHEN p_size % 2 = 0 THEN 'Not_Reachable' ELSE '?' END")).alias("reachability"))


@query("q195_usage_hits", "SELECT DISTINCT l_orderkey AS id, 'f' || l_partkey % 7 AS file, CASE WHEN l_linenumber % 2 = 0 THEN 'import' ELSE 'reference' END AS kind, 's' || l_suppkey % 2 AS symbol FROM lineitem")
def usage_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "concat('f', cast(l_partkey % 7 as string)) AS file", "CASE WHEN l_linenumber % 2 = 0 THEN 'import' ELSE 'reference' END AS kind", "concat('s', cast(l_suppkey % 2 as string)) AS symbol", "l_quantity AS line")
    return joins.distinct_hits(rows).select("id", "file", "kind", "symbol")


@query("q124_import_usage", f"SELECT DISTINCT id, o_orderkey AS source_file, 0.95::DOUBLE AS confidence, 'import' AS kind FROM {sql(DEPENDENCIES)} JOIN orders ON ecosystem = 'npm' AND lower(name) = {_USED}")
def import_usage(spark, sf_dir):
    imports = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS source_file", f"concat({_USED}, '/x') AS import_module", "true AS is_external", "1 AS line")
    return joins.imports_of_packages(frame(spark, sf_dir, DEPENDENCIES, "p_partkey % 4 = 1"), imports).select("id", "source_file", "confidence", "kind")
