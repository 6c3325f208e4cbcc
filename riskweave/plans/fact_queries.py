"""Queries of smaller predicates and facts: paths, names, usage, contexts, scanner runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, packages, paths, patterns, scores
from ..operators import findings, joins, rollups
from ..session import table
from ..sources import repo, rules
from ..streaming import events
from .bindings import DEPENDENCIES, FILES, FINDINGS, frame, sql
from .column_queries import _NORMAL
from .registry import query
from .source_queries import filled


def _contains(value: str, terms) -> str:
    return "(" + " OR ".join(f"contains({value}, '{t}')" for t in terms) + ")"


@query("q093_low_context", f"SELECT file_id, {_contains(f'concat(chr(47), lower({_NORMAL}))', fixed.LOW_CONTEXT)} AS low FROM {sql(FILES)}")
def low_context(spark, sf_dir):
    return frame(spark, sf_dir, FILES).select("file_id", paths.low_context(F.col("path")).alias("low"))


@query("q155_manifest_candidates", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'm' || p_partkey || '/package.json' WHEN 1 THEN 'go.mod' WHEN 2 THEN 'a/b/Cargo.toml' END AS manifest FROM part")
def manifest_candidates(spark, sf_dir):
    key = F.col("p_partkey")
    lock = F.when(key % 4 == 0, filled("mKEY/yarn.lock", key)).when(key % 4 == 1, "go.sum").when(key % 4 == 2, "a/b/Cargo.lock").otherwise("x/other.lock")
    return table(spark, sf_dir, "part").select("p_partkey", paths.declaring_manifest(lock).alias("manifest"))


@query(
    "q013_doc_files",
    """
WITH g AS (SELECT 'docs/g' || p_partkey || '.md' AS path FROM part WHERE p_partkey NOT BETWEEN 1 AND 4 AND p_partkey % 2 = 0 ORDER BY path LIMIT 9),
h AS (SELECT 'doc/h' || p_partkey || '.md' AS path FROM part WHERE p_partkey NOT BETWEEN 1 AND 4 AND p_partkey % 2 = 1 ORDER BY path LIMIT 3)
SELECT unnest(['README.md', 'docs/api.md', 'Readme.old']) AS path UNION ALL SELECT path FROM g UNION ALL SELECT path FROM h""",
)
def doc_files(spark, sf_dir):
    """The documents of a tree that are read first."""
    key = F.col("p_partkey")
    path = F.when(key == 1, "README.md").when(key == 2, "Readme.old").when(key == 3, "docs/api.md").when(key == 4, "node_modules/docs/a.md").when(key % 2 == 0, filled("docs/gKEY.md", key)).otherwise(filled("doc/hKEY.md", key))
    return repo.documents(table(spark, sf_dir, "part").select(path.alias("path")))


@query("q300_candidate_confidence", "SELECT p_partkey, (CASE p_partkey % 3 WHEN 0 THEN p_size / 100 WHEN 1 THEN 0.5 ELSE 0 END)::DOUBLE AS confidence FROM part")
def candidate_confidence(spark, sf_dir):
    said = F.expr("CASE p_partkey % 3 WHEN 0 THEN cast(p_size / 100 as string) WHEN 1 THEN 'high' END")
    return table(spark, sf_dir, "part").select("p_partkey", scores.candidate_confidence(said).alias("confidence"))


@query("q149_names_overlap", "SELECT p_partkey, p_partkey % 2 = 0 AS overlap FROM part")
def names_overlap(spark, sf_dir):
    """May two spellings mean one package?"""
    key = F.col("p_partkey")
    other = F.when(key % 2 == 0, filled("My-Pkg-KEY", key)).otherwise(filled("my-pkgKEY", key))
    return table(spark, sf_dir, "part").select("p_partkey", packages.keys_overlap(filled("my_pkg.KEY", key), other, F.lit("pypi")).alias("overlap"))


@query("q277_function_keys", "SELECT p_partkey, ['foo', 'bar', 'baz' || p_partkey] AS keys FROM part")
def function_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", packages.function_keys(filled("Foo.Bar::bazKEY<T>(x, y)", F.col("p_partkey"))).alias("keys"))


@query("q217_same_directory", "SELECT p_partkey, p_partkey % 3 = p_size % 3 AS related FROM part")
def same_directory(spark, sf_dir):
    a, b = filled("a/KEY/x.py", F.col("p_partkey") % 3), filled("a\\KEY\\y.py", F.col("p_size") % 3)
    return table(spark, sf_dir, "part").select("p_partkey", paths.same_directory(a, b).alias("related"))


@query("q069_target_files", f"SELECT file_id FROM {sql(FILES)} WHERE suffix(lower(path), '.py') OR suffix(lower(path), '.js')")
def target_files(spark, sf_dir):
    return rules.scannable(frame(spark, sf_dir, FILES), [".py", ".js"]).select("file_id")


@query("q077_package_signals", f"SELECT DISTINCT lower(name) AS signal FROM {sql(DEPENDENCIES)} WHERE ecosystem = 'npm' UNION SELECT unnest(CASE WHEN contains(lower(text), 'license') THEN ['license'] ELSE [] END || CASE WHEN contains(lower(text), 'token') THEN ['token'] ELSE [] END) FROM documents")
def package_signals(spark, sf_dir):
    """Packages by the names of dependencies and by mentions in manifests."""
    texts = table(spark, sf_dir, "documents").select(F.col("text").alias("content"))
    return rules.signals(frame(spark, sf_dir, DEPENDENCIES), texts, ["license", "token", "no such word"])


@query("q071_scanner_status", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'completed' END AS status FROM part")
def scanner_status(spark, sf_dir):
    runs = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 3 > 0 AS success", "CASE WHEN p_partkey % 3 = 1 THEN array('timeout') ELSE cast(array() as array<string>) END AS errors")
    return rollups.coverage_status(runs).select("p_partkey", "status")


@query("q170_touchpoints", "SELECT 'lib' || o_custkey % 20 AS module, count(DISTINCT o_orderkey % 50) AS files, list_sort(list_distinct(list('f' || lpad((o_orderkey % 50)::VARCHAR, 2, '0'))))[1:3] AS first FROM orders GROUP BY 1")
def touchpoints(spark, sf_dir):
    """External modules with the files that import them."""
    file = F.concat(F.lit("f"), F.lpad((F.col("o_orderkey") % 50).cast("string"), 2, "0"))
    return rollups.touchpoints(table(spark, sf_dir, "orders").select(filled("libKEY.part.name", F.col("o_custkey") % 20).alias("import_module"), file.alias("source_file"), F.lit(True).alias("is_external")))


@query(
    "q285_dependency_relevance",
    f"""
WITH h AS (SELECT l_partkey AS id, bool_or(l_linenumber <= 2 AND l_returnflag = 'A') AS direct, bool_or(l_linenumber <= 2 AND l_returnflag = 'N') AS referenced, bool_and(l_linenumber > 2) AS tested, bool_or(l_returnflag = 'R') AS called FROM lineitem GROUP BY 1)
SELECT d.id, CASE WHEN direct THEN 'used' WHEN referenced THEN 'likely_used' WHEN is_dev OR tested THEN 'test_only' WHEN d.id % 7 = 0 THEN 'transitive_only' ELSE 'unknown' END AS relevance, coalesce(called, false) AS function_hit FROM {sql(DEPENDENCIES)} d LEFT JOIN h ON d.id = h.id""",
)
def dependency_relevance(spark, sf_dir):
    """How dependencies are used, from the places that mention them."""
    hits = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS id", "concat(CASE WHEN l_linenumber > 2 THEN 'tests/f' ELSE 'src/f' END, cast(l_suppkey as string), '.py') AS file", "CASE l_returnflag WHEN 'A' THEN 'import' WHEN 'N' THEN 'reference' ELSE 'vulnerable_function' END AS kind", "'s' AS symbol")
    deps = frame(spark, sf_dir, DEPENDENCIES).withColumn("transitive", F.expr("id % 7 = 0"))
    return joins.usage(deps, hits).select("id", "relevance", "function_hit")


@query("q256_has_context", f"SELECT doc_id, {_contains('lower(text)', patterns.CONTEXT_TERMS)} AND {_contains('lower(text)', patterns.PATH_TERMS)} AS context FROM documents WHERE text IS NOT NULL")
def has_context(spark, sf_dir):
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", patterns.has_context(F.col("text"), none, none).alias("context"))


@query("q297_finding_text", f"SELECT finding_id, concat_ws(chr(10), nullif(title, ''), nullif(category, ''), nullif(cwe, '')) AS said FROM {sql(FINDINGS)}")
def finding_text(spark, sf_dir):
    return frame(spark, sf_dir, FINDINGS).select("finding_id", patterns.finding_text(F.col("title"), F.col("category"), F.col("cwe")).alias("said"))


@query("q211_hit_context", f"SELECT l_orderkey * 10 + l_linenumber AS hit_id FROM lineitem ORDER BY list_position(['{"', '".join(fixed.SCANNER_ORDER)}'], CASE l_returnflag WHEN 'A' THEN 'semgrep' WHEN 'N' THEN 'bandit' ELSE 'codeql' END), CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, l_suppkey, 1 LIMIT 60")
def hit_context(spark, sf_dir):
    """The hits that an investigation reads first."""
    hits = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS hit_id", "CASE l_returnflag WHEN 'A' THEN 'semgrep' WHEN 'N' THEN 'bandit' ELSE 'codeql' END AS scanner", "'high' AS severity", "l_linestatus = 'O' AS rich", "cast(l_suppkey as int) AS line")
    return findings.hit_context(hits).select("hit_id")


_OK = "(s.state = 'pending' AND e.want IN ('running', 'cancelled') OR s.state = 'running' AND e.want IN ('completed', 'failed', 'cancelled'))"
STATES_SQL = f"""
WITH RECURSIVE e AS (SELECT user_id AS scan_id, event_id, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'cancelled' END AS want, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT user_id AS scan_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 'pending' AS state, false AS accepted FROM events
  UNION ALL SELECT e.scan_id, e.n, e.event_id, CASE WHEN {_OK} THEN e.want ELSE s.state END, {_OK} FROM s JOIN e ON e.scan_id = s.scan_id AND e.n = s.n + 1)
SELECT scan_id, event_id, state, accepted FROM s WHERE n > 0"""


@query("q313_state_machine", STATES_SQL)
def state_machine(spark, sf_dir):
    """State requests of scans, each with the state that it leaves."""
    state = F.expr("CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'cancelled' END")
    return events.checked_transitions(table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), "event_id", state.alias("state")))
