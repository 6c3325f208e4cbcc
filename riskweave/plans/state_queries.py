"""Queries of shards that are written and read, export rows, kept observations, pages and touchpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings, planning, reports, rollups
from ..session import table
from ..sinks import round_trip
from ..sources import advisories, structure
from ..streaming import events
from .bindings import FINDINGS, frame, sql
from .finding_queries import ORDER
from .registry import query
from .source_queries import files_of_parts, filled

FIND = sql(FINDINGS)


@query("q014_advisory_shards", "SELECT 'A' || p_partkey AS id, p_name AS package, CASE WHEN p_partkey % 2 = 0 THEN ['own', 'f'] ELSE ['own'] END AS vulnerable_functions FROM part WHERE p_size % 2 = 0")
def advisory_shards(spark, sf_dir):
    """The advisories of one ecosystem, from shards of compressed JSON by ecosystem, with their enrichment."""
    rows = table(spark, sf_dir, "part").selectExpr("concat('A', cast(p_partkey as string)) AS id", "p_name AS package", "array('own') AS vulnerable_functions", "CASE WHEN p_size % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem")
    stored = round_trip(rows, "json", "ecosystem").where("ecosystem = 'npm'")
    payload = filled('{"advisories":{"AKEY":{"vulnerable_functions":["f"],"vulnerable_symbols":[]}}}', F.col("p_partkey"))
    more = advisories.enrichment_rows(table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(payload.alias("payload")))
    return advisories.enrich(stored, more).select("id", "package", "vulnerable_functions")


@query("q023_broken_shards", "SELECT p_partkey AS id FROM part WHERE p_partkey % 3 > 0")
def broken_shards(spark, sf_dir):
    """JSON texts that parse; of the others there is no row."""
    raw = F.when(F.col("p_partkey") % 3 > 0, filled('{"id": KEY}', F.col("p_partkey"))).otherwise(filled('{"id": KEY', F.col("p_partkey")))
    return advisories.parsed(table(spark, sf_dir, "part").select(raw.alias("payload")), "id long")


@query("q173_config_touchpoints", "SELECT 'm' || p_partkey || '/login_cfg.py' AS path, CASE WHEN p_partkey % 2 = 0 THEN ['auth', 'config'] ELSE ['auth'] END AS labels FROM part")
def config_touchpoints(spark, sf_dir):
    """Files whose path or imports speak of authentication, configuration or secrets."""
    content = F.when(F.col("p_partkey") % 2 == 0, "import app.Settings\n").otherwise("import os\n")
    files = table(spark, sf_dir, "part").select(filled("mKEY/login_cfg.py", F.col("p_partkey")).alias("path"), content.alias("content"), F.lit("python").alias("language"))
    return rollups.security_touchpoints(structure.facts(files))


@query("q184_duplicate_pairs", f"""
WITH f AS (SELECT scan_id, finding_id, start_line AS a, end_line AS b, cwe, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda t: length(t) >= 3)) AS w, lower(title) AS t FROM {FIND})
SELECT x.finding_id AS a, y.finding_id AS b FROM f x JOIN f y ON x.scan_id = y.scan_id AND x.finding_id < y.finding_id
WHERE (x.a <= y.b AND y.a <= x.b) OR x.cwe = y.cwe OR len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)) >= 0.55""")
def duplicate_pairs(spark, sf_dir):
    """Pairs of a scan's findings that probably are one."""
    rows = frame(spark, sf_dir, FINDINGS).select("scan_id", "finding_id", "title", F.format_string("%d-%d", "start_line", "end_line").alias("line_range"), F.array_compact(F.array("cwe")).alias("cwe_ids"))
    return findings.duplicate_pairs(rows, "scan_id")


_OTHERS = {
    "go": ("a.go", "package p\n\ntype TKEY struct {}\n\nfunc (t *TKEY) RunKEY(x int) {\n\tgo1(x)\n}\n", "go"),
    "rust": ("a.rs", "use std::io;\npub struct TKEY;\nfn runKEY(x: i32) {\n  go1(x);\n}\n", "rust"),
    "ruby": ("a.rb", "require 'json'\nclass TKEY\n  def runKEY(x)\n    go1(x)\n  end\nend\n", "ruby"),
}


@query("q249_other_languages", " UNION ALL ".join(f"SELECT 'm' || p_partkey || '/{name}' AS path, '{kind}' AS kind, {value} AS name, {line}::INT AS line FROM part" for name, rows in (("a.go", [("class", "'T' || p_partkey", 3), ("function", "'Run' || p_partkey", 5), ("call", "'go1'", 6)]), ("a.rs", [("import", "'std::io'", 1), ("class", "'T' || p_partkey", 2), ("function", "'run' || p_partkey", 3), ("call", "'go1'", 4)]), ("a.rb", [("import", "'json'", 1), ("class", "'T' || p_partkey", 2), ("function", "'run' || p_partkey", 3), ("call", "'go1'", 4)])) for kind, value, line in rows))
def other_languages(spark, sf_dir):
    out = None
    for language, (name, content, _) in _OTHERS.items():
        some = structure.facts(files_of_parts(spark, sf_dir, name, content).withColumn("language", F.lit(language)))
        out = some if out is None else out.unionByName(some)
    return out.select("path", "kind", "name", "line")


@query("q312_polled_events", "SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 150")
def polled_events(spark, sf_dir):
    """Three pages of events, each asked for by the last id of the one before."""
    rows, after, out = table(spark, sf_dir, "events").select("event_id", "event_type"), 100, None
    for _ in range(3):
        page = events.page(rows, after, 50)
        after = page.agg(F.max("event_id")).first()[0] or after
        out = page if out is None else out.unionByName(page)
    return out


@query("q314_kept_observations", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def kept_observations(spark, sf_dir):
    """What stays of a context that is summarised: the newest observations, as many as the model's window
    allows."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(128000).alias("window"))
    return planning.kept_observations(rows, ["conv_id"], "turn").select("conv_id", "turn")


@query("q320_export_rows", f"SELECT scan_id, finding_id, place FROM (SELECT scan_id, finding_id, row_number() OVER (PARTITION BY scan_id ORDER BY {ORDER.replace('ELSE 5', 'ELSE 9')}, confidence DESC, finding_id) AS place FROM {FIND} WHERE status <> 'dismissed')")
def export_rows(spark, sf_dir):
    """The rows of each scan's export, in their order."""
    return reports.export_rows(frame(spark, sf_dir, FINDINGS)).select("scan_id", "finding_id", "place")


@query("q020_data_version", "SELECT '2024-' || min(p_size) AS version FROM part")
def data_version(spark, sf_dir):
    """The version of stored advisories: the first line of its file."""
    line = F.format_string("2024-%d", F.col("size"))
    text = table(spark, sf_dir, "part").agg(F.min("p_size").alias("size")).select(F.concat(F.lit(" "), line, F.lit("\nmore")).alias("value"))
    return advisories.version_of(text)
