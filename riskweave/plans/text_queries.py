"""Queries of pattern scans, version ranges and source structure over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import packages, patterns
from ..functions.versions import version_in_range
from ..operators import joins
from ..session import table
from .bindings import DEPENDENCIES, frame, sql
from .registry import query


@query("q252_placeholder_secret", r"""
SELECT conv_id, turn, v IN ('', 'test', 'none', 'key') OR regexp_matches(v, '^(your|my|example|sample|dummy|fake|test|demo|placeholder)[_-]?.*') OR regexp_matches(v, '^\*{4,}$') AS placeholder
FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'your-' || conv_id WHEN 2 THEN '****' WHEN 3 THEN md5(text) ELSE 'none' END AS v FROM conversations)""")
def placeholder_secret(spark, sf_dir):
    value = F.expr("CASE turn % 5 WHEN 0 THEN ' test,' WHEN 1 THEN concat('\"your-', conv_id, '\"') WHEN 2 THEN '****' WHEN 3 THEN md5(text) ELSE 'none' END")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", patterns.placeholder(value).alias("placeholder"))


@query("q254_secret_terms", "SELECT doc_id, regexp_matches(lower(text), 'secret|credential|password|passwd|pwd|token|api key|api_key|apikey|client secret') AS secret, regexp_matches(lower(text), 'injection|xss|cross-site scripting|command exec|command execution|rce|path traversal|directory traversal|ssrf|server-side request forgery|template injection|deserial|xxe|open redirect') AS needs_flow FROM documents")
def secret_terms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", patterns.mentions(t, patterns.SECRET_TERMS).alias("secret"), patterns.mentions(t, patterns.DATA_FLOW_TERMS).alias("needs_flow"))


def _all(pattern: str) -> str:
    return "regexp_extract_all(text, '" + pattern.replace("'", "''") + "', 2)"


@query("q253_assigned_secrets", f"SELECT doc_id, unnest({_all(patterns.ASSIGNED_QUOTED)} || {_all(patterns.ASSIGNED_BARE)}) AS value FROM documents")
def assigned_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", patterns.assigned_values(F.col("text")).alias("v"))
    return docs.select("doc_id", F.explode("v").alias("value"))


#: What stands at the very end of every text: two mentions of one package, and one of another.
MENTIONS = "concat(coalesce(text, ''), ' built with jQuery v', cast(doc_id % 5 as string), '.2.1 (not jquery ', cast(doc_id % 3 as string), '.0) and Django/', cast(doc_id % 4 as string), '.1.')"


@query("q055_technologies", "SELECT DISTINCT doc_id, package, ecosystem, version FROM (SELECT doc_id, 'jquery' AS package, 'npm' AS ecosystem, doc_id % 5 || '.2.1' AS version FROM documents UNION ALL SELECT doc_id, 'jquery', 'npm', doc_id % 3 || '.0' FROM documents UNION ALL SELECT doc_id, 'django', 'pypi', doc_id % 4 || '.1' FROM documents)")
def technologies(spark, sf_dir):
    """Versions are found wherever a text mentions them: whole texts are read."""
    return patterns.technologies(table(spark, sf_dir, "documents").selectExpr("doc_id", f"{MENTIONS} AS text"), "text", ["doc_id"])


RANGES = "(SELECT CAST(p_partkey AS BIGINT) AS id, concat(cast(p_size % 5 as string), '.', cast(p_size % 12 as string), '.', cast(p_partkey % 3 as string)) AS version, concat('>=1.', cast(p_partkey % 10 as string), '.0,<3.', cast(p_partkey % 7 as string), '.0') AS affected FROM part)"
_KEY = "list_transform(string_split({v}, '.'), lambda x: x::INT)"


@query("q269_version_in_range", f"SELECT id, {_KEY.format(v='version')} >= {_KEY.format(v='string_split(affected[3:], chr(44))[1]')} AND {_KEY.format(v='version')} < {_KEY.format(v='string_split(affected, chr(60))[2]')} AS affected FROM {RANGES}")
def in_range(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat(cast(p_size % 5 as string), '.', cast(p_size % 12 as string), '.', cast(p_partkey % 3 as string)) AS version", "concat('>=1.', cast(p_partkey % 10 as string), '.0,<3.', cast(p_partkey % 7 as string), '.0') AS affected")
    return rows.select("id", version_in_range("version", "affected", F.lit("npm")).alias("affected"))


ADVISORY = "concat('ADV-', cast(s_suppkey as string))"


@query("q114_package_audit", f"""
WITH d AS (SELECT id, ecosystem, lower(trim(name)) AS name, p_size % 5 AS major FROM {sql(DEPENDENCIES)} JOIN part ON p_partkey = id WHERE ecosystem = 'npm' AND NOT starts_with(version, 'file:')),
a AS (SELECT {ADVISORY} AS advisory_id, concat('left-pad', cast(s_suppkey % 60 as string)) AS package, s_suppkey % 4 AS below FROM supplier)
SELECT id, advisory_id, 'exact_package_match' AS match_type FROM d JOIN a ON d.name = a.package WHERE d.major < a.below""")
def package_audit(spark, sf_dir):
    deps = frame(spark, sf_dir, DEPENDENCIES).withColumn("version", packages.clean_version(F.col("version"))).where("version <> ''")
    low = table(spark, sf_dir, "supplier").selectExpr(f"{ADVISORY} AS id", "'npm' AS ecosystem", "concat('Left-Pad', cast(s_suppkey % 60 as string)) AS package", "'high' AS severity", "'' AS details", "array('u') AS references", "cast(null as array<string>) AS affected_ranges", "concat('<', cast(s_suppkey % 4 as string), '.0.0') AS affected_range", "cast(null as array<string>) AS affected_versions")
    return joins.audit(deps, low).select("id", "advisory_id", "match_type")


@query("q117_by_weakness", "WITH i AS (SELECT * FROM (SELECT s_suppkey % 6 AS cwe, concat('ADV-', lpad(cast(s_suppkey as string), 6, '0')) AS advisory_id, row_number() OVER (PARTITION BY s_suppkey % 6 ORDER BY lpad(cast(s_suppkey as string), 6, '0')) AS r FROM supplier) WHERE r <= 10) SELECT p_partkey AS finding_id, advisory_id FROM (SELECT p_partkey, advisory_id, row_number() OVER (PARTITION BY p_partkey ORDER BY advisory_id) AS r FROM part JOIN i ON p_partkey % 6 = i.cwe) WHERE r <= 5")
def by_weakness(spark, sf_dir):
    found = table(spark, sf_dir, "part").selectExpr("p_partkey AS finding_id", "array(cast(p_partkey % 6 as string)) AS cwe_ids")
    low = table(spark, sf_dir, "supplier").selectExpr("concat('ADV-', lpad(cast(s_suppkey as string), 6, '0')) AS id", "'npm' AS ecosystem", "array(cast(s_suppkey % 6 as string)) AS cwes")
    return joins.by_weakness(found, low).select("finding_id", "advisory_id")


@query("q139_enclosing_symbol", "WITH s AS (SELECT l_orderkey AS file, l_linenumber * 1000000 + l_partkey AS name, l_partkey % 400 AS a, l_partkey % 400 + 5 + l_linenumber * 9 AS b FROM lineitem) SELECT DISTINCT line_id, name FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY b - a, a DESC, name) AS r FROM (SELECT o_orderkey AS line_id, s.name, a, b FROM orders JOIN s ON o_orderkey = s.file AND a <= o_custkey % 450 AND o_custkey % 450 <= b)) WHERE r = 1")
def enclosing_symbol(spark, sf_dir):
    """Of every order's line number, the narrowest of its lines' ranges around it."""
    symbols = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS file", "l_linenumber * 1000000 + l_partkey AS name", "l_partkey % 400 AS start_line", "l_partkey % 400 + 5 + l_linenumber * 9 AS end_line")
    spots = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS line_id", "o_orderkey AS file", "o_custkey % 450 AS line")
    return joins.enclosing_symbols(spots, symbols).select("line_id", "name").distinct()


@query("q154_relevant_flows", "SELECT DISTINCT o_orderkey AS finding_id, event_id AS flow_id FROM orders JOIN events ON o_custkey = user_id OR o_custkey = user_id + 7")
def relevant_flows(spark, sf_dir):
    found = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS finding_id", "o_custkey AS file_path")
    flows = table(spark, sf_dir, "events").selectExpr("event_id AS flow_id", "user_id AS source_file", "user_id + 7 AS sink_file")
    return joins.relevant_flows(found, flows)


@query("q308_event_props", "SELECT event_id, json_extract_string(props, '$.' || k) AS v FROM (SELECT event_id, props, json_keys(props)[1] AS k FROM events)")
def event_props(spark, sf_dir):
    """The first property of each event's open JSON."""
    key = F.json_object_keys("props")[0]
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), key).alias("v"))


@query("labels_by_source", "SELECT source, count(*) AS n, count(quality) AS labelled, sum(toxic)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def labels_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.sum("toxic").alias("toxic"))
