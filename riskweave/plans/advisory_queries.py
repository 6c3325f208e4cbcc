"""Queries of advisories: symbols that are mined, patches, versions, scores and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mining, packages, scores
from ..functions.versions import compare_versions, parsed, tidied, version_matches
from ..operators import joins
from ..session import spread, table
from ..sources import advisories
from .column_queries import _VECTOR
from .registry import query
from .source_queries import filled


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


_DETAILS = "Calls `Obj.readKEY` and `plain` in `lib/a.js`, `X_TOKEN`, `v1.2`; " + "nothing more is known than that " * 3 + "and the helper `go`."


@query(
    "q274_text_symbols",
    "SELECT p_partkey AS id, unnest(['load_' || p_partkey, 'Obj.read' || p_partkey, 'go']) AS symbol, unnest([['summary_context'], ['details_inline_code'], ['details_inline_code']]) AS sources, unnest([0.7, 0.45, 0.45])::DOUBLE AS confidence FROM part",
)
def text_symbols(spark, sf_dir):
    rows = spread(parts(spark, sf_dir).select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("id"), filled("Flaw in a method called load_KEY() here", F.col("p_partkey")).alias("summary"), filled(_DETAILS, F.col("p_partkey")).alias("details"))
    return advisories.text_symbols(rows)


_TOKENS = [("`parse_body()`", "parse_body"), ("read", None), ("v1.2.3", None), ("https://x.y/z", None), ("file.py", None), ("MAX_SIZE", None), ("Content-Type", None), ("two words", None), ("a.b.go_on;", "a.b.go_on"), ("a.b.c;", None), ("Vec<T>::push(x)", "Vec::push"), ("plain", None), ("camelCase", "camelCase"), ("9lives", None)]


@query("q275_function_candidates", "SELECT p_partkey AS id, t AS token, want AS name FROM part JOIN (VALUES " + ", ".join(f"({i}, '{t}', {repr(w) if w else 'NULL'})" for i, (t, w) in enumerate(_TOKENS)) + f") v(i, t, want) ON p_partkey % {len(_TOKENS)} = i")
def function_candidates(spark, sf_dir):
    token = F.get(F.array(*[F.lit(t) for t, _ in _TOKENS]), (F.col("p_partkey") % len(_TOKENS)).cast("int"))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), token.alias("token"), mining.candidate(token, F.lit(False)).alias("name"))


_SPECIFIC = '{"affected_functions":["mod.fnKEY(x)","run"],"imports":[{"path":"pkg/KEY","modules":["`m.KEY`"],"symbols":["Do"]},{"name":"Alone"},{"path":"pkg/KEY","symbols":["Do"," "]}]}'


@query(
    "q303_structured_symbols",
    "SELECT p_partkey AS id, unnest(['mod.fn' || p_partkey, 'Do', 'Do', 'Alone']) AS symbol, unnest([NULL, 'pkg/' || p_partkey, 'm.' || p_partkey, NULL]) AS import_path, unnest([['ecosystem_specific.affected_functions'], ['ecosystem_specific.imports'], ['ecosystem_specific.imports'], ['ecosystem_specific.imports']]) AS sources, unnest([1.0, 1.0, 1.0, 0.95])::DOUBLE AS confidence FROM part",
)
def structured_symbols(spark, sf_dir):
    rows = parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.from_json(filled(_SPECIFIC, F.col("p_partkey")), advisories.SPECIFIC).alias("specific"))
    return advisories.structured_symbols(rows)


@query("q197_symbol_dedupe", "SELECT l_orderkey AS id, 's' || l_partkey % 3 AS symbol, CASE WHEN l_suppkey % 2 = 0 THEN 'p' END AS import_path, list_sort(list_distinct(list(l_returnflag))) AS sources, max(l_discount) AS confidence FROM lineitem GROUP BY 1, 2, 3")
def symbol_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "concat('s', cast(l_partkey % 3 as string)) AS symbol", "CASE WHEN l_suppkey % 2 = 0 THEN 'p' END AS import_path", "l_returnflag AS source", "l_discount AS confidence")
    return advisories.dedupe_symbols(rows)


@query("q304_patch_references", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN ['https://github.com/o/r/commit/abc' || p_size || '.patch'] WHEN 1 THEN ['https://github.com/o/r/compare/v1...v2.patch'] WHEN 2 THEN ['https://github.com/o/r/pull/' || p_size || '.patch'] ELSE [] END AS urls FROM part")
def patch_references(spark, sf_dir):
    refs = F.expr("CASE p_partkey % 4 WHEN 0 THEN array('https://github.com/o/r/pull/3', concat('https://github.com/o/r/commit/abc', cast(p_size as string), '/')) WHEN 1 THEN array('https://github.com/o/r/pull/3', ' https://github.com/o/r/compare/v1...v2') WHEN 2 THEN array('https://x.y', concat('https://github.com/o/r/pull/', cast(p_size as string))) ELSE array('https://github.com/o/r', 'http://github.com/o/r/pull/1') END")
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), mining.patch_urls(refs).alias("urls"))


_PATHS = [("a/src/pkg/mod.py", "pkg.mod"), ("pkg/__init__.py", "pkg"), ("b/lib/a/b_c.py", "a.b_c"), ("tests/x.py", None), ("pkg/my-mod.py", None), ("pkg/mod.js", None), ("setup_test/x.py", None), ("src/__init__.py", None), ("/dev/null", None)]


@query("q305_python_modules", "SELECT p_partkey AS id, want AS module FROM part JOIN (VALUES " + ", ".join(f"({i}, {repr(w) if w else 'NULL'})" for i, (_, w) in enumerate(_PATHS)) + f") v(i, want) ON p_partkey % {len(_PATHS)} = i")
def python_modules(spark, sf_dir):
    path = F.get(F.array(*[F.lit(p) for p, _ in _PATHS]), (F.col("p_partkey") % len(_PATHS)).cast("int"))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), mining.python_module(path).alias("module"))


_SCRIPTS = [("a/src/util/deep.js", ["p/src/util/deep", "p/util/deep"]), ("lib/index.ts", ["p/lib"]), ("packages/core/src/a.mjs", ["p/src/a", "p/a"]), ("index.js", ["p"]), ("src/a.test.js", []), ("readme.md", []), ("docs/a.js", [])]


@query("q306_npm_modules", "SELECT p_partkey AS id, want AS modules FROM part JOIN (VALUES " + ", ".join(f"({i}, {w if w else '[]::VARCHAR[]'})" for i, (_, w) in enumerate(_SCRIPTS)) + f") v(i, want) ON p_partkey % {len(_SCRIPTS)} = i")
def npm_modules(spark, sf_dir):
    path = F.get(F.array(*[F.lit(p) for p, _ in _SCRIPTS]), (F.col("p_partkey") % len(_SCRIPTS)).cast("int"))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), mining.npm_modules(path, F.lit("p")).alias("modules"))


@query("q182_enrichment_stats", "WITH m AS (SELECT DISTINCT l_partkey AS id, 'f' || l_suppkey % 5 AS symbol FROM lineitem) SELECT count(DISTINCT id) AS enriched, count(*) AS functions FROM m WHERE symbol <> 'f' || id % 5")
def enrichment_stats(spark, sf_dir):
    low = parts(spark, sf_dir).selectExpr("p_partkey AS id", "array(concat('f', cast(p_partkey % 5 as string))) AS vulnerable_functions")
    mined = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS id", "concat('f', cast(l_suppkey % 5 as string)) AS symbol")
    return advisories.enrichment_stats(low, mined)


@query("q024_enrichment_rows", "SELECT 'A' || p_partkey AS id, ['f' || p_size, 'g'] AS vulnerable_functions FROM part WHERE p_partkey % 3 > 0")
def enrichment_rows(spark, sf_dir):
    payload = F.when(F.col("p_partkey") % 3 > 0, filled('{"advisories":{"AKEY":{"vulnerable_functions":["fSIZE","g"]},"none":null}}', F.col("p_partkey"), F.col("p_size"))).otherwise("[1, 2")
    return advisories.enrichment_rows(parts(spark, sf_dir).select(payload.alias("payload"))).select("id", "vulnerable_functions")


@query("q015_enriched_advisories", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN ['own', 'more' || p_size, 'sym'] ELSE ['own'] END AS vulnerable_functions, CASE WHEN p_partkey % 2 = 0 THEN ['m.x'] ELSE [] END AS paths FROM part")
def enriched_advisories(spark, sf_dir):
    low = parts(spark, sf_dir).selectExpr("p_partkey AS id", "array('own') AS vulnerable_functions")
    more = parts(spark, sf_dir).where("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("id"), F.expr("array('own', concat('more', cast(p_size as string)))").alias("vulnerable_functions"), F.from_json(F.lit('[{"symbol":"sym","import_path":"m.x","confidence":1.0,"sources":["s"]},{"symbol":"sym","import_path":"m.x","confidence":0.5,"sources":[]}]'), f"array<{advisories.SYMBOL}>").alias("vulnerable_symbols")
    )
    return advisories.enrich(low, more).select("id", "vulnerable_functions", F.col("vulnerable_import_paths").alias("paths"))


@query("q017_range_texts", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '>=0,<' || p_size || '.0' WHEN 1 THEN '>=1.0,<=2.' || p_size ELSE '>=1,<3' END AS range FROM part")
def range_texts(spark, sf_dir):
    event = lambda **k: F.struct(*[F.lit(k.get(n)).cast("string").alias(n) if not hasattr(k.get(n), "cast") else k[n].alias(n) for n in ("introduced", "fixed", "last_affected", "limit")])
    size = F.col("p_size").cast("string")
    events = F.when(F.col("p_partkey") % 3 == 0, F.array(event(introduced="0"), event(fixed=F.concat(size, F.lit(".0"))))).when(F.col("p_partkey") % 3 == 1, F.array(event(introduced="1.0"), event(last_affected=F.concat(F.lit("2."), size)))).otherwise(F.array(event(introduced="1", limit="3")))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), advisories.range_text(F.struct(events.alias("events"))).alias("range"))


@query("q273_best_cvss", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 9.8 WHEN 1 THEN 7.5 END::DOUBLE AS score FROM part")
def best_cvss(spark, sf_dir):
    entry = lambda t, s: F.struct(F.lit(t).alias("type"), F.lit(s).alias("score"))
    high, low, new = entry("CVSS_V3", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), entry("X", "7.5"), entry("CVSS_V4", "CVSS:4.0/AV:N")
    severity = F.when(F.col("p_partkey") % 3 == 0, F.array(low, high, new)).when(F.col("p_partkey") % 3 == 1, F.array(new, low)).otherwise(F.array(new))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), advisories.best_cvss(severity)["score"].alias("score"))


@query("q272_severity_from_score", f"SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'low' WHEN p_size / 5.0 >= 9 THEN 'critical' WHEN p_size / 5.0 >= 7 THEN 'high' WHEN p_size / 5.0 >= 4 THEN 'medium' ELSE 'low' END AS severity FROM part")
def severity_from_score(spark, sf_dir):
    score = F.expr("CASE WHEN p_size % 4 > 0 THEN cast(p_size / 5.0 as double) END")
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), advisories.severity_or(score, F.lit("low")).alias("severity"))


_VERSIONS = [("v1.2.3", "1.2.3"), ("=2.0.Final", "2.0"), ("1.0-RELEASE", "1.0"), ("3.1.0.beta2", "3.1.0.beta2"), ("1.0-beta", "1.0b"), ("2.0-SNAPSHOT", "2.0.dev0"), ("  4.5.GA ", "4.5"), ("1.0-cr", "1.0rc"), ("", "")]


@query("q266_tidy_versions", "SELECT p_partkey AS id, want AS version FROM part JOIN (VALUES " + ", ".join(f"({i}, '{w}')" for i, (_, w) in enumerate(_VERSIONS)) + f") v(i, want) ON p_partkey % {len(_VERSIONS)} = i")
def tidy_versions(spark, sf_dir):
    version = F.get(F.array(*[F.lit(v) for v, _ in _VERSIONS]), (F.col("p_partkey") % len(_VERSIONS)).cast("int"))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), tidied(version).alias("version"))


_V = "concat(cast(p_size % 4 as string), '.', cast(p_partkey % 11 as string), '.0')"
_W = "concat(cast(p_partkey % 5 as string), '.', cast(p_size % 12 as string))"


@query("q268_compare_versions", "SELECT p_partkey AS id, CASE WHEN p_size % 4 <> p_partkey % 5 THEN CASE WHEN p_size % 4 > p_partkey % 5 THEN 1 ELSE -1 END WHEN p_partkey % 11 > p_size % 12 THEN 1 WHEN p_partkey % 11 < p_size % 12 THEN -1 ELSE 0 END AS c FROM part")
def compare(spark, sf_dir):
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), compare_versions(F.expr(_V), F.expr(_W)).alias("c"))


@query("q267_parsed_versions", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN [p_size % 4, p_partkey % 11, 0, 0] ELSE [p_size % 4, p_partkey % 11, 0, 1] END::INT[] AS parsed FROM part")
def parsed_versions(spark, sf_dir):
    """Versions as numbers, then whether they are final."""
    version = F.concat(F.expr(_V), F.when(F.col("p_partkey") % 3 == 0, "-beta").otherwise(""))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), parsed(version).alias("parsed"))


@query("q270_version_matches", "SELECT p_partkey AS id, p_size % 4 BETWEEN 1 AND 1 OR (p_size % 4 = 3 AND p_partkey % 11 = 5) OR p_size % 4 = 0 AS hit FROM part")
def matches(spark, sf_dir):
    ranges, listed = F.array(F.lit(">=1.0,<2.0")), F.array(F.lit("3.5.0"), F.lit("9.9"))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), version_matches(F.expr(_V), ranges, F.lit("<1.0"), listed, F.lit("npm")).alias("hit"))


@query("q115_advisory_index", "SELECT id, k AS key FROM (SELECT s_suppkey AS id, unnest(list_distinct(CASE WHEN s_suppkey % 2 = 0 THEN ['my_pkg.' || s_suppkey, 'my-pkg-' || s_suppkey, 'my-pkg.' || s_suppkey, 'my_pkg_' || s_suppkey, 'my_pkg-' || s_suppkey] ELSE ['org.x:lib' || s_suppkey, 'lib' || s_suppkey] END)) AS k FROM supplier)")
def advisory_index(spark, sf_dir):
    low = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 2 = 0 THEN concat('My_Pkg.', cast(s_suppkey as string)) ELSE concat('Org.X:Lib', cast(s_suppkey as string)) END AS package", "CASE WHEN s_suppkey % 2 = 0 THEN 'pypi' ELSE 'maven' END AS ecosystem")
    return joins.advisory_keys(low).select("id", "key")


@query("q118_function_index", "SELECT 'A' || s_suppkey AS advisory_id, unnest(['repository', 'revparse_single' || s_suppkey % 9]) AS function FROM supplier")
def function_index(spark, sf_dir):
    low = table(spark, sf_dir, "supplier").select(filled("AKEY", F.col("s_suppkey")).alias("id"), F.lit("git2").alias("package"), F.lit("crates.io").alias("ecosystem"), F.lit("high").alias("severity"), F.array(filled("Repository::revparse_singleKEY(x)", F.col("s_suppkey") % 9)).alias("vulnerable_functions"))
    return joins.function_index(low).select("advisory_id", "function")


@query("q116_audit_kinds", """
SELECT p_partkey AS id, 'A' || s_suppkey AS advisory_id, CASE WHEN p_partkey % 2 = 0 THEN 'canonical_package_match' ELSE 'artifact_alias_match' END AS match_type
FROM part JOIN supplier ON s_suppkey % 2 = p_partkey % 2 AND p_size % 50 = s_suppkey % 50 WHERE p_size % 3 > 0""")
def audit_kinds(spark, sf_dir):
    """Packages that advisories mean under another spelling, or by the artifact only."""
    deps = parts(spark, sf_dir).selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 2 = 0 THEN 'PyPI' ELSE 'maven' END AS ecosystem", "CASE WHEN p_partkey % 2 = 0 THEN concat('my_pkg_', cast(p_size % 50 as string)) ELSE concat('log', cast(p_size % 50 as string)) END AS name", "concat(cast(p_size % 3 as string), '.5.0') AS version")
    low = table(spark, sf_dir, "supplier").selectExpr("concat('A', cast(s_suppkey as string)) AS id", "CASE WHEN s_suppkey % 2 = 0 THEN 'pypi' ELSE 'maven' END AS ecosystem", "CASE WHEN s_suppkey % 2 = 0 THEN concat('my-pkg-', cast(s_suppkey % 50 as string)) ELSE concat('org.apache:log', cast(s_suppkey % 50 as string)) END AS package", "'high' AS severity", "'' AS details", "array('u') AS references", "array('>=1.0,<9.0') AS affected_ranges", "'' AS affected_range", "cast(null as array<string>) AS affected_versions")
    return joins.audit(deps, low).select("id", "advisory_id", "match_type")


@query("q025_import_names", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN ['pyyaml', 'yaml'] WHEN 1 THEN ['bs4', 'beautifulsoup4'] ELSE ['com.google.code.gson', 'com.google.code.gson:gson', 'com.google.gson', 'gson'] END AS names FROM part")
def import_names(spark, sf_dir):
    name, eco = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'PyYAML' WHEN 1 THEN 'beautifulsoup4' ELSE 'com.google.code.gson:gson' END"), F.expr("CASE WHEN p_partkey % 3 < 2 THEN 'pypi' ELSE 'maven' END")
    ordered = F.array_sort(packages.import_aliases(name, eco))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 1, F.reverse(ordered)).otherwise(ordered).alias("names"))


@query("q271_cvss_severity", "SELECT id, CASE WHEN score IS NULL THEN 'none' ELSE 'known' END AS state FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1 END AS score FROM part)")
def cvss_severity(spark, sf_dir):
    rows = parts(spark, sf_dir).selectExpr("p_partkey AS id", f"{_VECTOR} AS v")
    return rows.select("id", F.when(scores.cvss3(F.col("v")).isNull(), "none").otherwise("known").alias("state"))
