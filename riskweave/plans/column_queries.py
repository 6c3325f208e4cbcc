"""Queries of the Column functions: one row for each file, dependency or document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, packages, paths, scores, text
from ..session import table
from .bindings import DEPENDENCIES, FILES, FINDINGS, frame, sql
from .registry import query


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(expr: str, pairs: dict, other: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, (int, float)) else repr(v)}" for k, v in pairs.items()) + f" ELSE {other} END"


_NORMAL = r"regexp_replace(regexp_replace(replace(path, chr(92), '/'), '^/+|/+$', '', 'g'), '^\./', '')"
_LOW = "lower(trim(replace(path, chr(92), '/')))"


def _ext(p: str) -> str:
    return rf"lower(regexp_extract({p}, '[^/.][^/]*(\.[^./]+)$', 1))"


def _name(p: str) -> str:
    return f"regexp_extract(regexp_replace({p}, '/+$', ''), '([^/]*)$', 1)"


@query("q083_normalise_path", f"SELECT file_id, {_NORMAL} AS normal FROM {sql(FILES)}")
def normalise_path(spark, sf_dir):
    return frame(spark, sf_dir, FILES).select("file_id", paths.normalise(F.col("path")).alias("normal"))


@query("q084_extension", f"SELECT file_id, {_ext('path')} AS ext, {_ext('path')} IN {_in(fixed.BINARY_EXTENSIONS)} AS is_binary FROM {sql(FILES)}")
def extension(spark, sf_dir):
    return frame(spark, sf_dir, FILES).select("file_id", paths.extension(F.col("path")).alias("ext"), paths.is_binary(F.col("path")).alias("is_binary"))


@query(
    "q086_skip_path",
    f"SELECT file_id, len(list_filter(string_split({_NORMAL}, '/'), lambda x: x IN {_in(fixed.SKIP_DIRS)})) > 0 OR {_NORMAL} = 'docs' OR starts_with({_NORMAL}, 'docs/') OR regexp_matches({_NORMAL}, '(^|/)[^/]*\\.yaml$') AS skipped FROM {sql(FILES)}",
)
def skip_path(spark, sf_dir):
    return frame(spark, sf_dir, FILES).select("file_id", paths.skipped(F.col("path"), ["docs"], ["*.yaml"]).alias("skipped"))


@query(
    "q090_investigate_path",
    f"""
WITH f AS (SELECT file_id, {_LOW} AS low FROM {sql(FILES)}),
g AS (SELECT *, {_name('low')} AS base, {_ext('low')} AS ext FROM f),
h AS (SELECT *, base IN {_in(fixed.REVIEWABLE_NAMES)} OR (starts_with(base, '.env') AND base NOT IN ('.env.example', '.env.sample')) OR ext IN {_in(fixed.REVIEWABLE_EXTENSIONS)} AS reviewable FROM g)
SELECT file_id, reviewable, reviewable OR NOT (base IN {_in(fixed.SKIP_NAMES)} OR ext IN {_in(fixed.SKIP_EXTENSIONS)} OR {' OR '.join(f"suffix(low, '{s}')" for s in fixed.SKIP_SUFFIXES)}) AS investigated FROM h""",
)
def investigate_path(spark, sf_dir):
    p = F.col("path")
    return frame(spark, sf_dir, FILES).select("file_id", paths.reviewable(p).alias("reviewable"), paths.investigated(p).alias("investigated"))


@query(
    "q092_test_paths",
    f"""
WITH f AS (SELECT file_id, path, list_filter(string_split(lower(replace(path, chr(92), '/')), '/'), lambda x: x <> '') AS parts FROM {sql(FILES)})
SELECT file_id, list_has_any(parts, ['test', 'tests', '__tests__']) OR starts_with(parts[-1], 'test_') OR {' OR '.join(f"suffix(parts[-1], '{s}')" for s in fixed.TEST_SUFFIXES)} AS strict,
  regexp_matches(lower(path), 'test|spec|__test__|fixture|mock') AS loose FROM f""",
)
def test_paths(spark, sf_dir):
    p = F.col("path")
    return frame(spark, sf_dir, FILES).select("file_id", paths.in_tests(p).alias("strict"), paths.indexed_as_test(p).alias("loose"))


_STEPS = "list_transform(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda x: x NOT IN ('', '.')), lambda x: CASE WHEN x = '..' THEN -1 ELSE 1 END)"


@query("q088_safe_path", f"SELECT file_id, NOT starts_with(path, '/') AND coalesce(list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))), 0) >= 0 AS safe FROM (SELECT *, {_STEPS} AS steps FROM {sql(FILES)})")
def safe_path(spark, sf_dir):
    return frame(spark, sf_dir, FILES).select("file_id", paths.is_safe(F.col("path")).alias("safe"))


_GOOD = "greatest(0, " + ", ".join(f"CASE WHEN regexp_matches(lower(path), '{p}') THEN {s} ELSE 0 END" for p, s in fixed.PATH_SCORES if s > 0) + ")"
_BAD = "least(0, " + ", ".join(f"CASE WHEN regexp_matches(lower(path), '{p}') THEN {s} ELSE 0 END" for p, s in fixed.PATH_SCORES if s < 0) + ")"
_SIZE = "CASE WHEN line_count > 10 AND line_count < 500 THEN 5 WHEN line_count >= 500 AND line_count < 2000 THEN 3 WHEN line_count >= 2000 THEN 1 ELSE 0 END"
FILE_SCORE_SQL = f"SELECT file_id, path, hits, round(({_GOOD} + {_BAD} + {_SIZE} + least(hits * 5, 30)) * ({_case(_ext('path'), fixed.EXTENSION_WEIGHT, '0.2')})::DOUBLE, 6) AS score FROM {sql(FILES)}"


@query("q231_file_score", f"SELECT file_id, score FROM ({FILE_SCORE_SQL})")
def file_score(spark, sf_dir):
    score = scores.file_score(F.col("path"), F.col("line_count"), F.col("hits"))
    return frame(spark, sf_dir, FILES).select("file_id", F.round(score["score"], 6).alias("score"))


@query("q207_priority_queue", f"SELECT file_id, score FROM ({FILE_SCORE_SQL}) WHERE NOT regexp_matches(lower(path), 'test|spec|__test__|fixture|mock') ORDER BY score DESC, file_id LIMIT 100")
def priority_queue(spark, sf_dir):
    files = frame(spark, sf_dir, FILES).where(~paths.indexed_as_test(F.col("path")))
    score = scores.file_score(F.col("path"), F.col("line_count"), F.col("hits"))
    return files.select("file_id", F.round(score["score"], 6).alias("score")).orderBy(F.desc("score"), "file_id").limit(100)


def _obfuscation_path() -> str:
    return "concat(case doc_id % 4 when 0 then 'src/a' when 1 then 'vendor/b.bundle.' when 2 then 'x/dist/c.min.' else 'd' end, '.js')"


def _times(p: str) -> str:
    return f"len(regexp_extract_all(t, '{p}'))"


# Word boundaries know all letters here, but only ASCII ones in DuckDB: words with others are blanked.
OBFUSCATION_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lower({_obfuscation_path()}) AS low FROM documents),
l AS (SELECT *, list_transform(string_split(regexp_replace(t, '\n$', ''), chr(10)), lambda x: length(x)) AS ls FROM d),
m AS (SELECT *, len(ls) AS n, list_sum(ls)::BIGINT AS total, list_max(ls) AS longest, length(t) - length(translate(t, ' ' || chr(9) || chr(10), '')) AS blank,
  {_times(fixed.HEX_ESCAPE)} AS hexes, {_times(fixed.UNICODE_ESCAPE)} AS unicodes, {_times(fixed.HEX_NAME)} AS names,
  regexp_extract_all(regexp_replace(t, '[\p{{L}}\p{{N}}_]*[^\x00-\x7F][\p{{L}}\p{{N}}_]*', ' ', 'g'), '{fixed.IDENTIFIER}') AS words, list_max(list_transform(regexp_extract_all(t, '{fixed.BASE64_RUN}'), lambda x: length(x))) AS b64,
  ({' OR '.join(f"regexp_matches(t, '{p}')" for p in fixed.PACKERS)}) AS packed FROM l),
s AS (SELECT *, len(list_filter(words, lambda w: length(w) = 1)) / len(words) AS single FROM m),
r AS (SELECT *, least(1.0, 0.0::DOUBLE + CASE WHEN contains(low, '.min.') THEN 0.6 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(low, '\.bundled?\.') THEN 0.3 ELSE 0 END::DOUBLE
  + CASE WHEN regexp_matches(low, 'vendor/|third_party/|third-party/') THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(low, '/dist/|/build/') THEN 0.15 ELSE 0 END::DOUBLE
  + CASE WHEN longest > 5000 THEN 0.5 WHEN longest > 1000 AND n < 20 THEN 0.4 WHEN total / n > 200 THEN 0.3 ELSE 0 END::DOUBLE
  + CASE WHEN total > 500 AND blank / total < 0.05 THEN 0.4 WHEN total > 1000 AND blank / total < 0.10 THEN 0.2 ELSE 0 END::DOUBLE
  + CASE WHEN packed THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN hexes > 20 THEN 0.3 WHEN hexes > 5 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN unicodes > 50 THEN 0.2 ELSE 0 END::DOUBLE
  + CASE WHEN names > 5 THEN 0.5 WHEN names > 0 THEN 0.2 ELSE 0 END::DOUBLE
  + CASE WHEN total > 500 AND single > 0.3 AND len(words) > 50 THEN 0.3 WHEN total > 500 AND single > 0.2 AND len(words) > 100 THEN 0.15 ELSE 0 END::DOUBLE
  + CASE WHEN b64 > 500 THEN 0.3 WHEN b64 > 100 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(t, '{fixed.SOURCE_MAP}') THEN 0.1 ELSE 0 END::DOUBLE
  + CASE WHEN {_times(fixed.DENSE)} > 20 AND total / n > 100 THEN 0.15 ELSE 0 END::DOUBLE) AS score FROM s)
SELECT doc_id, CASE WHEN NOT regexp_matches(t, '\S') THEN 0.0 ELSE round(score, 6) END AS score,
  CASE WHEN NOT regexp_matches(t, '\S') THEN 'empty' WHEN score >= 0.7 AND (packed OR names > 0) THEN 'obfuscated' WHEN score >= 0.5 AND regexp_matches(low, '\.bundled?\.|vendor/|third_party/|third-party/') THEN 'vendor_bundle'
    WHEN score >= 0.4 THEN 'minified' WHEN score >= 0.15 THEN 'possibly_minified' ELSE 'clean' END AS label,
  regexp_matches(t, '\S') AND score < 0.7 AS analysable FROM r"""


def _obfuscation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{_obfuscation_path()} AS path")
    o = docs.select("doc_id", scores.obfuscation(F.col("text"), F.col("path"), F.lit("javascript")).alias("o"))
    return o.select("doc_id", F.round("o.score", 6).alias("score"), "o.label", "o.analysable")


@query("q232_obfuscation", OBFUSCATION_SQL)
def obfuscation(spark, sf_dir):
    return _obfuscation(spark, sf_dir)


@query("q233_obfuscation_severity", f"SELECT doc_id, CASE WHEN score >= 0.8 THEN 'heavy' WHEN score >= 0.5 THEN 'moderate' WHEN score >= 0.2 THEN 'light' ELSE 'none' END AS severity FROM ({OBFUSCATION_SQL})")
def obfuscation_severity(spark, sf_dir):
    return _obfuscation(spark, sf_dir).select("doc_id", scores.obfuscation_severity(F.col("score")).alias("severity"))


@query(
    "q166_obfuscation_summary",
    f"SELECT count(*) AS total_files, count(*) FILTER (score >= 0.4) AS obfuscated, count(*) FILTER (score >= 0.7) AS heavy, count(*) FILTER (score >= 0.4 AND score < 0.7) AS moderate, count(*) FILTER (NOT analysable) AS not_analysable, round(count(*) FILTER (score >= 0.4) / count(*) * 100, 1) AS percentage FROM ({OBFUSCATION_SQL})",
)
def obfuscation_summary(spark, sf_dir):
    from ..operators.rollups import obfuscation_summary as summary

    return summary(_obfuscation(spark, sf_dir))


@query("q259_normalise_text", f"SELECT finding_id, substr(lower(regexp_replace(trim(coalesce(category, '')), '\\s+', ' ', 'g')), 1, 60) AS category, substr(lower(regexp_replace(trim(title), '\\s+', ' ', 'g')), 1, 20) AS title FROM {sql(FINDINGS)}")
def normalise_text(spark, sf_dir):
    return frame(spark, sf_dir, FINDINGS).select("finding_id", text.normal(F.col("category"), 60).alias("category"), text.normal(F.col("title"), 20).alias("title"))


@query("q280_estimate_tokens", "SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE floor(length(text) / 3.2::DOUBLE)::INT + 1 END AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("q281_truncate_to_budget", r"WITH c AS (SELECT doc_id, text, substr(text, 1, 640) AS cut, length(regexp_extract(substr(text, 1, 640), '(?s)^(.*)\n', 1)) AS whole FROM documents) SELECT doc_id, CASE WHEN length(text) <= 640 THEN text WHEN contains(cut, chr(10)) AND whole > 512 THEN substr(cut, 1, whole) ELSE cut END AS text FROM c")
def truncate_to_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.to_budget(F.col("text"), F.lit(200)).alias("text"))


@query(
    "q282_file_context_budget",
    "SELECT conv_id, turn, greatest(200, floor(4000 * tokens / sum(tokens) OVER (PARTITION BY conv_id)))::BIGINT AS budget FROM (SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE floor(length(text) / 3.2::DOUBLE)::INT + 1 END AS tokens FROM conversations)",
)
def file_context_budget(spark, sf_dir):
    """Each part of a context gets its share of the token budget, and 200 at least."""
    parts = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.estimate_tokens(F.col("text")).alias("tokens"))
    totals = parts.groupBy("conv_id").agg(F.sum("tokens").alias("total"))
    share = F.floor(F.lit(4000) * F.col("tokens") / F.col("total"))
    return parts.join(totals, "conv_id").select("conv_id", "turn", F.greatest(F.lit(200), share).cast("bigint").alias("budget"))


@query("q005_read_head", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS head, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS middle, substr(text, 1, 50) AS preview, length(text) > 50 AS cut FROM documents")
def read_head(spark, sf_dir):
    t = F.col("text")
    p = text.preview(t, 50)
    return table(spark, sf_dir, "documents").select("doc_id", text.head_lines(t, 3).alias("head"), text.lines_between(t, F.lit(2), F.lit(4)).alias("middle"), p["text"].alias("preview"), p["cut"].alias("cut"))


_GREP = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line FROM documents) SELECT doc_id, line, substr(content, 1, 200) AS content FROM l WHERE "


@query("q234_search_code", _GREP + r"regexp_matches(content, '(?i)licen[sc]e|token\s*=')")
def search_code(spark, sf_dir):
    return text.grep(table(spark, sf_dir, "documents"), "text", r"licen[sc]e|token\s*=", ["doc_id"])


@query("q235_search_text", _GREP + "contains(lower(content), 'apache license')")
def search_text(spark, sf_dir):
    return text.grep(table(spark, sf_dir, "documents"), "text", "Apache License", ["doc_id"], literal=True)


@query("q260_token_sets", f"SELECT finding_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda t: length(t) >= 3))), ' ') AS tokens FROM {sql(FINDINGS)}")
def token_sets(spark, sf_dir):
    return frame(spark, sf_dir, FINDINGS).select("finding_id", F.array_join(F.array_sort(text.tokens(F.col("title"))), " ").alias("tokens"))


@query("q078_severity_of_score", "SELECT p_partkey, CASE WHEN s IS NULL THEN 'medium' WHEN s >= 9 THEN 'critical' WHEN s >= 7 THEN 'high' WHEN s >= 4 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_size / 5.0 END AS s FROM part)")
def severity_of_score(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 5 > 0 THEN cast(p_size / 5.0 as double) END AS s")
    return parts.select("p_partkey", scores.severity_of_score(F.col("s")).alias("severity"))


_VECTOR = "concat('CVSS:3.1/AV:', case p_partkey % 4 when 0 then 'N' when 1 then 'A' when 2 then 'L' else 'P' end, '/AC:', case p_partkey % 2 when 0 then 'L' else 'H' end, '/PR:', case p_partkey % 3 when 0 then 'N' when 1 then 'L' else 'H' end, '/UI:', case p_size % 2 when 0 then 'N' else 'R' end, '/S:', case p_size % 3 when 0 then 'C' else 'U' end, '/C:', case p_size % 4 when 0 then 'H' when 1 then 'L' else 'N' end, '/I:', case p_partkey % 5 when 0 then 'H' when 1 then 'L' else 'N' end, case when p_partkey % 11 = 0 then '' else '/A:H' end)"


def _metric(k: str, table_: str) -> str:
    return f"CASE regexp_extract(v, '/{k}:([A-Z])', 1) " + " ".join(f"WHEN '{a}' THEN {b}::DOUBLE" for a, b in fixed.CVSS[table_].items()) + " END"


@query(
    "q271_cvss_base_score",
    f"""
WITH v AS (SELECT p_partkey, {_VECTOR} AS v FROM part),
m AS (SELECT p_partkey, regexp_extract(v, '/S:([A-Z])', 1) = 'U' AS same, 1 - (1 - {_metric('C', 'CIA')}) * (1 - {_metric('I', 'CIA')}) * (1 - {_metric('A', 'CIA')}) AS iss,
  8.22::DOUBLE * {_metric('AV', 'AV')} * {_metric('AC', 'AC')} * CASE WHEN regexp_extract(v, '/S:([A-Z])', 1) = 'U' THEN {_metric('PR', 'PR_U')} ELSE {_metric('PR', 'PR_C')} END * {_metric('UI', 'UI')} AS easy FROM v),
i AS (SELECT *, CASE WHEN same THEN 6.42::DOUBLE * iss ELSE 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) END AS impact FROM m)
SELECT p_partkey, CASE WHEN iss IS NULL OR easy IS NULL THEN NULL WHEN impact <= 0 THEN 0.0 WHEN same THEN least(ceil((impact + easy) * 10) / 10, 10) ELSE least(ceil(1.08::DOUBLE * (impact + easy) * 10) / 10, 10) END::DOUBLE AS base FROM i""",
)
def cvss_base_score(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_VECTOR} AS v").select("p_partkey", scores.cvss3(F.col("v")).alias("base"))


_CLEAN = "lower(trim(name))"
_FOLD = f"regexp_replace({_CLEAN}, '[-_.]+', '-', 'g')"
NORMAL_SQL = f"CASE WHEN ecosystem IN ('pypi', 'hex') THEN {_FOLD} WHEN ecosystem = 'maven' THEN concat(trim(string_split({_CLEAN}, ':')[1]), ':', trim(string_split({_CLEAN}, ':')[2])) ELSE {_CLEAN} END"


@query("q261_package_name", f"SELECT id, {NORMAL_SQL} AS normal FROM {sql(DEPENDENCIES)}")
def package_name(spark, sf_dir):
    return frame(spark, sf_dir, DEPENDENCIES).select("id", packages.normal(F.col("name"), F.col("ecosystem")).alias("normal"))


KEYS_SQL = f"list_filter(list_distinct(CASE WHEN ecosystem IN ('pypi', 'hex') THEN [{_CLEAN}, {_FOLD}, replace({_CLEAN}, '_', '-'), replace({_CLEAN}, '-', '_'), replace({_CLEAN}, '.', '-'), replace({_CLEAN}, '.', '_')] WHEN ecosystem = 'maven' THEN [{_CLEAN}, {NORMAL_SQL}, trim(string_split({_CLEAN}, ':')[2])] ELSE [{_CLEAN}] END), lambda k: k <> '')"


@query("q262_index_keys", f"SELECT id, array_to_string(list_sort({KEYS_SQL}), ' ') AS keys FROM {sql(DEPENDENCIES)}")
def index_keys(spark, sf_dir):
    return frame(spark, sf_dir, DEPENDENCIES).select("id", F.array_join(F.array_sort(packages.index_keys(F.col("name"), F.col("ecosystem"))), " ").alias("keys"))


LOOKUP_SQL = f"""
WITH n AS (SELECT id, ecosystem, {_CLEAN} AS low, {NORMAL_SQL} AS canon, {KEYS_SQL} AS keys FROM {sql(DEPENDENCIES)}),
k AS (SELECT *, CASE WHEN ecosystem = 'maven' THEN [canon, low, string_split(canon, ':')[2]] WHEN ecosystem IN ('pypi', 'hex') THEN [low, canon] || list_sort(keys) ELSE [canon, low] END AS tried FROM n),
d AS (SELECT *, list_filter(tried, lambda k, i: list_position(tried, k) = i) AS once FROM k),
u AS (SELECT id, ecosystem, low, canon, unnest(once) AS key, unnest(range(0, len(once)))::INT AS place FROM d)
SELECT id, place, key, CASE WHEN key = canon AND (place = 0 OR ecosystem NOT IN ('pypi', 'hex')) THEN 'exact_package_match' WHEN ecosystem = 'maven' AND key <> low THEN 'artifact_alias_match' ELSE 'canonical_package_match' END AS match_type FROM u"""


@query("q263_lookup_keys", LOOKUP_SQL)
def lookup_keys(spark, sf_dir):
    keys = packages.lookup_keys(F.col("name"), F.col("ecosystem"))
    return frame(spark, sf_dir, DEPENDENCIES).select("id", F.posexplode(keys).alias("place", "k")).select("id", "place", "k.key", "k.match_type")


ALIASES_SQL = f"""
WITH n AS (SELECT id, ecosystem, {_CLEAN} AS low, {NORMAL_SQL} AS canon FROM {sql(DEPENDENCIES)}),
a AS (SELECT id, [low, canon] || CASE ecosystem WHEN 'npm' THEN [replace(low, '-', '_')] WHEN 'maven' THEN [string_split(canon, ':')[1], string_split(canon, ':')[2]]
  WHEN 'hex' THEN [replace(canon, '-', '_'), replace(low, '-', '_'), replace(canon, '-', '.'), replace(canon, '-', '')] ELSE [replace(canon, '-', '_'), replace(low, '-', '_')] END AS names FROM n)
SELECT id, array_to_string(list_sort(list_distinct(names)), ' ') AS aliases FROM a"""


@query("q264_import_aliases", ALIASES_SQL)
def import_aliases(spark, sf_dir):
    return frame(spark, sf_dir, DEPENDENCIES).select("id", F.array_join(F.array_sort(packages.import_aliases(F.col("name"), F.col("ecosystem"))), " ").alias("aliases"))


@query("q265_import_candidates", "SELECT page_id, list_sort(list_distinct(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '.')))) AS candidates FROM (SELECT page_id, string_split(regexp_extract(url, '://([^/]*)', 1), '.') AS p FROM pages)")
def import_candidates(spark, sf_dir):
    host = F.regexp_extract("url", "://([^/]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(packages.import_candidates(host)).alias("candidates"))


@query(
    "q032_clean_version",
    f"SELECT id, CASE WHEN starts_with(version, 'file:') THEN '' ELSE trim(regexp_replace(regexp_replace(trim(string_split(regexp_replace(version, '^npm:.*@', ''), '||')[1]), '^[\\^~<>=! ]+', ''), '^v+', '')) END AS version FROM {sql(DEPENDENCIES)}",
)
def clean_version(spark, sf_dir):
    return frame(spark, sf_dir, DEPENDENCIES).select("id", packages.clean_version(F.col("version")).alias("version"))


_RELEVANCE = "case id % 5 when 0 then 'used' when 1 then 'likely_used' when 2 then 'test_only' when 3 then 'transitive_only' else 'unknown' end"


def _dependency_scores(spark, sf_dir):
    d = frame(spark, sf_dir, DEPENDENCIES).withColumn("relevance", F.expr(_RELEVANCE)).withColumn("hit", F.expr("id % 3 = 0"))
    return d.withColumn("r", scores.reachability(F.col("is_dev"), F.col("relevance"), F.col("hit"), F.expr("id % 2 = 0")))


@query(
    "q286_reachability",
    f"SELECT id, CASE WHEN is_dev OR relevance = 'test_only' THEN 'not_applicable' WHEN hit THEN 'reachable' WHEN relevance IN ('used', 'likely_used') THEN 'potentially_reachable' ELSE 'no_path_found' END AS status, CASE WHEN is_dev OR relevance = 'test_only' THEN 0.95 WHEN hit AND id % 2 = 0 THEN 0.9 WHEN hit THEN 0.8 WHEN relevance = 'used' THEN 0.7 WHEN relevance = 'likely_used' THEN 0.55 WHEN relevance = 'transitive_only' THEN 0.8 ELSE 0.45 END::DOUBLE AS confidence FROM (SELECT *, {_RELEVANCE} AS relevance, id % 3 = 0 AS hit FROM {sql(DEPENDENCIES)})",
)
def reachability(spark, sf_dir):
    return _dependency_scores(spark, sf_dir).select("id", "r.status", "r.confidence")


DEPENDENCY_RISK_SQL = f"""
WITH d AS (SELECT *, {_RELEVANCE} AS relevance, id % 3 = 0 AS hit FROM {sql(DEPENDENCIES)}),
r AS (SELECT *, CASE WHEN is_dev OR relevance = 'test_only' THEN 'not_applicable' WHEN hit THEN 'reachable' WHEN relevance IN ('used', 'likely_used') THEN 'potentially_reachable' ELSE 'no_path_found' END AS status FROM d)
SELECT id, severity, ecosystem, name, relevance, status, round(greatest(0, least(1000, greatest({_case("coalesce(severity, 'medium')", fixed.DEPENDENCY_BASE, '300')}, CASE WHEN cvss_score IS NULL THEN 0 ELSE least(900, cvss_score * 100) END)
  + {_case('status', fixed.REACHABILITY_BONUS, '0')} + {_case('relevance', fixed.RELEVANCE_BONUS, '0')} + CASE WHEN hit THEN 120 ELSE 0 END - CASE WHEN is_dev THEN 120 ELSE 0 END + CASE WHEN fixed_version <> '' THEN 25 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 40 ELSE 0 END)), 1)::DOUBLE AS score FROM r"""


def dependency_risks(spark, sf_dir):
    risk = scores.dependency_risk(F.col("severity"), F.col("cvss_score"), F.col("r.status"), F.col("relevance"), F.col("hit"), F.col("is_dev"), F.col("fixed_version"), F.expr("id % 7 = 0"))
    return _dependency_scores(spark, sf_dir).withColumn("risk", risk)


@query("q287_dependency_risk", f"SELECT id, score FROM ({DEPENDENCY_RISK_SQL})")
def dependency_risk(spark, sf_dir):
    return dependency_risks(spark, sf_dir).select("id", "risk.score")


_FACTOR = "{{'o': -abs({v}::DOUBLE), 'k': '{k}', 'v': {v}::DOUBLE}}"
FACTORS_SQL = f"""
WITH d AS (SELECT *, {_RELEVANCE} AS relevance, id % 3 = 0 AS hit FROM {sql(DEPENDENCIES)}),
r AS (SELECT *, CASE WHEN is_dev OR relevance = 'test_only' THEN 'not_applicable' WHEN hit THEN 'reachable' WHEN relevance IN ('used', 'likely_used') THEN 'potentially_reachable' ELSE 'no_path_found' END AS status FROM d),
f AS (SELECT id, [{_FACTOR.format(k='reachability', v='(' + _case('status', fixed.REACHABILITY_BONUS, '0') + ')')}, {_FACTOR.format(k='relevance', v='(' + _case('relevance', fixed.RELEVANCE_BONUS, '0') + ')')}, {_FACTOR.format(k='vulnerable_function_match', v='(CASE WHEN hit THEN 120 ELSE 0 END)')},
  {_FACTOR.format(k='dev_dependency', v='(CASE WHEN is_dev THEN -120 ELSE 0 END)')}, {_FACTOR.format(k='fix_available', v="(CASE WHEN fixed_version <> '' THEN 25 ELSE 0 END)")}, {_FACTOR.format(k='hot_file_usage', v='(CASE WHEN id % 7 = 0 THEN 40 ELSE 0 END)')}] AS all_ FROM r)
SELECT id, array_to_string(list_transform(list_sort(list_filter(all_, lambda x: x.v <> 0))[1:3], lambda x: x.k || '=' || CAST(x.v AS VARCHAR)), ', ') AS factors FROM f"""


@query("q288_risk_factors", FACTORS_SQL)
def risk_factors(spark, sf_dir):
    return dependency_risks(spark, sf_dir).select("id", scores.top_factors(F.col("risk.factors")).alias("factors"))
