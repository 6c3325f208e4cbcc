"""Queries of source trees, rule corpora, structure of files, mobile parts and call graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import packages, patterns, text
from ..operators import findings, graph, joins, reads, rollups
from ..session import spread, table
from ..sources import manifests, repo, rules, scanners, structure
from .bindings import DEPENDENCIES, EDGES, FINDINGS, frame, sql
from .finding_queries import REACH_SQL
from .registry import query
from .source_queries import ANDROID_MANIFEST, filled, filled_sql, files_of_parts

EDGE = sql(EDGES)
TREE_PATH = "case p_partkey % 6 when 0 then concat('src/m', cast(p_partkey as string), '.py') when 1 then concat('web/k8s/n', cast(p_partkey as string), '.ts') when 2 then 'Dockerfile' when 3 then concat('node_modules/x', cast(p_partkey as string), '.js') when 4 then concat('img/', cast(p_partkey as string), '.png') else concat('App', cast(p_partkey as string), '.csproj') end"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


def tree(spark, sf_dir):
    return parts(spark, sf_dir).selectExpr("p_size % 10 AS tree_id", f"{TREE_PATH} AS path", "p_size * 30000 AS size_bytes", "p_partkey")


@query("q002_source_files", f"SELECT DISTINCT path FROM (SELECT {TREE_PATH} AS path, p_size FROM part WHERE p_partkey % 6 NOT IN (2, 3, 4)) WHERE p_size * 30000 <= 1000000 ORDER BY path LIMIT 10000")
def source_files(spark, sf_dir):
    return repo.source_files(tree(spark, sf_dir).where("p_partkey % 6 <> 2"))


@query("q003_safe_read", "SELECT doc_id, CASE WHEN strlen(text) <= 3000 AND doc_id % 3 > 0 THEN text END AS content FROM documents")
def safe_read(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "../x").otherwise("a/b").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return rows.select("doc_id", repo.readable(F.col("path"), F.col("content"), 3000).alias("content"))


@query("q004_preview", "SELECT doc_id, substr(text, 1, 200) AS text, length(text) > 200 AS cut FROM documents")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text"), 200).alias("p")).select("doc_id", "p.*")


@query("q006_line_ranges", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1 + doc_id % 3:3 + doc_id % 4], chr(10)) AS lines FROM documents WHERE text IS NOT NULL")
def line_ranges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", text.lines_between(F.col("text"), F.expr("cast(1 + doc_id % 3 as int)"), F.expr("cast(3 + doc_id % 4 as int)")).alias("lines"))


@query("q007_listing", f"SELECT DISTINCT name, is_dir FROM (SELECT CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE path END AS name, contains(path, '/') AS is_dir FROM (SELECT {TREE_PATH} AS path FROM part)) ORDER BY is_dir DESC, lower(name) LIMIT 100")
def listing(spark, sf_dir):
    return repo.listing(tree(spark, sf_dir), "").select("name", "is_dir")


@query("q008_existing_paths", f"SELECT s_suppkey AS id, 'src/m' || s_suppkey || '.py' IN (SELECT {TREE_PATH} FROM part) AS found FROM supplier")
def existing_paths(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), filled("src/mKEY.py", F.col("s_suppkey")).alias("path"))
    return repo.existing(wanted, tree(spark, sf_dir)).select("id", "found")


@query(
    "q010_fingerprint",
    f"""
WITH f AS (SELECT p_size % 10 AS tree_id, p_partkey % 6 AS k, p_size * 30000 AS b FROM part WHERE p_partkey % 6 <> 3),
l AS (SELECT tree_id, CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' END AS language, count(*) AS n FROM f WHERE k < 2 GROUP BY 1, 2),
r AS (SELECT tree_id, list(language ORDER BY n DESC, language) AS languages FROM l GROUP BY 1)
SELECT tree_id, count(*) AS file_count, sum(b)::BIGINT AS total_size, coalesce(any_value(languages), []) AS languages, any_value(languages)[1] AS primary_language,
  list_sort(list_distinct(list_filter(list(CASE k WHEN 1 THEN 'kubernetes' WHEN 2 THEN 'docker' WHEN 5 THEN 'dotnet' END) || [CASE WHEN tree_id % 2 = 0 THEN 'flask' END], lambda x: x IS NOT NULL))) AS frameworks, count(*) > 10000 OR sum(b) > 500000000 AS large
FROM f LEFT JOIN r USING (tree_id) GROUP BY tree_id""",
)
def fingerprint(spark, sf_dir):
    deps = parts(spark, sf_dir).where("p_size % 2 = 0").selectExpr("p_size % 10 AS tree_id", "'Flask' AS name")
    return repo.fingerprint(tree(spark, sf_dir), deps)


_IGNORED = [("# none", None, None), (" /build/ ", "prefix", "build"), ("*.log", "glob", "*.log"), ("", None, None), ("./gen", "prefix", "gen"), ("docs/[ab]/", "glob", "docs/[ab]")]


@query("q087_ignore_policy", "SELECT DISTINCT p_size AS tree_id, kind, pattern FROM part JOIN (VALUES " + ", ".join(f"({i}, {repr(k) if k else 'NULL'}, {repr(p) if p else 'NULL'})" for i, (_, k, p) in enumerate(_IGNORED)) + f") v(i, kind, pattern) ON p_partkey % {len(_IGNORED)} = i WHERE kind IS NOT NULL")
def ignore_policy(spark, sf_dir):
    line = F.get(F.array(*[F.lit(x) for x, _, _ in _IGNORED]), (F.col("p_partkey") % len(_IGNORED)).cast("int"))
    return repo.ignore_policy(parts(spark, sf_dir).select(F.col("p_size").alias("tree_id"), line.alias("line")))


@query("q026_file_content", "SELECT p_partkey AS file_id, CASE WHEN p_partkey % 4 > 0 AND length(p_name) <= 12 THEN p_name END AS content FROM part")
def file_content(spark, sf_dir):
    path = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'a/../../x' WHEN 1 THEN 'a/../x' ELSE 'x' END")
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("file_id"), repo.readable(path, F.encode("p_name", "UTF-8"), 12).alias("content"))


_DIRS = ["python/lang", "python/django", "python/flask", "javascript/browser", "typescript/react", "go", "go/lang", "java/lang", "dockerfile/security", "terraform/aws"]


def _dirs(spark):
    return spark.createDataFrame([(d,) for d in _DIRS], "path string")


_LIST = "(SELECT unnest([" + ", ".join(f"'{d}'" for d in _DIRS) + "]) AS path)"


@query("q065_rule_directories", f"SELECT path FROM {_LIST} WHERE string_split(path, '/')[1] IN ('python', 'typescript', 'javascript', 'dockerfile')")
def rule_directories(spark, sf_dir):
    markers = tree(spark, sf_dir).where("path = 'Dockerfile'").selectExpr("'dockerfile' AS kind")
    return rules.directories(_dirs(spark), ["python", "typescript"], ["dockerfile", "terraform"], markers)


_SIGNALS = [("django", "python/django"), ("flask", "python/flask"), ("react", "typescript/react"), ("react", "javascript/none"), ("spring", "java/lang")]


@query("q066_signal_directories", "SELECT * FROM (VALUES ('python/django'), ('typescript/react')) v(path)")
def signal_directories(spark, sf_dir):
    found = parts(spark, sf_dir).selectExpr("CASE p_partkey % 3 WHEN 0 THEN 'django' WHEN 1 THEN 'react' ELSE 'spring' END AS signal")
    return rules.for_signals(spark.createDataFrame(_SIGNALS, "signal string, path string"), found, _dirs(spark), ["python", "typescript"])


@query("q067_good_rules", "SELECT 'm' || p_partkey || '/r.yaml' AS path, r AS id FROM part, (SELECT unnest(['a', 'b']) AS r) WHERE NOT (r = 'b' AND p_partkey % 3 = 0)")
def good_rules(spark, sf_dir):
    files = files_of_parts(spark, sf_dir, "r.yaml", "rules:\n- id: a\n  languages: [python]\n- id: b\n  languages: [go]\n")
    bad = parts(spark, sf_dir).where("p_partkey % 3 = 0").select(filled("mKEY/r.yaml", F.col("p_partkey")).alias("path"), F.lit("b").alias("id"))
    return rules.without(rules.read(files), bad).select("path", "id")


#: Directories of rules, two levels deep or at the root, made from parts.
_PART_DIR = "concat(CASE p_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'java' WHEN 3 THEN 'rust' ELSE 'ruby' END, '/d', cast(p_partkey % 11 as string))"
_ROOT = "CASE p_partkey % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'swift' WHEN 2 THEN 'rust' WHEN 3 THEN concat('go/d', cast(p_partkey % 4 as string)) ELSE 'ruby/none' END"


def _part_dirs(spark, sf_dir, where="true", path=_PART_DIR):
    return parts(spark, sf_dir).where(where).selectExpr(f"{path} AS path")


@query("q068_targeted_directories", f"SELECT DISTINCT path FROM (SELECT {_PART_DIR} AS path FROM part) WHERE path NOT IN (SELECT {_PART_DIR} FROM part WHERE p_size % 10 = 3 AND p_partkey % 11 < 6) AND path NOT IN (SELECT {_PART_DIR} FROM part WHERE p_partkey % 5 = 1 AND p_size > 45)")
def targeted_directories(spark, sf_dir):
    return rules.targeted(_part_dirs(spark, sf_dir), _part_dirs(spark, sf_dir, "p_size % 10 = 3 and p_partkey % 11 < 6"), _part_dirs(spark, sf_dir, "p_partkey % 5 = 1 and p_size > 45"))


@query("q076_expanded_roots", f"WITH s AS (SELECT DISTINCT {_ROOT} AS path FROM part), d AS (SELECT DISTINCT {_PART_DIR} AS path FROM part) SELECT path FROM s WHERE path LIKE '%/%' UNION SELECT coalesce(d.path, s.path) FROM s LEFT JOIN d ON d.path LIKE s.path || '/%' WHERE s.path NOT LIKE '%/%'")
def expanded_roots(spark, sf_dir):
    return rules.expanded(_part_dirs(spark, sf_dir, path=_ROOT), _part_dirs(spark, sf_dir))


@query("q075_accepted_languages", "SELECT p_partkey AS id, p_partkey % 4 IN (0, 1) AS accepted FROM part")
def accepted_languages(spark, sf_dir):
    language = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'javascript' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' ELSE 'java' END")
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), rules.accepts(language, ["typescript"]).alias("accepted"))


@query("q079_suite_matches", "SELECT p_partkey AS id, p_partkey % 5 IN (0, 1, 2) AS hit FROM part")
def suite_matches(spark, sf_dir):
    suite = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'JavaScript-security.qls' WHEN 1 THEN 'codeql/typescript-queries' WHEN 2 THEN concat('x', chr(92), 'javascript-all') WHEN 3 THEN 'python-security.qls' ELSE 'myjavascript-x' END")
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), rules.suite_matches(F.lit("javascript"), suite).alias("hit"))


_SUITE = "concat(CASE p_partkey % 3 WHEN 0 THEN 'python-' WHEN 1 THEN 'codeql/javascript-' ELSE 'go/' END, 's', cast(p_partkey % 17 as string), '.qls')"


def _suites(spark, sf_dir, where):
    return parts(spark, sf_dir).where(where).selectExpr(f"{_SUITE} AS suite")


@query("q070_planned_suites", f"SELECT DISTINCT {_SUITE} AS suite FROM part WHERE p_size < 9 AND p_partkey % 3 = 0")
def planned_suites(spark, sf_dir):
    """What is asked for, of the language, each once."""
    return rules.planned_suites(_suites(spark, sf_dir, "p_size < 9"), _suites(spark, sf_dir, "p_size > 20"), _suites(spark, sf_dir, "p_size > 30"), "python")


@query("q080_targeted_suites", f"SELECT DISTINCT {_SUITE} AS suite FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 17 < 12 AND {_SUITE} NOT IN (SELECT {_SUITE} FROM part WHERE p_partkey % 17 < 5)")
def targeted_suites(spark, sf_dir):
    """Nothing of the language is asked for: the defaults that the baseline has not run."""
    return rules.planned_suites(_suites(spark, sf_dir, "p_partkey % 3 = 2"), _suites(spark, sf_dir, "p_partkey % 17 < 12"), _suites(spark, sf_dir, "p_partkey % 17 < 5"), "typescript")


_CHOICES = [(0, "python", "django", "dir", "python/django"), (1, "python", "flask", "dir", "python/flask"), (2, "python", None, "theme", "sqli"), (3, "javascript", None, "theme", "xss"), (4, "php", None, "theme", "sqli"), (5, "php", None, "theme", "xss")]


@query("q074_heuristic_rules", "WITH l AS (SELECT p_partkey AS t, CASE p_partkey % 3 WHEN 0 THEN ['python'] WHEN 1 THEN ['javascript', 'php'] ELSE ['go'] END AS ls FROM part) SELECT t AS tree_id, 'theme' AS kind, CASE WHEN t % 3 = 0 THEN 'sqli' ELSE 'xss' END AS value, 1 AS place FROM l WHERE t % 3 < 2 UNION ALL SELECT t, 'theme', 'sqli', 2 FROM l WHERE t % 3 = 1 UNION ALL SELECT t, 'dir', 'python/flask', 1 FROM l WHERE t % 3 = 0 AND t % 2 = 0")
def heuristic_rules(spark, sf_dir):
    rows = parts(spark, sf_dir)
    languages = rows.selectExpr("p_partkey AS tree_id", "explode(CASE p_partkey % 3 WHEN 0 THEN array('Python') WHEN 1 THEN array('javascript', 'php') ELSE array('go') END) AS language")
    frameworks = rows.selectExpr("p_partkey AS tree_id", "CASE WHEN p_partkey % 2 = 0 THEN 'Flask' ELSE 'none' END AS framework")
    return rules.heuristic(languages, frameworks, spark.createDataFrame(_CHOICES, "ordinal int, language string, framework string, kind string, value string"))


_HITS = "(SELECT l_orderkey % 200 AS scan_id, case when l_partkey % 5 > 0 then l_partkey % 5 end AS file_id, l_returnflag AS rule_id, cast(l_linenumber as int) AS start_line FROM lineitem)"


@query("q072_new_hits", f"SELECT DISTINCT scan_id, file_id, rule_id, start_line FROM {_HITS} WHERE start_line > 3 OR (start_line = 3 AND scan_id >= 20)")
def new_hits(spark, sf_dir):
    """Hits that are not stored yet; a hit without a file is stored by its other fields."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 200 AS scan_id", "case when l_partkey % 5 > 0 then l_partkey % 5 end AS file_id", "l_returnflag AS rule_id", "cast(l_linenumber as int) AS start_line")
    return findings.persist_new(rows.where("start_line = 3 and scan_id < 20"), rows.where("start_line > 2"), ["scan_id", "file_id", "rule_id", "start_line"])


@query("q073_targeted_hits", "SELECT 'f' || l_partkey % 50 AS file_path, count(DISTINCT l_orderkey * 10 + l_linenumber)::DOUBLE * 5 AS boost FROM lineitem WHERE l_linenumber > 2 GROUP BY 1")
def targeted_hits(spark, sf_dir):
    """New hits of a targeted run boost their files."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("hit"), filled("fKEY", F.col("l_partkey") % 50).alias("file_path"), "l_linenumber")
    new = findings.persist_new(rows.where("l_linenumber <= 2"), rows, ["hit", "file_path"])
    return findings.hit_boosts(new).groupBy("file_path").agg(F.sum("boost").alias("boost"))


@query("q030_parser_dispatch", "SELECT p_partkey AS id, p_partkey % 5 IN (0, 1, 2) AS manifest FROM part")
def parser_dispatch(spark, sf_dir):
    path = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'a/package.json' WHEN 1 THEN 'x/My.csproj' WHEN 2 THEN 'go.sum' WHEN 3 THEN 'package.json.bak' ELSE 'src/setup.pyc' END")
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), manifests.is_manifest(path).alias("manifest"))


@query("q037_requirement_lines", "SELECT 'm' || p_partkey || '/requirements.txt' AS source_file, unnest(['a' || p_partkey, 'b', 'c.d']) AS name, unnest(['1.0', p_size || '.5', '2']) AS version FROM part")
def requirement_lines(spark, sf_dir):
    return manifests.dependencies(files_of_parts(spark, sf_dir, "requirements.txt", "aKEY>=1.0,<3\nb[x,y]~=SIZE.5 ; python_version<'3'\n# no\n-r other\ngit+https://x\n./local\nnone\nc.d===2\n")).select("source_file", "name", "version")


_PINNED = {"package.json": '{"dependencies":{"aKEY":"^SIZE.1","b":"*"},"devDependencies":{"c":"~1.2.3","d":"latest"}}', "composer.json": '{"require":{"php":">=8.1","v/aKEY":"^SIZE.1"}}', "requirements.txt": "AKEY==SIZE.1\nb>=2.0\n  c == 3.1  \n"}


@query("q056_pinned_versions", "SELECT 'm' || p_partkey || '/package.json' AS source_file, unnest(['a' || p_partkey, 'c']) AS package, unnest([p_size || '.1', '1.2.3']) AS version FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'm' || p_partkey || '/composer.json', 'v/a' || p_partkey, p_size || '.1' FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT 'm' || p_partkey || '/requirements.txt', unnest(['a' || p_partkey, 'c']), unnest([p_size || '.1', '3.1']) FROM part WHERE p_partkey % 3 = 2")
def pinned_versions(spark, sf_dir):
    rows = None
    for i, (name, content) in enumerate(_PINNED.items()):
        some = parts(spark, sf_dir).where(F.col("p_partkey") % 3 == i).select(filled(f"mKEY/{name}", F.col("p_partkey")).alias("path"), filled(content, F.col("p_partkey"), F.col("p_size")).alias("content"))
        rows = some if rows is None else rows.unionByName(some)
    return manifests.pinned(rows)


_DECLARED = {
    "package.json": ("npm", '{"peerDependencies":{"pkg-KEY":"*"}}', "pkg-KEY"),
    "Cargo.toml": ("crates.io", "[target.x.dependencies]\npkg-KEY = '1'\n", "pkg-KEY"),
    "Gemfile": ("rubygems", 'gem "pkg_KEY", "~> 1"\n', "pkg-KEY"),
    "go.mod": ("go", "require x.y/pkg-KEY v1.0.0\n", "x.y/pkg-KEY"),
    "mix.exs": ("hex", "{:pkg_KEY, \"~> 1\"}", "pkg-KEY"),
    "pubspec.yaml": ("pub", "dev_dependencies:\n  pkg_KEY: ^1\n", "pkg-KEY"),
    "composer.json": ("packagist", "{broken", "pkg-KEY"),
}


@query("q147_declared_dependencies", f"SELECT p_partkey AS id, p_partkey % {len(_DECLARED)} < 6 AND p_size % 2 = 0 AS declared FROM part")
def declared_dependencies(spark, sf_dir):
    files = asked = None
    for i, (name, (ecosystem, content, package)) in enumerate(_DECLARED.items()):
        rows = parts(spark, sf_dir).where(F.col("p_partkey") % len(_DECLARED) == i)
        path = filled(f"mKEY/{name}", F.col("p_partkey"))
        one = rows.select(path.alias("path"), filled(content, F.col("p_partkey")).alias("content"))
        question = rows.select(F.col("p_partkey").alias("id"), path.alias("source_file"), F.lit(ecosystem).alias("ecosystem"), F.when(F.col("p_size") % 2 == 0, filled(package, F.col("p_partkey"))).otherwise("other").alias("name"))
        files, asked = (one, question) if files is None else (files.unionByName(one), asked.unionByName(question))
    return manifests.declares(asked, files).select("id", "declared")


def _facts(spark, sf_dir, language: str, name: str, content: str):
    return structure.facts(files_of_parts(spark, sf_dir, name, content).withColumn("language", F.lit(language)))


def _fact_sql(name: str, *rows: tuple) -> str:
    """(kind, name, detail, line) of every file."""
    return " UNION ALL ".join(f"SELECT {filled_sql('mKEY/' + name, 'p_partkey')} AS path, '{k}' AS kind, {filled_sql(n, 'p_partkey')} AS name, {repr(d) if d else 'NULL'} AS detail, {line}::INT AS line FROM part" for k, n, d, line in rows)


_JS = "import {Router, rest} from 'express'\nconst app = Router()\nclass AKEY {}\napp.get('/xKEY', (q) => 1)\nfunction fKEY(a) {\n  return run(a)\n}\n"


@query("q244_script_structure", _fact_sql("a.js", ("import", "express", "Router", 1), ("import", "express", "rest", 1), ("class", "AKEY", None, 3), ("route", "/xKEY", "GET", 4), ("function", "fKEY", None, 5)))
def script_structure(spark, sf_dir):
    return _facts(spark, sf_dir, "javascript", "a.js", _JS).where("kind <> 'call'").select("path", "kind", "name", "detail", "line")


_JAVA = 'package p;\nimport org.x.ThingKEY;\npublic class BKEY {\n  @GetMapping("/yKEY")\n  public String fKEY(int a) {\n    return go(a);\n  }\n}\n'


@query("q245_java_structure", _fact_sql("B.java", ("import", "org.x.ThingKEY", None, 2), ("class", "BKEY", None, 3), ("route", "/yKEY", "GET", 4), ("function", "fKEY", None, 5)))
def java_structure(spark, sf_dir):
    rows = _facts(spark, sf_dir, "java", "B.java", _JAVA).where("kind <> 'call'")
    return rows.select("path", "kind", "name", F.when(F.col("kind") != "import", F.col("detail")).alias("detail"), "line")


_PHP = "<?php\nuse App\\ThingKEY;\nclass CKEY {\n  function fKEY($a) {\n    return go($a);\n  }\n}\nRoute::post('/zKEY', 'h');\n"


@query("q246_php_structure", _fact_sql("c.php", ("import", "App\\ThingKEY", None, 2), ("class", "CKEY", None, 3), ("function", "fKEY", None, 4), ("route", "/zKEY", "POST", 8)))
def php_structure(spark, sf_dir):
    rows = _facts(spark, sf_dir, "php", "c.php", _PHP).where("kind <> 'call'")
    return rows.select("path", "kind", "name", F.when(F.col("kind") != "import", F.col("detail")).alias("detail"), "line")


_PY = "import os\nfrom .a import b as c\n\n@app.post('/pKEY')\ndef fKEY(x, y):\n    return os.system(run(x))\n\nclass DKEY:\n    def m(self):\n        self.go()\n"


@query("q241_all_facts", "SELECT 'm' || p_partkey || '/d.py' AS path, unnest(['import', 'import', 'route', 'function', 'call', 'call', 'call', 'class', 'method', 'function', 'call']) AS kind, unnest(['os', '.a', '/p' || p_partkey, 'f' || p_partkey, 'post', 'system', 'run', 'D' || p_partkey, 'm', 'm', 'go']) AS name, unnest([1, 2, 4, 5, 4, 6, 6, 8, 9, 9, 10])::INT AS line FROM part")
def all_facts(spark, sf_dir):
    return _facts(spark, sf_dir, "python", "d.py", _PY).select("path", "kind", "name", "line")


@query("q247_parsed_files", "SELECT 'm' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '/d.py' WHEN 1 THEN '/d.rs' ELSE '/d.txt' END AS path, CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END AS n FROM part WHERE p_partkey % 3 < 2")
def parsed_files(spark, sf_dir):
    """How many imports, classes and functions each file has, by its language; unknown ones have none."""
    pick = lambda a, b, c: F.when(F.col("p_partkey") % 3 == 0, a).when(F.col("p_partkey") % 3 == 1, b).otherwise(c)
    files = spread(parts(spark, sf_dir).select("p_partkey"), "p_partkey").select(filled(pick("mKEY/d.py", "mKEY/d.rs", "mKEY/d.txt"), F.col("p_partkey")).alias("path"), pick("import os\nimport re\ndef f():\n  pass\nclass A: pass\n", "use std::io;\nfn main() { go(); }\n", "def f():\n").alias("content"), pick("python", "rust", "text").alias("language"))
    return structure.facts(files).where("kind <> 'call'").groupBy("path").agg(F.count("*").cast("int").alias("n"))


@query("q248_call_sites", "SELECT 'm' || p_partkey || '/d.py' AS path, unnest(['post', 'system', 'run', 'go']) AS name, unnest(['app', 'os', NULL, 'self']) AS object, unnest(['', 'f' || p_partkey, 'f' || p_partkey, 'm']) AS enclosing, unnest([4, 6, 6, 10])::INT AS line FROM part")
def call_sites(spark, sf_dir):
    rows = _facts(spark, sf_dir, "python", "d.py", _PY).where("kind = 'call'")
    return rows.select("path", "name", F.col("detail").alias("object"), F.coalesce("owner", F.lit("")).alias("enclosing"), "line")


@query("q027_symbols_of_file", "SELECT unnest(['f1', 'D1', 'm', 'm']) AS name, unnest(['function', 'class', 'method', 'function']) AS kind, unnest([5, 8, 9, 9])::INT AS line, unnest([6, 10, 10, 10])::INT AS end_line")
def symbols_of_file(spark, sf_dir):
    facts = _facts(spark, sf_dir, "python", "d.py", _PY)
    return facts.where("path = 'm1/d.py' and kind in ('function', 'class', 'method')").select("name", "kind", "line", "end_line")


@query("q171_routes", "SELECT 'm' || p_partkey || '/a.js' AS path, '/x' || p_partkey AS route, 'GET' AS method, 4::INT AS line, 1::BIGINT AS in_file FROM part")
def routes(spark, sf_dir):
    return structure.routes(_facts(spark, sf_dir, "javascript", "a.js", _JS)).drop("handler")


@query("q251_symbol_bodies", "SELECT 'm' || p_partkey || '/d.py' AS path, 'def f' || p_partkey || '(x, y):' || chr(10) || '    return os.system(run(x))' AS body FROM part")
def symbol_bodies(spark, sf_dir):
    files = files_of_parts(spark, sf_dir, "d.py", _PY)
    facts = structure.facts(files.withColumn("language", F.lit("python"))).where("kind = 'function' and name <> 'm'")
    return facts.join(files, "path").select("path", structure.body(F.col("content"), F.col("line"), F.col("end_line")).alias("body"))


_BLOCK = "def f():\n    a = 1\n\n# note\n    b = 2\n    # end\n\ndef g():\n    pass\n"


@query("q243_block_ends", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 9 ELSE 4 END::INT AS end_line FROM part")
def block_ends(spark, sf_dir):
    start = F.expr("CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 8 ELSE 2 END")
    indent = F.when(F.col("p_partkey") % 3 == 2, 4).otherwise(0)
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), structure.block_end(F.lit(_BLOCK), start, indent).alias("end_line"))


@query("q029_android_summaries", "SELECT 'm' || p_partkey || '/AndroidManifest.xml' AS path, 'p.' || p_partkey AS package, ['CAMERA'] AS permissions, ['.A' || p_partkey] AS exported, ['debuggable=true'] AS flags FROM part")
def android_summaries(spark, sf_dir):
    return structure.android_summary(structure.android(files_of_parts(spark, sf_dir, "AndroidManifest.xml", ANDROID_MANIFEST)))


def _sources(spark, sf_dir):
    """Sources of two of three parts: by file name, or in a file of another name."""
    path = F.when(F.col("p_partkey") % 3 == 0, filled("src/p/MyAKEY.java", F.col("p_partkey"))).when(F.col("p_partkey") % 3 == 1, filled("src/p/otherKEY.java", F.col("p_partkey"))).otherwise(filled("src/p/AKEY.txt", F.col("p_partkey")))
    return parts(spark, sf_dir).select(path.alias("path"), filled("package p;\nclass AKEY extends X {}\n", F.col("p_partkey")).alias("content"))


@query(
    "q239_component_sources",
    "WITH n AS (SELECT p_partkey AS k, 'src/p/' || CASE p_partkey % 3 WHEN 0 THEN 'MyA' ELSE 'other' END || p_partkey || '.java' AS path FROM part WHERE p_partkey % 3 < 2), m AS (SELECT a.p_partkey AS k, n.path FROM part a JOIN n ON n.k % 3 = 0 AND suffix(n.path, 'A' || a.p_partkey || '.java')) SELECT 'x.A' || k AS component, path FROM m UNION ALL SELECT 'x.A' || k, path FROM n WHERE k % 3 = 1 AND k NOT IN (SELECT k FROM m)",
)
def component_sources(spark, sf_dir):
    components = parts(spark, sf_dir).select(filled("x.AKEY", F.col("p_partkey")).alias("component"), F.lit(None).cast("string").alias("package"))
    return structure.component_sources(components, _sources(spark, sf_dir))


@query("q240_exported_components", "SELECT '.A' || p_partkey AS component, 'activity' AS kind, 'src/p/MyA' || p_partkey || '.java' AS path FROM part WHERE p_partkey % 3 = 0")
def exported_components(spark, sf_dir):
    """Exported parts of manifests with the files that their class is named by."""
    facts = structure.android(files_of_parts(spark, sf_dir, "AndroidManifest.xml", ANDROID_MANIFEST)).where("kind = 'exported'")
    named = structure.component_sources(facts.select(F.col("name").alias("component"), F.lit("p").alias("package")), _sources(spark, sf_dir).where("path like '%/My%'"))
    return facts.select(F.col("name").alias("component"), F.col("detail").alias("kind")).join(named.hint("merge"), "component")


def _labelled(name: str, kinds: list, content: str, found: list[tuple[str, int]]):
    rows = " UNION ALL ".join(f"SELECT '{label}' AS type, {filled_sql('mKEY/A.java', 'p_partkey')} AS path, {line}::INT AS line FROM part" for label, line in found)

    @query(name, f"SELECT type, path, line FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY path, line) AS r FROM ({rows})) WHERE r <= 8")
    def scan(spark, sf_dir):
        return patterns.labelled(files_of_parts(spark, sf_dir, "A.java", content), kinds, ["java", "kt"], 8).select("type", "path", "line")


_labelled("q237_insecure_storage", patterns.STORAGE, "x\nprefs = getSharedPreferences(KEY)\nLog.d(TAG, password)\ndb.rawQuery (q)\nLog.d(TAG, size)\n", [("SharedPreferences (plaintext)", 2), ("Logging sensitive data", 3), ("SQLite raw query", 4)])
_labelled("q238_network_issues", patterns.NETWORK, "http://localhost/a\nget('http://api.KEY/b')\nnew X509TrustManager()\nCertificatePinner p\n", [("HTTP cleartext", 2), ("Custom TrustManager", 3), ("Cert pinning", 4)])


@query("q028_resolved_imports", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'pkg/mod' || o_custkey || '.py' END AS resolved_path, CASE WHEN o_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, o_custkey % 2 > 0 AS is_external FROM orders WHERE o_orderkey % 10 = 3")
def resolved_imports(spark, sf_dir):
    """The resolved imports of one file of ten."""
    orders = table(spark, sf_dir, "orders")
    imports = orders.select(F.col("o_orderkey").alias("id"), filled("src/fKEY.py", F.col("o_orderkey") % 10).alias("source_file"), filled("pkg.modKEY", F.col("o_custkey")).alias("module"), F.lit("python").alias("language"))
    files = orders.where("o_custkey % 2 = 0").select(filled("pkg/modKEY.py", F.col("o_custkey")).alias("path")).distinct()
    return joins.resolve_imports(imports.where("source_file = 'src/f3.py'"), files)


@query("q127_mixed_imports", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'pkg/mod' || o_custkey || '.py' ELSE 'src/App/Mod' || o_custkey || '.php' END AS resolved_path, CASE WHEN o_custkey % 3 = 0 THEN 0.0 WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence FROM orders")
def mixed_imports(spark, sf_dir):
    """Imports of two languages in one pass."""
    orders, even = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 2 == 0
    imports = orders.select(F.col("o_orderkey").alias("id"), F.when(even, "a.py").otherwise("a.php").alias("source_file"), F.when(even, filled("pkg.modKEY", F.col("o_custkey"))).otherwise(filled("App\\ModKEY", F.col("o_custkey"))).alias("module"), F.when(even, "python").otherwise("php").alias("language"))
    there = orders.where("o_custkey % 3 > 0")
    files = there.select(filled("pkg/modKEY.py", F.col("o_custkey")).alias("path")).union(there.select(filled("src/App/ModKEY.php", F.col("o_custkey")))).distinct()
    return joins.resolve_imports(imports, files).select("id", "resolved_path", "confidence")


@query("q140_two_enclosing_symbols", "WITH s AS (SELECT l_orderkey AS file, l_linenumber * 1000000 + l_partkey AS name, l_partkey % 400 AS a, l_partkey % 400 + 5 + l_linenumber * 9 AS b FROM lineitem) SELECT line_id, name, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY b - a, a DESC, name) AS r FROM (SELECT DISTINCT o_orderkey AS line_id, s.name, a, b FROM orders JOIN s ON o_orderkey = s.file AND a <= o_custkey % 450 AND o_custkey % 450 <= b)) WHERE r <= 2")
def two_enclosing_symbols(spark, sf_dir):
    symbols = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS file", "l_linenumber * 1000000 + l_partkey AS name", "l_partkey % 400 AS start_line", "l_partkey % 400 + 5 + l_linenumber * 9 AS end_line").distinct()
    spots = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS line_id", "o_orderkey AS file", "o_custkey % 450 AS line")
    return joins.enclosing_symbols(spots, symbols, 2).select("line_id", "name", "rank")


@query("q142_component_members", "SELECT component, count(*) AS n, count(DISTINCT file_path) AS files FROM " + sql(FINDINGS) + " f JOIN (VALUES ('API', 'src/api'), ('Db', 'src/core/db'), ('File', 'src/web/f7.py')) c(component, prefix) ON f.file_path = prefix OR starts_with(f.file_path, prefix || '/') GROUP BY 1")
def component_members(spark, sf_dir):
    members = spark.createDataFrame([("API", ["src/api"]), ("Db", ["src/core/db"]), ("File", ["src/web/f7.py"])], "component string, files array<string>")
    return rollups.in_component(frame(spark, sf_dir, FINDINGS), members, separator=True).groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))


@query("q125_function_usage", "SELECT DISTINCT s_suppkey AS id, 'f' || o_orderkey % 20 AS file, o_orderkey AS line FROM orders JOIN supplier ON o_custkey % 100 = s_suppkey % 100 WHERE o_orderkey % 2 = 0")
def function_usage(spark, sf_dir):
    symbols = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), filled("`Lib.loadKEY(x)`", F.col("s_suppkey") % 100).alias("symbol"))
    name = F.when(F.col("o_orderkey") % 2 == 0, filled("LoadKEY", F.col("o_custkey") % 100)).otherwise("other")
    calls = table(spark, sf_dir, "orders").select(filled("fKEY", F.col("o_orderkey") % 20).alias("file"), name.alias("function"), F.lit("x").alias("object"), F.col("o_orderkey").alias("line"))
    return joins.function_usage(symbols, calls).select("id", "file", "line")


@query("q221_call_graph", f"SELECT caller, callee, count(*) AS calls, min(edge_id) AS first_edge FROM {EDGE} GROUP BY 1, 2")
def call_graph(spark, sf_dir):
    return graph.call_graph(frame(spark, sf_dir, EDGES))


_PAIRS = "(SELECT DISTINCT 'f' || s_suppkey % 997 AS source, 'f' || (s_suppkey + 1 + s_suppkey % 25) % 998 AS target FROM supplier)"


@query("q226_traced_chains", "WITH RECURSIVE e AS (SELECT DISTINCT caller AS a, callee AS b FROM {edge}), r(s, n, h) AS (SELECT DISTINCT source, source, 0 FROM {pairs} UNION SELECT s, b, h + 1 FROM r JOIN e ON n = a WHERE h < 6), m AS (SELECT s, n, min(h) AS hops FROM r GROUP BY 1, 2) SELECT source, target, hops IS NOT NULL AS reachable, hops::INT AS hops FROM {pairs} LEFT JOIN m ON s = source AND n = target".format(edge=EDGE, pairs=_PAIRS))
def traced_chains(spark, sf_dir):
    pairs = table(spark, sf_dir, "supplier").selectExpr("concat('f', cast(s_suppkey % 997 as string)) AS source", "concat('f', cast((s_suppkey + 1 + s_suppkey % 25) % 998 as string)) AS target").distinct()
    found = graph.find_path(frame(spark, sf_dir, EDGES), pairs, 6)
    return pairs.join(found, ["source", "target"], "left").select("source", "target", F.col("hops").isNotNull().alias("reachable"), "hops")


@query("q229_entry_totals", "WITH n AS ({reach}) SELECT target, count(*) AS total FROM n GROUP BY 1".format(reach=REACH_SQL.format(a="callee", b="caller", edge=EDGE, starts="(SELECT DISTINCT 'f' || s_suppkey % 40 AS s FROM supplier)", hops=8, out="s AS target, n AS entry", where=f"hops > 0 AND hops < 8 AND n NOT IN (SELECT callee FROM {EDGE})")))
def entry_totals(spark, sf_dir):
    """How many entry points reach each function of a table."""
    targets = table(spark, sf_dir, "supplier").selectExpr("concat('f', cast(s_suppkey % 40 as string)) AS node").distinct()
    return graph.entry_points(frame(spark, sf_dir, EDGES), targets, 8).groupBy("target").agg(F.count("*").alias("total"))


@query("q227_verified_flows", "WITH RECURSIVE e AS (SELECT DISTINCT caller AS a, callee AS b FROM {edge}), f AS (SELECT s_suppkey AS flow_id, 'f' || s_suppkey % 997 AS a, 'f' || (s_suppkey + 1 + s_suppkey % 25) % 998 AS z FROM supplier), r(s, n, h) AS (SELECT DISTINCT a, a, 0 FROM f UNION SELECT s, b, h + 1 FROM r JOIN e ON n = a WHERE h < 6) SELECT flow_id, EXISTS (SELECT 1 FROM r WHERE s = f.a AND n = f.z) AS graph_verified FROM f".format(edge=EDGE))
def verified_flows(spark, sf_dir):
    """Flows between files of one function each, verified where calls join them."""
    name = lambda c: F.concat_ws("::", c, F.lit("main"))
    calls = frame(spark, sf_dir, EDGES).select("edge_id", name("caller").alias("caller"), name("callee").alias("callee"))
    nodes = frame(spark, sf_dir, EDGES).select(F.explode(F.array("caller", "callee")).alias("file")).distinct()
    symbols = nodes.select("file", F.lit("main").alias("name"), F.lit(1).alias("start_line"), F.lit(100).alias("end_line"))
    flows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS flow_id", "concat('f', cast(s_suppkey % 997 as string)) AS source_file", "5 AS source_line", "concat('f', cast((s_suppkey + 1 + s_suppkey % 25) % 998 as string)) AS sink_file", "7 AS sink_line")
    return graph.verify_flows(flows, calls, symbols).select("flow_id", "graph_verified")


@query("q294_boost_totals", "SELECT file_path, sum(boost)::DOUBLE AS boost, count(*) AS events FROM (SELECT 'f' || l_suppkey AS file_path, 4 AS boost FROM lineitem UNION ALL SELECT 'f' || o_custkey, 5 FROM orders) GROUP BY 1")
def boost_totals(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select(filled("fKEY", F.col("l_suppkey")).alias("file_path"), F.lit(4.0).alias("boost"))
    more = table(spark, sf_dir, "orders").select(filled("fKEY", F.col("o_custkey")).alias("file_path"), F.lit(5.0).alias("boost"))
    return findings.accumulated(hits.unionByName(more))


@query("q194_report_flows", "SELECT user_id % 50 AS source_file, event_type AS sink_file, bool_or(event_id % 3 = 0) AS sanitised, max(event_id % 7 / 10.0)::DOUBLE AS confidence FROM events GROUP BY 1, 2")
def report_flows(spark, sf_dir):
    """Flows of reports, of one source and sink as one."""
    rows = table(spark, sf_dir, "events").selectExpr("cast(user_id % 50 as int) AS source_file", "1 AS source_line", "'in' AS source_type", "event_type AS sink_file", "2 AS sink_line", "'out' AS sink_type", "event_id % 3 = 0 AS sanitised", "cast(event_id % 7 / 10.0 as double) AS confidence", "array('x') AS intermediaries")
    return findings.dedupe_flows(rows).select("source_file", "sink_file", "sanitised", "confidence")


@query("q057_scanner_hits", "SELECT 'r' || p_partkey AS rule_id, 'low' AS severity, 'm' AS message, 'a.py' AS file_path, p_size AS start_line, 99::INT AS end_line, 'x = ' || p_partkey AS snippet FROM part")
def scanner_hits(spark, sf_dir):
    report = filled('{"results":[{"check_id":"rKEY","path":"a.py","start":{"line":SIZE},"end":{"line":99},"extra":{"message":"m","severity":"INFO","lines":"x = KEY"}}]}', F.col("p_partkey"), F.col("p_size"))
    return scanners.semgrep(parts(spark, sf_dir).select(report.alias("report"))).select("rule_id", "severity", "message", "file_path", "start_line", "end_line", "snippet")


@query("q298_gap_reasons", "SELECT finding_id, CASE WHEN NOT gap THEN NULL WHEN contains(file_path, '/tests/') THEN 'low context' ELSE 'no flow' END AS reason FROM (SELECT *, severity IN ('critical', 'high') AND coalesce(category IN ('injection', 'xss', 'ssrf'), false) AND confidence < 0.9 AS gap FROM " + sql(FINDINGS) + ")")
def gap_reasons(spark, sf_dir):
    rows = frame(spark, sf_dir, FINDINGS).withColumn("needs_context", F.coalesce(F.col("category").isin("injection", "xss", "ssrf"), F.lit(False)))
    return rows.select("finding_id", reads.gap_reason(F.col("severity"), F.col("needs_context"), F.col("confidence") >= 0.9, F.col("file_path")).alias("reason"))


@query("q149_keys_of_names", f"SELECT id, ecosystem = 'npm' OR ecosystem IN ('pypi', 'hex') AS same FROM {sql(DEPENDENCIES)} WHERE ecosystem <> 'maven'")
def keys_of_names(spark, sf_dir):
    rows = frame(spark, sf_dir, DEPENDENCIES).where("ecosystem <> 'maven'")
    return rows.select("id", packages.keys_overlap(F.upper("name"), F.col("name"), F.col("ecosystem")).alias("same"))


@query("q322_json_artifacts", "SELECT p_partkey, p_name, p_size FROM part")
def json_artifacts(spark, sf_dir):
    """Rows that are written as compressed JSON and read again."""
    from ..sinks import round_trip

    return round_trip(parts(spark, sf_dir).select("p_partkey", "p_name", "p_size"), "json")


@query("q323_persisted_findings", f"SELECT finding_id, min(severity) AS severity FROM {sql(FINDINGS)} GROUP BY 1")
def persisted_findings(spark, sf_dir):
    """Findings that are persisted by severity, each id once, and read again."""
    from ..sinks import round_trip

    rows = frame(spark, sf_dir, FINDINGS).select("finding_id", "severity")
    return round_trip(rows.union(rows).groupBy("finding_id").agg(F.min("severity").alias("severity")), "parquet", "severity")
