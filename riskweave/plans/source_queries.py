"""Queries of manifests, scanner reports, import resolution and call sites. Each row of a table
becomes a small file or report by a template, so SQL can say what must be read from it: KEY and SIZE
stand for the row's key and size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, paths, patterns, text
from ..functions.columns import lookup
from ..operators import findings, graph, joins, planning
from ..session import spread, table
from ..sources import advisories, manifests, repo, rules, scanners, structure
from .bindings import DEPENDENCIES, FILES, FINDINGS, frame, sql
from .column_queries import NORMAL_SQL
from .registry import query


def filled(template: str, key, size=None):
    """A template with a row's values."""
    out = F.replace(F.lit(template), F.lit("KEY"), key.cast("string"))
    return out if size is None else F.replace(out, F.lit("SIZE"), size.cast("string"))


def filled_sql(template: str, key: str, size: str = "''") -> str:
    literal = template.replace("'", "''")
    return f"replace(replace('{literal}', 'KEY', CAST({key} AS VARCHAR)), 'SIZE', CAST({size} AS VARCHAR))"


#: Query, ecosystem, file name, content, and the names, versions and kinds (for development) in it.
MANIFESTS = [
    ("q033_package_json", "npm", "package.json", '{"dependencies":{"aKEY":"^SIZE.1.0"},"devDependencies":{"bKEY":"~SIZE.2.0"},"peerDependencies":{"cKEY":"workspace:*"}}', ("aKEY", False), ("bKEY", True)),
    ("q034_package_lock", "npm", "package-lock.json", '{"packages":{"":{"name":"r"},"node_modules/aKEY":{"version":"SIZE.1.0"},"node_modules/aKEY/node_modules/@s/bKEY":{"version":"SIZE.2.0","dev":true}}}', ("aKEY", False), ("@s/bKEY", True)),
    ("q035_yarn_lock", "npm", "yarn.lock", '"@s/aKEY@^1", "@s/aKEY@^1.1":\n  version "SIZE.1.0"\nbKEY@2:\n  version "SIZE.2.0"\n', ("@s/aKEY", False), ("bKEY", False)),
    ("q036_pnpm_lock", "npm", "pnpm-lock.yaml", "packages:\n  /aKEY@SIZE.1.0:\n    x: 1\n  /@s/bKEY@SIZE.2.0:\n    x: 1\n", ("aKEY", False), ("@s/bKEY", False)),
    ("q038_requirements", "pypi", "requirements.txt", 'aKEY==SIZE.1.0\n# none\n-e .\nbKEY[x]>=SIZE.2.0; python_version > "3"\nunpinned\n', ("aKEY", False), ("bKEY", False)),
    ("q039_pipfile_lock", "pypi", "Pipfile.lock", '{"default":{"aKEY":{"version":"==SIZE.1.0"}},"develop":{"bKEY":{"version":"==SIZE.2.0"}}}', ("aKEY", False), ("bKEY", True)),
    ("q040_poetry_lock", "pypi", "poetry.lock", '[[package]]\nname = "aKEY"\nversion = "SIZE.1.0"\n[[package]]\nname = "bKEY"\nversion = "SIZE.2.0"\ncategory = "dev"\n', ("aKEY", False), ("bKEY", True)),
    ("q041_cargo_lock", "crates.io", "Cargo.lock", '[[package]]\nname = "aKEY"\nversion = "SIZE.1.0"\n\n[[package]]\nname = "bKEY"\nversion = "SIZE.2.0"\n', ("aKEY", False), ("bKEY", False)),
    ("q042_go_mod", "go", "go.mod", "module m\nrequire x.y/single v1.0.0\nrequire (\n\tx.y/aKEY vSIZE.1.0\n\tx.y/bKEY vSIZE.2.0 // indirect\n)\n", ("x.y/aKEY", False), ("x.y/bKEY", False)),
    ("q043_go_sum", "go", "go.sum", "x.y/aKEY vSIZE.1.0 h1:q=\nx.y/bKEY vSIZE.2.0/go.mod h1:q=\n", ("x.y/aKEY", False), ("x.y/bKEY", False)),
    ("q044_gemfile_lock", "rubygems", "Gemfile.lock", "GEM\n  specs:\n    aKEY (SIZE.1.0)\n      rack (>= 2)\n    bKEY (SIZE.2.0)\nPLATFORMS\n  ruby\n", ("aKEY", False), ("bKEY", False)),
    ("q045_pom_xml", "maven", "pom.xml", '<project xmlns="m"><dependencies><dependency><groupId>g</groupId><artifactId>aKEY</artifactId><version>SIZE.1.0</version></dependency><dependency><groupId>g</groupId><artifactId>bKEY</artifactId><version>SIZE.2.0</version><scope>test</scope></dependency></dependencies></project>', ("g:aKEY", False), ("g:bKEY", True)),
    ("q046_build_gradle", "maven", "build.gradle", "implementation 'g:aKEY:SIZE.1.0'\ntestImplementation(\"g:bKEY:SIZE.2.0\")\n", ("g:aKEY", False), ("g:bKEY", True)),
    ("q047_csproj", "nuget", "App.csproj", '<Project><ItemGroup><PackageReference Include="aKEY" Version="SIZE.1.0"/><PackageReference Update="bKEY"><Version>SIZE.2.0</Version></PackageReference></ItemGroup></Project>', ("aKEY", False), ("bKEY", False)),
    ("q048_packages_config", "nuget", "packages.config", '<packages><package id="aKEY" version="SIZE.1.0"/><package id="bKEY" version="SIZE.2.0" developmentDependency="true"/></packages>', ("aKEY", False), ("bKEY", True)),
    ("q049_composer_lock", "packagist", "composer.lock", '{"packages":[{"name":"v/aKEY","version":"vSIZE.1.0"}],"packages-dev":[{"name":"v/bKEY","version":"SIZE.2.0"}]}', ("v/aKEY", False), ("v/bKEY", True)),
    ("q050_composer_json", "packagist", "composer.json", '{"require":{"php":">=8","ext-x":"*","v/aKEY":"^SIZE.1.0"},"require-dev":{"v/bKEY":"~SIZE.2.0"}}', ("v/aKEY", False), ("v/bKEY", True)),
    ("q051_pubspec_lock", "pub", "pubspec.lock", "packages:\n  aKEY:\n    dependency: transitive\n    source: hosted\n    version: 'SIZE.1.0'\n  bKEY:\n    dependency: 'direct dev'\n    source: hosted\n    version: 'SIZE.2.0'\n  mine:\n    source: path\n    version: '1.0.0'\n", ("aKEY", False), ("bKEY", True)),
    ("q052_mix_lock", "hex", "mix.lock", '%{"aKEY": {:hex, :aKEY, "SIZE.1.0", "x"}, "bKEY": {:hex, :bKEY, "SIZE.2.0", "x"}, "g": {:git, "u", "r", []}}', ("aKEY", False), ("bKEY", False)),
    ("q053_setup_py", "pypi", "setup.py", "from setuptools import setup\nsetup(install_requires=['aKEY==SIZE.1.0'], extras_require={'d': ['bKEY>=SIZE.2.0']})\n", ("aKEY", False), ("bKEY", True)),
    ("q054_setup_cfg", "pypi", "setup.cfg", "[options]\ninstall_requires =\n  aKEY==SIZE.1.0\n[options.extras_require]\nt =\n  bKEY==SIZE.2.0\n", ("aKEY", False), ("bKEY", True)),
]


def files_of_parts(spark, sf_dir, name: str, content: str):
    """One file for each part, in a folder of its own."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(filled(f"mKEY/{name}", key).alias("path"), filled(content, key, size).alias("content"))


def _manifest(name: str, ecosystem: str, file: str, content: str, *found: tuple[str, bool]) -> None:
    rows = [
        f"SELECT '{ecosystem}' AS ecosystem, {filled_sql(n, 'p_partkey')} AS name, {filled_sql(f'SIZE.{i + 1}.0', 'p_partkey', 'p_size')} AS version, {filled_sql(f'mKEY/{file}', 'p_partkey')} AS source_file, {dev} AS is_dev FROM part"
        for i, (n, dev) in enumerate(found)
    ]

    @query(name, " UNION ALL ".join(rows))
    def read(spark, sf_dir):
        return manifests.inventory(files_of_parts(spark, sf_dir, file, content))


for _row in MANIFESTS:
    _manifest(*_row)


@query("q031_discover_packages", "SELECT 'pypi' AS ecosystem, 'My_a' || p_partkey AS name, p_size || '.1.0' AS version, 'm' || p_partkey || '/requirements.txt' AS source_file, false AS is_dev FROM part")
def discover_packages(spark, sf_dir):
    """Spellings of one package are one dependency."""
    return manifests.inventory(files_of_parts(spark, sf_dir, "requirements.txt", "my-aKEY==SIZE.1.0\nMy_aKEY==SIZE.1.0\nmy.aKEY==SIZE.1.0\n"))


#: Query, reader, report, and the hits in it: rule, severity, message, path, first and last line.
REPORTS = [
    ("q059_semgrep", scanners.semgrep, '{"results":[{"check_id":"r.KEY","path":"./src/fKEY.py","start":{"line":SIZE},"end":{"line":77},"extra":{"message":"m KEY","severity":"WARNING","lines":"x"}},{"check_id":"r2","path":"b.py","start":{"line":1},"end":{"line":2},"extra":{"message":"n","severity":"ODD"}}]}', ("r.KEY", "medium", "m KEY", "src/fKEY.py", "SIZE", "77"), ("r2", "low", "n", "b.py", "1", "2")),
    ("q060_bandit", scanners.bandit, '{"results":[{"test_id":"B1","issue_severity":"HIGH","issue_text":"t KEY","filename":"./aKEY.py","line_number":SIZE,"line_range":[SIZE,99],"code":"c","issue_confidence":"LOW"}]}', ("B1", "high", "t KEY", "aKEY.py", "SIZE", "99")),
    ("q061_eslint", scanners.eslint, '[{"filePath":"src/aKEY.js","messages":[{"ruleId":"no-eval","severity":2,"message":"m KEY","line":SIZE,"endLine":88},{"ruleId":null,"severity":0,"message":"p","line":1,"endLine":1}]}]', ("no-eval", "high", "m KEY", "src/aKEY.js", "SIZE", "88"), ("parse-error", "info", "p", "src/aKEY.js", "1", "1")),
    ("q062_sarif", scanners.sarif, '{"runs":[{"results":[{"ruleId":"q/KEY","level":"note","message":{"text":"m KEY"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"file:///src/aKEY.js"},"region":{"startLine":SIZE,"endLine":66}}}],"properties":{"security-severity":"7.5"}}]}]}', ("codeql/q/KEY", "high", "m KEY", "src/aKEY.js", "SIZE", "66")),
]


def _report(name: str, reader, report: str, *hits: tuple[str, ...]) -> None:
    of = lambda t: filled_sql(t, "p_partkey", "p_size")
    rows = [f"SELECT {of(r)} AS rule_id, '{s}' AS severity, {of(m)} AS message, {of(p)} AS file_path, {of(a)}::INT AS start_line, {of(b)}::INT AS end_line FROM part" for r, s, m, p, a, b in hits]

    @query(name, " UNION ALL ".join(rows))
    def read(spark, sf_dir):
        reports = table(spark, sf_dir, "part").select(filled(report, F.col("p_partkey"), F.col("p_size")).alias("report"))
        return reader(reports).select("rule_id", "severity", "message", "file_path", "start_line", "end_line")


for _row in REPORTS:
    _report(*_row)


@query("q063_sarif_dedupe", "SELECT 'codeql/q' AS rule_id, 'm ' || min(p_partkey) AS message, p_size AS start_line, list_sort(list_distinct(list('external/cwe/cwe-' || p_partkey % 5))) AS cwes FROM part GROUP BY p_size")
def sarif_dedupe(spark, sf_dir):
    """Results of one fingerprint are one hit: the first one's message, all weaknesses."""
    report = '{"runs":[{"results":[{"ruleId":"q","message":{"text":"m KEY"},"fingerprints":{"p":"SIZE"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a.js"},"region":{"startLine":SIZE}}}],"properties":{"tags":["external/cwe/cwe-MOD"]}}]}]}'
    whole = F.replace(filled(report, F.col("p_partkey"), F.col("p_size")), F.lit("MOD"), (F.col("p_partkey") % 5).cast("string"))
    hits = scanners.sarif(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), whole.alias("report")))
    return scanners.dedupe(hits).select("rule_id", "message", "start_line", "cwes")


#: Query, language, importing file, module, the file that has it; confidence if it is there, and if
#: not, and whether the module then counts as external.
IMPORTS = [
    ("q128_python_imports", "python", "a/b.py", "pkg.modKEY", "pkg/modKEY.py", 1.0, 0.0, True),
    ("q129_relative_imports", "python", "pkg/sub/x.py", "..modKEY", "pkg/modKEY.py", 1.0, 0.3, False),
    ("q130_script_imports", "javascript", "web/a/x.js", "../modKEY", "web/modKEY.ts", 1.0, 0.2, False),
    ("q131_java_imports", "java", "A.java", "com.acme.ModKEY", "src/main/java/com/acme/ModKEY.java", 0.9, 0.0, True),
    ("q132_kotlin_imports", "kotlin", "A.kt", "com.acme.ModKEY", "src/com/acme/ModKEY.kt", 0.9, 0.0, True),
    ("q133_go_imports", "go", "a.go", "github.com/x/y/modKEY", "internal/modKEY", 0.7, 0.0, True),
    ("q134_ruby_imports", "ruby", "a.rb", "modKEY", "lib/modKEY.rb", 0.6, 0.0, True),
    ("q136_rust_imports", "rust", "src/a.rs", "crate::net::modKEY", "src/net/modKEY.rs", 0.9, 0.0, True),
    ("q137_named_imports", "swift", "a.swift", "App.modKEY", "x/modKEY.go", 0.4, 0.0, True),
    ("q135_php_imports", "php", "a.php", "App\\ModKEY", "lib/App/ModKEY.php", 0.8, 0.0, True),
]


def _imports(name: str, language: str, source: str, module: str, path: str, there: float, missing: float, external: bool) -> None:
    found = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)"

    @query(name, f"SELECT o_orderkey AS id, CASE WHEN {found} THEN {filled_sql(path, 'o_custkey')} END AS resolved_path, (CASE WHEN {found} THEN {there} ELSE {missing} END)::DOUBLE AS confidence, {external} AND NOT {found} AS is_external FROM orders")
    def resolve(spark, sf_dir):
        imports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(source).alias("source_file"), filled(module, F.col("o_custkey")).alias("module"), F.lit(language).alias("language"))
        file = path + "/x.go" if language == "go" else path
        here = F.when(F.col("c_custkey") % 2 == 0, filled(file, F.col("c_custkey"))).otherwise(filled("other/KEY.txt", F.col("c_custkey")))
        return joins.resolve_imports(imports, table(spark, sf_dir, "customer").select(here.alias("path")))


for _row in IMPORTS:
    _imports(*_row)


@query(
    "q126_resolve_calls",
    """
SELECT o_orderkey AS line, 'f' || b || '.py' AS callee_file, CASE WHEN a = b THEN 'direct' WHEN a = c THEN 'import' ELSE 'heuristic' END AS resolution, (CASE WHEN a = b THEN 1.0 WHEN a = c THEN 0.9 ELSE 0.3 END)::DOUBLE AS confidence
FROM (SELECT o_orderkey, o_orderkey % 97 AS a, c_custkey % 97 AS b, (c_custkey + 1) % 97 AS c FROM orders JOIN customer ON o_custkey = c_custkey)""",
)
def resolve_calls(spark, sf_dir):
    """Calls of functions in the same file, imported, or known by a name that only one file has."""
    file = lambda c: F.concat(F.lit("f"), (c % 97).cast("string"), F.lit(".py"))
    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer")
    calls = table(spark, sf_dir, "orders").select(file(F.col("o_orderkey")).alias("caller_file"), F.lit(None).cast("string").alias("enclosing"), filled("fnKEY", F.col("o_custkey")).alias("callee_name"), F.lit(None).cast("string").alias("callee_object"), F.col("o_orderkey").alias("line"))
    symbols = people.select(file(k).alias("file"), filled("fnKEY", k).alias("name"), F.lit("function").alias("kind"))
    imports = people.select(file(k + 1).alias("file"), filled("fnKEY", k).alias("name"), file(k).alias("target"))
    return graph.resolve_calls(calls, symbols, imports).select(F.col("caller_line").alias("line"), "callee_file", "resolution", "confidence")


@query(
    "q144_link_by_content",
    r"""
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) > 15 AND NOT regexp_matches(x, '^(#|//|/\*|\*)')) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT c, min(doc_id) AS file_id FROM (SELECT doc_id, unnest(ls) AS c FROM d) GROUP BY c)
SELECT doc_id AS finding_id, file_id FROM d JOIN l ON ls[1] = c""",
)
def link_by_content(spark, sf_dir):
    """Each text's first telling line to the first text that has that line."""
    docs = table(spark, sf_dir, "documents")
    return joins.link_by_content(docs.select(F.col("doc_id").alias("finding_id"), F.col("text").alias("code_snippet")), docs.select(F.col("doc_id").alias("file_id"), F.col("text").alias("content")))


@query("q148_transitive_only", f"WITH d AS (SELECT id, ecosystem, {NORMAL_SQL} AS k FROM {sql(DEPENDENCIES)}) SELECT id FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE a.ecosystem = b.ecosystem AND a.k = b.k AND a.id % 3 = (b.id + b.id % 2) % 3)")
def transitive_only(spark, sf_dir):
    """Locked packages that no manifest beside the lockfile declares."""
    deps = frame(spark, sf_dir, DEPENDENCIES)
    at = lambda c, name: F.concat(F.lit("m"), (c % 3).cast("string"), F.lit("/" + name))
    locked = deps.withColumn("source_file", at(F.col("id"), "package-lock.json"))
    return joins.transitive_only(locked, deps.withColumn("source_file", at(F.col("id") + F.col("id") % 2, "package.json"))).select("id")


@query("q201_ranges_overlap", f"SELECT finding_id, start_line <= scan_id % 190 + 4 AND scan_id % 190 + 1 <= end_line AS overlaps FROM {sql(FINDINGS)}")
def ranges_overlap(spark, sf_dir):
    """Does a finding's range of lines touch that of its scan?"""
    at = F.col("scan_id") % 190
    return frame(spark, sf_dir, FINDINGS).select("finding_id", text.ranges_overlap(F.col("start_line"), F.col("end_line"), at + 1, at + 4).alias("overlaps"))


_SAID = "lower(concat('rule/', cast(scan_id % 3 as string), ' ', title, ' uses sql and a weak cipher or a cookie'))"


@query("q257_category_matches", f"SELECT finding_id, CASE lower(category) {' '.join('WHEN ' + repr(k) + ' THEN ' + ' OR '.join(f'contains({_SAID}, {w!r})' for w in v) for k, v in fixed.CATEGORY_WORDS.items())} ELSE false END AS matches FROM {sql(FINDINGS)}")
def category_matches(spark, sf_dir):
    """Does a hit's text speak of the finding's category?"""
    rule = F.concat(F.lit("rule/"), (F.col("scan_id") % 3).cast("string"))
    said = F.concat(F.col("title"), F.lit(" uses sql and a weak cipher or a cookie"))
    return frame(spark, sf_dir, FINDINGS).select("finding_id", text.category_matches(F.col("category"), rule, said, F.lit("")).alias("matches"))


@query("q199_union_ignoring_case", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN ['A'] ELSE ['A', l_returnflag] END AS names FROM lineitem")
def union_ignoring_case(spark, sf_dir):
    """The first spelling of each name, in order."""
    r = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.union_ignoring_case(F.array(F.lit(" A"), F.lit("a"), F.lit(""), r, F.lower(r))).alias("names"))


@query("q301_symbol_tokens", "SELECT p_partkey, list_sort(['foo.bar::baz' || p_partkey, 'foo.bar.baz' || p_partkey, 'foo', 'bar', 'baz' || p_partkey]) AS tokens FROM part")
def symbol_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(text.symbol_tokens(filled("`Foo.Bar::bazKEY(x, y)`", F.col("p_partkey")))).alias("tokens"))


@query("q122_import_match", "SELECT s_suppkey AS id, o_orderkey AS line, 0.95::DOUBLE AS confidence, 'import' AS kind FROM orders JOIN supplier ON s_suppkey = o_custkey % 200")
def import_match(spark, sf_dir):
    """External imports with the packages that they mean."""
    packages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), filled("PkgKEY", F.col("s_suppkey")).alias("name"), F.lit("npm").alias("ecosystem"))
    imports = table(spark, sf_dir, "orders").select(F.lit("a.js").alias("source_file"), filled("pkgKEY/sub", F.col("o_custkey") % 200).alias("import_module"), F.col("o_orderkey").alias("line"), F.lit(True).alias("is_external"))
    return joins.imports_of_packages(packages, imports).select("id", "line", "confidence", "kind")


@query("q215_files_importing", "SELECT 'f' || o_orderkey % 100 AS source_file, min(o_orderkey) AS line FROM orders WHERE contains('app.mod' || o_custkey, 'mod7') GROUP BY 1 ORDER BY 1 LIMIT 30")
def files_importing(spark, sf_dir):
    imports = table(spark, sf_dir, "orders").select(filled("fKEY", F.col("o_orderkey") % 100).alias("source_file"), F.col("o_orderkey").alias("line"), filled("app.ModKEY", F.col("o_custkey")).alias("import_module"), F.lit(None).cast("string").alias("resolved_path"))
    return planning.files_importing(imports, "mod7").select("source_file", "line")


@query("q295_dependency_boosts", "SELECT 'f' || l_suppkey AS file_path, sum(CASE WHEN l_returnflag = 'R' THEN 6 ELSE 4 END)::DOUBLE AS boost, count(*) AS n FROM lineitem GROUP BY 1")
def dependency_boosts(spark, sf_dir):
    evidence = table(spark, sf_dir, "lineitem").select(filled("fKEY", F.col("l_suppkey")).alias("file"), F.when(F.col("l_returnflag") == "R", "vulnerable_function").otherwise("import").alias("kind"))
    return planning.dependency_boosts(evidence).groupBy("file_path").agg(F.sum("boost").alias("boost"), F.count("*").alias("n"))


@query("q296_finding_boosts", "SELECT file_path, sum(boost)::DOUBLE AS boost FROM (SELECT 'src/f' || l_suppkey || '.py' AS file_path, 5 AS boost FROM lineitem UNION ALL SELECT 'lib/g' || l_linenumber || '.js', 3 FROM lineitem) GROUP BY 1")
def finding_boosts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(filled("src/fKEY.py", F.col("l_suppkey")).alias("file_path"), F.array(filled("body of a request (lib/gKEY.js), unchecked", F.col("l_linenumber"))).alias("input_sources"))
    return planning.finding_boosts(rows).groupBy("file_path").agg(F.sum("boost").alias("boost"))


@query(
    "q119_vulnerable_calls",
    """
WITH h AS (SELECT o_orderkey % 50 AS f, s_suppkey AS s, min(o_orderkey) AS line FROM orders JOIN supplier ON o_custkey = s_suppkey GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN f <> s % 50 THEN 'weak' WHEN s % 2 = 0 THEN 'strong' ELSE 'medium' END AS evidence_strength, CASE WHEN f <> s % 50 THEN 1 WHEN s % 2 = 0 THEN 3 ELSE 2 END AS k FROM h)
SELECT 'f' || f AS file, 'A' || lpad(s::VARCHAR, 8, '0') AS advisory_id, line, evidence_strength FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY k DESC, line, s) AS r FROM g) WHERE r <= 10""",
)
def vulnerable_calls(spark, sf_dir):
    """Calls of functions that advisories name, the ten best of each file."""
    s, people = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    advisories = people.select(F.concat(F.lit("A"), F.lpad(s.cast("string"), 8, "0")).alias("id"), filled("pkgKEY", s).alias("package"), F.lit("npm").alias("ecosystem"), F.lit("high").alias("severity"), F.array(filled("Lib.fnKEY(x)", s)).alias("vulnerable_functions"))
    # the qualifier is a key as well, but nothing calls it
    calls = table(spark, sf_dir, "orders").select(filled("fKEY", F.col("o_orderkey") % 50).alias("file"), filled("FnKEY", F.col("o_custkey")).alias("function"), F.col("o_orderkey").alias("line"))
    imports = people.select(filled("fKEY", s % 50).alias("source_file"), filled("pkgKEY", s).alias("import_module"), F.lit(True).alias("is_external"))
    dependencies = people.select(F.when(s % 2 == 0, filled("pkgKEY", s)).otherwise(filled("otherKEY", s)).alias("name"), F.lit("npm").alias("ecosystem"))
    return joins.vulnerable_calls(calls, joins.function_index(advisories), imports, dependencies).select("file", "advisory_id", "line", "evidence_strength")


@query("q189_merge_advisories", "SELECT l_orderkey AS finding_id, 'A' || l_suppkey % 5 AS display_id, list_sort(list_distinct(list(l_returnflag))) AS evidence_types FROM lineitem GROUP BY 1, 2")
def merge_advisories(spark, sf_dir):
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), filled("AKEY", F.col("l_suppkey") % 5).alias("display_id"), F.when(flag == "A", "strong").otherwise("weak").alias("evidence_strength"), F.lit(0.5).alias("package_match_confidence"), F.lit("high").alias("severity"), flag.alias("evidence_type"), F.lit("lockfile").alias("package_evidence_source"), F.lit("f").alias("function"), F.col("l_linenumber").alias("line"))
    return findings.merge_advisories(rows, ["finding_id"]).select("finding_id", "display_id", "evidence_types")


OSV_RECORD = '{"id":"X-KEY","aliases":["CVE-KEY"],"summary":"s","severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}],"database_specific":{"severity":"LOW","cwe_ids":["CWE-79"]},"affected":[{"package":{"ecosystem":"npm","name":"pKEY"},"ranges":[{"type":"SEMVER","events":[{"introduced":"0"},{"fixed":"SIZE.0.0"}]},{"type":"GIT","events":[{"introduced":"abc"}]}]},{"package":{"ecosystem":"npm","name":"pKEY"},"ranges":[{"type":"SEMVER","events":[{"introduced":"90.0.0"},{"last_affected":"91.0.0"}]}]},{"package":{"ecosystem":"PyPI","name":"q"},"versions":["1.0"]}]}'


@query("q016_convert_osv", "SELECT 'X-' || p_partkey AS id, 'npm' AS ecosystem, 'p' || p_partkey AS package, 'critical' AS severity, 9.8::DOUBLE AS cvss_score, '>=0,<' || p_size || '.0.0 || >=90.0.0,<=91.0.0' AS affected_range, p_size || '.0.0' AS fixed_version FROM part UNION ALL SELECT 'X-' || p_partkey, 'pypi', 'q', 'critical', 9.8, '', NULL FROM part")
def convert_osv(spark, sf_dir):
    """One advisory for each record and package."""
    records = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(F.from_json(filled(OSV_RECORD, F.col("p_partkey"), F.col("p_size")), advisories.OSV).alias("r")).select("r.*")
    return advisories.from_osv(records).select("id", "ecosystem", "package", "severity", "cvss_score", "affected_range", "fixed_version")


ANDROID_MANIFEST = '<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="p.KEY"><uses-permission android:name="CAMERA"/><application android:debuggable="true"><activity android:name=".AKEY" android:exported="true"/><service android:name=".S"/></application></manifest>'


@query("q012_android_manifest", "SELECT 'm' || p_partkey || '/AndroidManifest.xml' AS path, unnest(['package', 'permission', 'flag', 'exported']) AS kind, unnest(['p.' || p_partkey, 'CAMERA', 'debuggable', '.A' || p_partkey]) AS name, unnest([NULL, NULL, 'true', 'activity']) AS detail FROM part")
def android_manifest(spark, sf_dir):
    return structure.android(files_of_parts(spark, sf_dir, "AndroidManifest.xml", ANDROID_MANIFEST))


@query("q242_python_structure", "SELECT 'm' || p_partkey || '/a.py' AS path, unnest(['import', 'function', 'call']) AS kind, unnest(['os', 'f' || p_partkey, 'system']) AS name, unnest([NULL, NULL, 'f' || p_partkey]) AS owner, unnest([1, 3, 4])::INT AS line FROM part")
def python_structure(spark, sf_dir):
    files = files_of_parts(spark, sf_dir, "a.py", "import os\n\ndef fKEY(a):\n    return os.system(a)\n")
    return structure.facts(files.withColumn("language", F.lit("python"))).select("path", "kind", "name", "owner", "line")


@query("q250_security_tags", "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '({p})', 'i') THEN '{t}' END" for t, p in structure.TAGS.items()) + "], lambda x: x IS NOT NULL) AS tags FROM documents WHERE text IS NOT NULL")
def security_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", structure.tags(F.col("text")).alias("tags"))


@query("q236_labelled_lines", "WITH l AS (SELECT doc_id, content, line::INT AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)), h AS (SELECT 'licence' AS type, * FROM l WHERE regexp_matches(content, 'licen[sc]e', 'i') UNION ALL SELECT 'assigned', * FROM l WHERE regexp_matches(content, '(token|password)\\s*=', 'i')) SELECT type, 'd' || lpad(doc_id::VARCHAR, 9, '0') || '.java' AS path, line FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY doc_id, line) AS r FROM h) WHERE r <= 10")
def labelled_lines(spark, sf_dir):
    """The first lines of each labelled pattern."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".java")).alias("path"), F.col("text").alias("content"))
    return patterns.labelled(files, [("licence", "licen[sc]e"), ("assigned", r"(token|password)\s*=")], ["java"], 10).select("type", "path", "line")


@query("q019_rule_counts", "SELECT 'm' || p_partkey || '/r.yaml' AS path, 1 + p_partkey % 2 AS rules FROM part")
def rule_counts(spark, sf_dir):
    """Rules of each file that are not known to fail."""
    files = files_of_parts(spark, sf_dir, "r.yaml", "rules:\n- id: a\n  languages: [python]\n  message: m\n- id: b\n  languages: [go]\n")
    key = F.col("p_partkey")
    bad = table(spark, sf_dir, "part").select(filled("mKEY/r.yaml", key).alias("path"), F.when(key % 2 == 0, "b").otherwise("none").alias("id"))
    return rules.counts(rules.without(rules.read(files), bad))


@query("q167_languages", "SELECT " + "CASE lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in repo.LANGUAGES.items()) + f" END AS language, count(*) AS n FROM {sql(FILES)} GROUP BY 1 HAVING language IS NOT NULL")
def languages(spark, sf_dir):
    return repo.languages(frame(spark, sf_dir, FILES).withColumn("language", lookup(paths.extension(F.col("path")), repo.LANGUAGES)))


@query("q011_workspaces", "SELECT CASE p_partkey % 3 WHEN 0 THEN 'apps/a' WHEN 1 THEN 'py/a' ELSE 'cmd/a' END || p_partkey AS path, CASE p_partkey % 3 WHEN 0 THEN 'convention' WHEN 1 THEN 'python' ELSE 'go' END AS kind FROM part")
def workspaces(spark, sf_dir):
    key = F.col("p_partkey")
    path = F.when(key % 3 == 0, filled("apps/aKEY/package.json", key)).when(key % 3 == 1, filled("py/aKEY/pyproject.toml", key)).otherwise(filled("cmd/aKEY/go.mod", key))
    return repo.workspaces(table(spark, sf_dir, "part").select(path.alias("path")))


@query("q064_hit_paths", "SELECT o_orderkey AS hit_id, CASE WHEN o_orderkey % 3 = 2 OR c_custkey IS NULL THEN 'gone/x.py' ELSE 'src/d' || c_custkey || '/f' || c_custkey || '.py' END AS path FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def hit_paths(spark, sf_dir):
    """Raw paths of hits: as they stand, by the only file of that name, or left as they are."""
    key = F.col("o_custkey")
    raw = F.when(F.col("o_orderkey") % 3 == 0, filled("./src/dKEY/fKEY.py", key)).when(F.col("o_orderkey") % 3 == 1, filled("file:///builds/1/src/dKEY/fKEY.py", key)).otherwise("gone/x.py")
    files = table(spark, sf_dir, "customer").select(filled("src/dKEY/fKEY.py", F.col("c_custkey")).alias("path"))
    return joins.unique_basename(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hit_id"), raw.alias("raw")), files)
