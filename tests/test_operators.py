from pyspark.sql import functions as F

from riskweave.operators import findings, graph, joins, rollups
from riskweave.sources import structure


def test_greedy_merge(spark):
    rows = [
        ("1", "SQL injection in login", "sqli", "critical", "./api/auth.py", "44-46", "h", 0.82, "scanner", ["CWE-89"], ["execute"], [], ["semgrep"], ["r1"]),
        ("2", "Unsafe query", "SQLi ", "high", "api\\auth.py", "45-45", "longer", 0.91, "llm", None, ["Execute", "run"], None, ["eslint"], None),
        ("3", "Other", "sqli", "low", "api/auth.py", "400", None, 0.5, "llm", None, None, None, None, None),
        ("4", "Other", "xss", "low", "api/auth.py", "400", None, 0.5, "llm", None, None, None, None, None),
    ]
    got = {r.finding_id: r for r in findings.greedy_merge(spark.createDataFrame(rows, findings.MERGE_SCHEMA)).collect()}
    assert set(got) == {"1", "3", "4"}
    m = got["1"]
    assert (m.severity, m.confidence, m.provenance, m.merged_count, m.hypothesis, m.merged_ids) == ("critical", 0.91, "hybrid", 2, "longer", ["1", "2"])
    assert list(m.source_scanners) == ["semgrep", "eslint"] and list(m.sinks) == ["execute", "run"]


def test_related_advisories(spark):
    schema = "finding_id int, display_id string, cve_id string, package string, severity string, evidence_type string, evidence_strength string, package_evidence_source string, package_match_confidence double, function string, line int"
    rows = [(1, "CVE-1", None, "p", "high", "contextual", "contextual", "cwe_correlation", None, None, None), (1, "CVE-1", "CVE-1", "p", "high", "call", "strong", "import_graph", 0.9, "load", 42), (1, "CVE-2", None, "q", "low", "x", "weak", "z", None, None, None)]
    got = findings.merge_advisories(spark.createDataFrame(rows, schema), ["finding_id"]).collect()
    one = next(r for r in got if r.display_id == "CVE-1")
    assert len(got) == 2 and one.evidence_strength == "strong" and one.evidence_sources == ["cwe_correlation", "import_graph"] and (one.function, one.line) == ("load", 42)


def test_call_graph(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("a", "c2", 3), ("c2", "d", 4), ("c", "d", 5), ("d", "a", 6), ("r", "a", 7), ("d", "e", 8), ("e", "f", 9), ("f", "g", 10), ("g", "h", 11)], "caller string, callee string, edge_id long")
    pairs = spark.createDataFrame([("a", "a"), ("a", "d"), ("a", "h"), ("h", "a"), ("r", "h"), ("b", "a")], "source string, target string")
    got = {(r.source, r.target): (r.hops, r.path) for r in graph.find_path(edges, pairs).collect()}
    assert got[("a", "a")] == (0, ["a"]) and got[("a", "d")] == (2, ["a", "c2", "d"]) or got[("a", "d")] == (2, ["a", "b", "d"])
    assert got[("a", "h")][0] == 6 and ("h", "a") not in got and ("r", "h") not in got and got[("b", "a")][0] == 3
    entries = graph.entry_points(edges, spark.createDataFrame([("d",), ("r",)], "node string")).collect()
    assert [(e.target, e.entry, e.path) for e in entries] == [("d", "r", ["r", "a", "c2", "d"])]
    flows = spark.createDataFrame([(1, "x.py", 5, "y.py", 9), (2, "y.py", 9, "x.py", 5)], "flow_id int, source_file string, source_line int, sink_file string, sink_line int")
    symbols = spark.createDataFrame([("x.py", "f", 1, 20), ("x.py", "g", 4, 6), ("y.py", "h", 8, 10)], "file string, name string, start_line int, end_line int")
    calls = spark.createDataFrame([("x.py::g", "m", 1), ("m", "y.py::h", 2)], "caller string, callee string, edge_id long")
    got = {r.flow_id: (r.graph_verified, r.chain) for r in graph.verify_flows(flows, calls, symbols).collect()}
    assert got == {1: (True, ["x.py::g", "m", "y.py::h"]), 2: (False, None)}


def test_call_resolution_from_source(spark):
    files = spark.createDataFrame([
        ("a.py", "python", "import b as bb\nfrom c import run\n\ndef main():\n    helper()\n    bb.load()\n    run()\n    only()\n    unknown()\n\ndef helper():\n    pass\n"),
        ("b.py", "python", "def load():\n    pass\n"), ("c.py", "python", "def go():\n    pass\n"), ("d.py", "python", "def only():\n    pass\n"),
    ], "path string, language string, content string")
    f = structure.facts(files).cache()
    calls = f.where("kind = 'call'").select(F.col("path").alias("caller_file"), F.col("owner").alias("enclosing"), F.col("name").alias("callee_name"), F.col("detail").alias("callee_object"), "line")
    symbols = f.where("kind in ('function', 'method', 'class')").select(F.col("path").alias("file"), "name", "kind")
    imports = f.where("kind = 'import'").select("path", F.concat("name", F.lit(".py")).alias("target"), "detail").select(F.col("path").alias("file"), F.col("detail").alias("name"), "target")
    got = {r.callee_symbol: (r.caller_symbol, r.callee_file, r.resolution, r.confidence) for r in graph.resolve_calls(calls, symbols, imports).collect()}
    assert got == {"helper": ("main", "a.py", "direct", 1.0), "load": ("main", "b.py", "method", 0.7), "run": ("main", "c.py", "import", 0.5), "only": ("main", "d.py", "heuristic", 0.3)}


def test_structure_of_other_languages(spark):
    js = "import {a, b as c} from './x'\nconst y = require('lib/y')\nexport function f(q) {\n  y.run(q)\n}\nconst g = async (z) => f(z)\nclass K {}\napp.get('/api/users', g)\n"
    php = "<?php\nuse App\\Models\\User;\nfunction show($id) {\n  $db->query($id);\n}\nRoute::post('/x', 'y');\n"
    files = [("a.js", "javascript", js), ("b.php", "php", php), ("C.java", "java", "import java.util.List;\npublic class C {\n  public int run(int a) {\n    return help(a);\n  }\n}\n"), ("bad.py", "python", "def ("), ("n.py", "python", None)]
    got = {(r.path, r.kind, r.name, r.detail) for r in structure.facts(spark.createDataFrame(files, "path string, language string, content string")).collect()}
    assert {("a.js", "import", "./x", "a"), ("a.js", "import", "lib/y", "y"), ("a.js", "function", "f", None), ("a.js", "function", "g", None), ("a.js", "class", "K", None), ("a.js", "route", "/api/users", "GET"), ("a.js", "call", "run", "y")} <= got
    assert {("b.php", "import", "App\\Models\\User", "User"), ("b.php", "function", "show", None), ("b.php", "call", "query", "$db"), ("b.php", "route", "/x", "POST")} <= got
    assert {("C.java", "import", "java.util.List", "List"), ("C.java", "class", "C", None), ("C.java", "function", "run", None), ("C.java", "call", "help", None)} <= got
    assert spark.createDataFrame([("def authenticate(request.args)",)], "t string").select(structure.tags(F.col("t"))).first()[0] == ["auth", "network", "input_handling"]
    manifest = '<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="p"><uses-permission android:name="CAMERA"/><application android:debuggable="true"><activity android:name=".A"><intent-filter/></activity><service android:name=".S" android:exported="false"><intent-filter/></service></application></manifest>'
    assert {(r.kind, r.name, r.detail) for r in structure.android(spark.createDataFrame([("m", manifest), ("n", "<")], "path string, content string")).collect()} == {("package", "p", None), ("permission", "CAMERA", None), ("flag", "debuggable", "true"), ("exported", ".A", "activity")}


def test_dependency_usage(spark):
    deps = spark.createDataFrame([(1, False, False), (2, False, False), (3, True, False), (4, False, True), (5, False, False), (6, False, False)], "id int, is_dev boolean, transitive boolean")
    hits = spark.createDataFrame([(1, "src/a.py", "import", "x"), (2, "src/a.py", "reference", "x"), (3, "tests/a.py", "import", "x"), (5, "test_a.py", "import", "x"), (1, "src/a.py", "vulnerable_function", "f")], "id int, file string, kind string, symbol string")
    got = {r.id: (r.relevance, r.function_hit) for r in joins.usage(deps, hits).collect()}
    assert got == {1: ("used", True), 2: ("likely_used", False), 3: ("test_only", False), 4: ("transitive_only", False), 5: ("test_only", False), 6: ("unknown", False)}
    locked = spark.createDataFrame([("npm", "A", "app/package-lock.json"), ("npm", "b", "app/package-lock.json")], "ecosystem string, name string, source_file string")
    declared = spark.createDataFrame([("npm", "a", "app/package.json"), ("npm", "b", "package.json")], "ecosystem string, name string, source_file string")
    assert [r.name for r in joins.transitive_only(locked, declared).collect()] == ["b"]


def test_vulnerable_calls(spark):
    db = spark.createDataFrame([("GHSA-1", "pyyaml", "pypi", "high", ["yaml.load"]), ("GHSA-2", "other", "pypi", "low", ["load"])], "id string, package string, ecosystem string, severity string, vulnerable_functions array<string>")
    calls = spark.createDataFrame([("a.py", "load", 9), ("a.py", "load", 3), ("b.py", "Load", 1)], "file string, function string, line int")
    imports = spark.createDataFrame([("a.py", "yaml", True), ("b.py", "json", True)], "source_file string, import_module string, is_external boolean")
    deps = spark.createDataFrame([("pypi", "PyYAML")], "ecosystem string, name string")
    index = joins.function_index(db)
    got = {(r.file, r.advisory_id): (r.evidence_strength, r.line) for r in joins.vulnerable_calls(calls, index, imports, deps).collect()}
    assert got == {("a.py", "GHSA-1"): ("strong", 3), ("a.py", "GHSA-2"): ("weak", 3), ("b.py", "GHSA-1"): ("weak", 1), ("b.py", "GHSA-2"): ("weak", 1)}
    nobody = deps.limit(0)
    assert {r.evidence_strength for r in joins.vulnerable_calls(calls, index, imports, nobody).collect()} == {"medium", "weak"}


def test_import_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("app/__init__.py", "app/db.py", "app/api/views.py", "web/util.ts", "web/lib/index.js", "src/com/x/Main.java", "src2/com/x/Main.java", "k/com/y/T.kt", "App/Models/User.php")], "path string")
    cases = [("app.db", "app/api/views.py", "python", "app/db.py", 1.0), ("app", "x.py", "python", "app/__init__.py", 0.9), ("app.db.Session", "x.py", "python", "app/db.py", 0.8), ("os", "x.py", "python", None, 0.0), ("..db", "app/api/views.py", "python", "app/db.py", 1.0), (".nope", "app/api/views.py", "python", None, 0.3), ("./util", "web/a.ts", "typescript", "web/util.ts", 1.0), ("./lib", "web/a.ts", "javascript", "web/lib/index.js", 0.9), ("../web/util", "web/a.ts", "typescript", "web/util.ts", 1.0), ("react", "web/a.ts", "typescript", None, 0.0), ("./gone", "web/a.ts", "typescript", None, 0.2), ("com.x.Main", "A.java", "java", "src/com/x/Main.java", 0.9), ("com.y.T", "A.kt", "kotlin", "k/com/y/T.kt", 0.9), ("App\\Models\\User", "a.php", "php", "App/Models/User.php", 0.8)]
    df = spark.createDataFrame([(i, m, s, lang) for i, (m, s, lang, _, _) in enumerate(cases)], "id int, module string, source_file string, language string")
    got = {r.id: (r.resolved_path, r.confidence) for r in joins.resolve_imports(df, files).collect()}
    assert got == {i: c[3:] for i, c in enumerate(cases)}
    assert {r.id for r in joins.resolve_imports(df, files).where("is_external").collect()} == {3, 9}


def test_links_and_paths(spark):
    found = spark.createDataFrame([(1, "# c\n  cursor.execute(query + x)\n"), (2, "short"), (3, None)], "finding_id int, code_snippet string")
    files = spark.createDataFrame([(20, "def f():\n    cursor.execute(query + x)\n"), (10, "x\n\tcursor.execute(query + x)  ")], "file_id int, content string")
    assert [(r.finding_id, r.file_id) for r in joins.link_by_content(found, files).collect()] == [(1, 10)]
    hits = spark.createDataFrame([(1, "file:///src/a.py"), (2, "/build/x/src/b.py"), (3, "c.py"), (4, "zz/q.py")], "hit_id int, raw string")
    paths = spark.createDataFrame([("src/a.py",), ("src/b.py",), ("m/c.py",), ("n/c.py",)], "path string")
    assert {r.hit_id: r.path for r in joins.unique_basename(hits, paths).collect()} == {1: "src/a.py", 2: "src/b.py", 3: "c.py", 4: "zz/q.py"}


def test_rollups(spark):
    deps = spark.createDataFrame([(1, "npm", "lodash", "4", "p", False), (2, "npm", "lodash", "4", "p", False), (3, "npm", "x", "1", "p", True)], "id int, ecosystem string, name string, version string, source_file string, is_dev boolean")
    vulns = spark.createDataFrame([(1, "A", None), (2, "B", None), (2, "A", "C")], "dependency_id int, advisory_id string, cve_id string")
    s = {r.name: r for r in rollups.sbom(deps, vulns).collect()}
    assert len(s) == 2 and s["lodash"].vulnerability_count == 2 and s["lodash"].vulnerabilities == ["A", "B"] and s["x"].vulnerability_count == 0
    empty = spark.createDataFrame([(1, "high", 0.9, "dismissed", "easy")], "scan_id int, severity string, confidence double, status string, exploit_difficulty string")
    assert [tuple(r) for r in rollups.risk_scores(empty, "scan_id").collect()] == [(1, 0.0, "A")]
    runs = spark.createDataFrame([(True, []), (True, ["e"]), (False, [])], "success boolean, errors array<string>")
    assert [r.status for r in rollups.coverage_status(runs).collect()] == ["completed", "degraded", "failed"]
    new = spark.createDataFrame([(1, None, "m"), (1, None, "m"), (2, 5, "m")], "a int, b int, c string")
    assert [tuple(r) for r in findings.persist_new(spark.createDataFrame([(2, 5, "m")], "a int, b int, c string"), new, ["a", "b", "c"]).collect()] == [(1, None, "m")]
    flows = spark.createDataFrame([("a", 1, "t", "b", 2, "u", False, 0.5, ["x"]), ("a", 1, "t", "b", 2, "u", True, 0.9, [])], "source_file string, source_line int, source_type string, sink_file string, sink_line int, sink_type string, sanitised boolean, confidence double, intermediaries array<string>")
    f = findings.dedupe_flows(flows).collect()
    assert len(f) == 1 and f[0].sanitised and f[0].intermediaries == ["x"]
    c = spark.createDataFrame([(1, 1, "a/x.py", "k"), (1, 2, "a/y.py", "l"), (1, 3, "z.py", "l"), (1, 4, "q.py", "m"), (2, 5, "z.py", "k")], "scan_id long, finding_id long, file_path string, category string")
    assert sorted((r.cluster, r.finding_id) for r in findings.clusters(c).collect()) == [(0, 1), (0, 2)]


def test_imports_of_other_languages(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a/b.rs", "src/net/mod.rs", "net.rs", "lib/x.rb", "lib/sub/y.rb", "com/app/One.java", "pkg/db/q.go", "other/db/q.go", "u/only.py", "two/same.py", "three/same.py", "top.rb")], "path string")
    rows = [
        (1, "src/a/c.rs", "super::lib", "rust"), (2, "src/x/c.rs", "super::a::b", "rust"), (3, "a.rs", "crate::net", "rust"), (4, "lib/z.rb", "./sub/y", "ruby"), (5, "lib/sub/z.rb", "../x", "ruby"), (6, "q.rb", "top", "ruby"),
        (7, "A.java", "com.app.*", "java"), (8, "a.go", "ex.com/m/pkg/db", "go"), (9, "a.go", "ex.com/m/db", "go"), (10, "a.go", "fmt", "go"), (11, "a.swift", "M.only", "swift"), (12, "a.swift", "M.same", "swift"),
    ]
    imports = spark.createDataFrame(rows, "id int, source_file string, module string, language string")
    got = {r.id: (r.resolved_path, r.confidence, r.is_external) for r in joins.resolve_imports(imports, files).collect()}
    assert len(got) == len(rows)
    assert got[1] == got[10] == got[12] == (None, 0.0, True)
    assert got[2] == ("src/a/b.rs", 0.9, False) and got[3] == ("src/net/mod.rs", 0.8, False)
    assert got[4] == ("lib/sub/y.rb", 1.0, False) and got[5] == ("lib/x.rb", 1.0, False) and got[6] == ("top.rb", 0.6, False)
    assert got[7] == ("com/app", 0.7, False) and got[8] == ("pkg/db", 0.7, False) and got[9] == ("other/db", 0.7, False)
    assert got[11] == ("u/only.py", 0.4, False)


def test_clusters_against_brute_force(spark):
    import random

    r = random.Random(4)
    rows = [(r.randrange(3), i, r.choice(["a/x.py", "a/y.py", "b/c/z.py", "b/w.py", "top.py", ""]), r.choice(["auth", "xss", "", None, f"k{i}"])) for i in range(150)]
    want = []
    for scan in range(3):
        free, n = [(i, p, c or "") for s, i, p, c in rows if s == scan], 0
        while free:
            i, path, category = free[0]
            home = path.rsplit("/", 1)[0] if "/" in path else None
            near = [f for f in free[1:] if f[1] == path or f[2] == category or (home and f[1].rsplit("/", 1)[0] == home and "/" in f[1])]
            if near:
                want += [(scan, n, x) for x in (i, *[f[0] for f in near])]
                n += 1
            free = [f for f in free[1:] if f not in near]
    got = findings.clusters(spark.createDataFrame(rows, "scan_id long, finding_id long, file_path string, category string")).collect()
    assert sorted((x.scan_id, x.cluster, x.finding_id) for x in got) == sorted(want)


def test_greedy_merge_against_brute_force(spark):
    import random
    import re

    r = random.Random(7)
    names = [c.split()[0] for c in findings.MERGE_SCHEMA.split(", ")]
    words = ["sql", "query", "input", "user", "unsafe", "call", "path"]
    rows = []
    for i in range(120):
        a = r.randint(1, 300)
        rows.append((f"i{i:03}", " ".join(r.sample(words, 3)), r.choice(["xss", "sqli"]), r.choice(["high", "low", "critical"]), r.choice(["a.py", "./a.py", "b.py"]), r.choice([None, f"{a}", f"{a}-{a + 4}"]), "h" * r.randint(0, 9), round(r.random(), 2), r.choice(["llm", "scanner", None]), r.choice([[], ["CWE-1"], ["cwe-2", "CWE-3"]]), r.choice([[], ["eval"], [f"s{i}"]]), [], [r.choice(["x", "y"])], []))

    def same(p, q):
        p, q = dict(zip(names, p)), dict(zip(names, q))
        span = lambda v: [int(x) for x in re.findall(r"\d+", v or "")]
        x, y = span(p["line_range"]), span(q["line_range"])
        if x and y and x[0] <= y[-1] and y[0] <= x[-1]:
            return True
        if set(p["cwe_ids"]) & set(q["cwe_ids"]) or set(p["sinks"]) & set(q["sinks"]):
            return True
        u, v = set(p["title"].split()), set(q["title"].split())
        return len(u & v) / len(u | v) >= 0.55

    order = sorted(rows, key=lambda x: (-{"critical": 5, "high": 4, "low": 2}[x[3]], -x[7], x[1], x[0]))
    kept = []
    for x in order:
        home = lambda y: (y[4].lstrip("./"), y[2])
        into = next((k for k in kept if home(k[0]) == home(x) and same(k[2], x)), None)
        if into is None:
            kept.append([x, [x[0]], list(x)])
        else:
            into[1].append(x[0])
            for k in ("cwe_ids", "sinks"):
                at = names.index(k)
                into[2][at] = into[2][at] + [v for v in x[at] if v.lower() not in {w.lower() for w in into[2][at]}]
    got = {g.finding_id: list(g.merged_ids) for g in findings.greedy_merge(spark.createDataFrame(rows, findings.MERGE_SCHEMA)).collect()}
    assert got == {k[0][0]: k[1] for k in kept}


def test_merge_by_key_is_whole_and_stable(spark):
    rows = [(2, "k", "high", "Beta", 0.5, "llm", "long text"), (1, "k", "high", "Alpha", 0.5, " Scanner", "short"), (3, "k", "low", "beta ", 0.9, None, None), (4, "q", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "finding_id long, canonical_key string, severity string, title string, confidence double, provenance string, hypothesis string")
    for n in (1, 5):
        got = {x.canonical_key: x for x in findings.merge_by_key(df.repartition(n), ["canonical_key"]).collect()}
        x = got["k"]
        assert (x.severity, x.title, x.confidence, x.hypothesis, x.merged_count, x.provenance) == ("high", "Alpha", 0.9, "long text", 2, "hybrid")
        assert (got["q"].merged_count, got["q"].provenance) == (0, "llm")


def test_reads_on_empty_tables_and_nulls(spark):
    from riskweave.operators import reads

    found = spark.createDataFrame([(1, None, None, None)], "finding_id long, title string, description string, code_snippet string")
    links = spark.createDataFrame([], "finding_id long, file_id long")
    files = spark.createDataFrame([(7, None)], "file_id long, path string")
    assert reads.findings_of_file(found, links, files, "a.py").count() == 0
    assert reads.with_paths(found, links, files).first().file_paths == []
    assert reads.by_title(found, spark.createDataFrame([("x",)], "query string")).count() == 0
    deps = spark.createDataFrame([(1, "requests", "pypi", None), (2, "", "pypi", 1.0)], "id long, package string, ecosystem string, risk_score double")
    imports = spark.createDataFrame([("a.py", "requests.api", True), ("b.py", None, True)], "file string, import_module string, is_external boolean")
    texts = spark.createDataFrame([("a.py", None), ("c.py", "x = 1\nfrom requests import get"), ("d.py", ""), ("e.py", None)], "path string, content string")
    got = [(x.file, x.id, x.source) for x in reads.dependencies_of_files(deps, imports, texts).collect()]
    assert sorted(got) == [("a.py", 1, "import_graph"), ("c.py", 1, "text_fallback")]
    assert reads.dependencies_of_files(deps.limit(0), imports, texts).count() == 0


def test_a_table_is_not_written_over_what_it_reads(spark, tmp_path):
    import pytest

    from riskweave import sinks

    path = str(tmp_path / "t")
    sinks.write_report(spark.range(5).toDF("x"), path)
    again = spark.read.parquet(path)
    with pytest.raises(ValueError):
        sinks.write_json(again, path)
    sinks.write_json(again, str(tmp_path / "u"))
    assert spark.read.json(str(tmp_path / "u")).count() == 5 and spark.read.parquet(path).count() == 5


def test_clusters_of_one_hot_scan(spark):
    rows = spark.range(30_000).selectExpr("cast(1 as long) scan_id", "id finding_id", "concat('d', cast(id % 4000 as string), '/f.py') file_path", "concat('c', cast(id % 4001 as string)) category")
    got = findings.clusters(rows).collect()
    pairs = [(x % 4000, x % 4001) for x in range(30_000)]
    homes, kinds, want, n, taken = {}, {}, [], 0, [False] * 30_000
    for i, (h, c) in enumerate(pairs):
        homes.setdefault(h, []).append(i)
        kinds.setdefault(c, []).append(i)
    for i, (h, c) in enumerate(pairs):
        if not taken[i]:
            near = sorted({j for j in homes[h] + kinds[c] if j > i and not taken[j]})
            for j in near:
                taken[j] = True
            if near:
                want += [(1, n, j) for j in (i, *near)]
                n += 1
    assert sorted((x.scan_id, x.cluster, x.finding_id) for x in got) == sorted(want) and n > 1000
    odd = spark.createDataFrame([(None, 1, "a/b", "x"), (1, None, "a/b", "x"), (1, 2, None, None), (1, 3, None, None), (1, 3, None, None)], "scan_id long, finding_id long, file_path string, category string")
    assert sorted((x.cluster, x.finding_id) for x in findings.clusters(odd).collect()) == [(0, 2), (0, 3)]
    assert findings.clusters(odd.limit(0)).count() == 0


def test_greedy_merge_of_a_large_block(spark):
    """Findings of one block, none like another, take no comparison of each with each; values that come by merging count."""
    import time

    rows = [(f"{i}", f"w{i}a w{i}b w{i}c common", "c", "high", "f", f"{i * 10 + 1}-{i * 10 + 2}", "h", 0.5, "llm", [f"C{i}"], [], [], [], []) for i in range(5000)]
    begun = time.perf_counter()
    got = findings.greedy_merge(spark.createDataFrame(rows, findings.MERGE_SCHEMA).repartition(1)).collect()
    assert len(got) == 5000 and time.perf_counter() - begun < 25
    chain = [("1", "t one", "c", "high", "f", "1", None, 0.9, "llm", ["A"], None, None, None, None), ("2", "t two", "c", "high", "f", "1", None, 0.8, None, [" B ", "a"], ["X", None], None, None, None), ("3", "t three", "c", "low", "f", "90", None, 0.7, "scanner", ["B"], None, None, None, None), ("4", "t four", "c", "low", "f", "99", None, float("nan"), "llm", None, ["X"], None, None, None)]
    one = findings.greedy_merge(spark.createDataFrame(chain, findings.MERGE_SCHEMA)).collect()
    assert [(r.finding_id, r.merged_ids, r.cwe_ids, r.sinks, r.provenance) for r in one] == [("1", ["1", "2", "3", "4"], ["A", "B"], ["X"], "hybrid")]


def test_clusters_of_small_scans_take_no_rounds(spark, monkeypatch):
    import random

    r = random.Random(3)
    rows = [(r.choice([1, 2, 3, None]), r.choice([*range(70), None]), r.choice([f"d{r.randrange(9)}/f", "/f", "f", "g", None, f"a/b{r.randrange(9)}/x"]), r.choice([*(f"c{i}" for i in range(20)), "", None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "scan_id long, finding_id long, file_path string, category string")
    cuts, cut = [], findings.cut
    monkeypatch.setattr(findings, "cut", lambda x: cuts.append(1) or cut(x))
    read = lambda x: sorted((y.scan_id, y.cluster, y.finding_id) for y in x.collect())
    whole = read(findings.clusters(df))
    assert len(cuts) == 1 and whole
    monkeypatch.setattr(findings, "WHOLE_SCAN", 95)
    assert read(findings.clusters(df)) == whole and len(cuts) > 1
    monkeypatch.setattr(findings, "WHOLE_SCAN", 0)
    assert read(findings.clusters(df)) == whole


def test_links_by_content_make_no_product(spark):
    texts = spark.range(50).selectExpr("id AS finding_id", "'a line that all of them have' AS code_snippet", "id AS file_id", "'a line that all of them have' AS content")
    got = joins.link_by_content(texts.select("finding_id", "code_snippet"), texts.select("file_id", "content"))
    assert {(r.finding_id, r.file_id) for r in got.collect()} == {(i, 0) for i in range(50)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join ") :]


def test_duplicate_pairs_read_findings_once(spark):
    rows = [(1, 1, "one two three", "5-9", ["A"]), (1, 2, "other title", "9-7", []), (1, 3, "One, two: three!", "40", ["B"]), (1, 4, "more", "x", ["B"]), (2, 5, "one two three", "5", ["A"])]
    df = spark.createDataFrame(rows, "scan_id long, finding_id long, title string, line_range string, cwe_ids array<string>")
    got = findings.duplicate_pairs(df, "scan_id")
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 3), (3, 4)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Join" in line and "split(" in line]
