"""Joins that must not gather a large side in the driver, nor shuffle the product that they are."""

import re

from pyspark.sql import functions as F

from riskweave.functions import packages
from riskweave.operators import joins, products, reads, rollups
from riskweave.sources import structure


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_component_sources_broadcasts_no_names(spark):
    components = spark.range(50).select(F.concat(F.lit("x.A"), F.col("id").cast("string")).alias("component"), F.lit(None).cast("string").alias("package"))
    name = F.when(F.col("id") % 3 == 0, "My").otherwise("other")
    files = spark.range(50).select(F.concat(F.lit("p/"), name, F.lit("A"), F.col("id").cast("string"), F.lit(".java")).alias("path"), F.lit("class Z {}").alias("content"))
    files = files.unionByName(spark.createDataFrame([("p/Q.java", "class A77 extends B {}"), ("p/A7.kt", "")], "path string, content string"))
    got = structure.component_sources(components, files)
    assert "BroadcastHashJoin" not in plan(got)
    rows = {(r.component, r.path) for r in got.collect()}
    assert ("x.A0", "p/MyA0.java") in rows and ("x.A7", "p/otherA7.java") in rows and ("x.A7", "p/A7.kt") in rows and len(rows) == 51


def test_paired(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "id int, k string")
    members = spark.range(2500).select(F.when(F.col("id") < 2400, "a").otherwise("b").alias("k"), F.col("id").alias("m"))
    got = products.paired(rows, members, ["k"], "m")
    assert {(r.id, r.n, r.d) for r in got.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("m").alias("d")).collect()} == {(1, 4800, 2400), (2, 100, 100)}


def test_paired_in_lots(spark, monkeypatch):
    monkeypatch.setattr(products, "LOT", 10)
    monkeypatch.setattr(products, "PRODUCT", 400)
    key = F.when(F.col("id") % 9 < 6, "a").when(F.col("id") % 9 < 7, "b").when(F.col("id") % 9 < 8, "none")
    rows = spark.range(270).select(key.alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") % 60).alias("r"))
    members = spark.range(50).select(F.when(F.col("id") < 35, "a").otherwise("b").alias("k"), (F.col("id") % 2).alias("side"), F.col("id").alias("m"))
    got = products.paired(rows, members, ["k"], "m", "side")
    want = rows.join(members, "k").select("k", "r", "side", "m")
    assert got.columns == want.columns and got.count() == want.count() == 180 * 35 + 30 * 15
    assert not got.exceptAll(want).count() and not want.exceptAll(got).count()
    # as many tasks as the session has, however few bytes there are
    assert products.paired(rows, members, ["k"], "m")._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2


def made_last(df) -> bool:
    """Does the product come about after all that is shuffled?"""
    p = plan(df)
    return "_members" in p and p.index("Generate explode(_members") < p.index("Exchange")


def test_vulnerable_calls_match_modules_once(spark):
    calls = spark.createDataFrame([("a", "Run", 4), ("b", "run", 2)], "file string, function string, line int")
    index = spark.createDataFrame([("run", "A1", "p.q", "npm", "high")], "function string, advisory_id string, package string, ecosystem string, severity string")
    imports = spark.createDataFrame([("a", "p.q/sub", True), ("b", "other", True)], "source_file string, import_module string, is_external boolean")
    got = joins.vulnerable_calls(calls, index, imports, spark.createDataFrame([("p.q", "npm")], "name string, ecosystem string"))
    assert re.search(r"Join \[import_module", plan(got))
    assert {(r.file, r.evidence_strength) for r in got.collect()} == {("a", "strong"), ("b", "weak")}


def test_function_usage_is_made_last(spark):
    symbols = spark.createDataFrame([(1, "lib.load(x)"), (2, "load"), (2, "lib.load")], "id int, symbol string")
    calls = spark.createDataFrame([("f", "Load", "Lib", 1), ("f", "load", None, 1), ("f", "Load", "Lib", 1), ("g", "none", "x", 2)], "file string, function string, object string, line int")
    got = joins.function_usage(symbols, calls)
    assert made_last(got)
    assert sorted((r.id, r.function) for r in got.collect()) == [(1, "Load"), (1, "load"), (2, "Load"), (2, "load")]


def test_import_usage_is_made_last(spark):
    deps = spark.createDataFrame([(1, "Left-Pad", "npm"), (1, "Left-Pad", "npm"), (2, "left-pad", "npm"), (3, "x", "npm")], "id int, name string, ecosystem string")
    imports = spark.createDataFrame([("a.js", "left-pad/x", True, 1), ("b.js", "left-pad/x", True, 1), ("b.js", "left-pad/x", True, 1)], "source_file string, import_module string, is_external boolean, line int")
    got = joins.imports_of_packages(deps, imports)
    assert made_last(got)
    assert sorted((r.id, r.source_file, r.confidence) for r in got.collect()) == [(i, f, 0.95) for i in (1, 2) for f in ("a.js", "b.js")]


def test_import_reach_holds_every_match(spark):
    rows = spark.createDataFrame([("/a", "/a/b"), ("package:fo", "package:foo/x.dart"), ("a", "a.b/c")], "name string, module string")
    got = rows.select(packages.import_match(F.col("name"), F.lit("npm"), F.col("module")).alias("m"), packages.import_reach(F.col("module")).alias("r")).collect()
    assert all(x.m is not None and x.m.alias in x.r for x in got)


def test_entry_points_are_made_last(spark):
    rows = spark.createDataFrame([(1, "src/a/x.py", "h1() h2()", None), (2, "src/b/y.py", "", None), (None, "src/b/z.py", "h2", None)], "finding_id int, file_path string, code_snippet string, hypothesis string")
    entries = spark.createDataFrame([(1, "src/a/in.py", "h1"), (2, "src/a2/in.py", "h2"), (3, "lib/c.py", "h2"), (4, "src/b/q.py", "h2")], "entry_id int, file string, function string")
    got = reads.entry_points_of_findings(rows, entries)
    assert "_members" in plan(got) and not plan(got).split("Union")[0].count("Exchange")
    assert sorted(((r.finding_id or 0), r.entry_id) for r in got.collect()) == [(0, 2), (0, 3), (0, 4), (1, 1), (1, 2), (1, 3), (1, 4), (2, 4)]


def test_audit_is_made_last(spark):
    schema = "id string, ecosystem string, package string, severity string, details string, references array<string>, affected_ranges array<string>, affected_range string, affected_versions array<string>"
    low = spark.createDataFrame([("A", "pypi", "my-pkg", "HIGH", "d", ["u"], None, "<2.0", None), ("A", "pypi", "My_Pkg", "HIGH", "d", ["u"], None, "<2.0", None), ("B", "npm", "my-pkg", None, None, None, None, "<9", None)], schema)
    deps = spark.createDataFrame([(1, "PyPI", "my_pkg", "1.0"), (2, "PyPI", "my_pkg", "1.0"), (3, "PyPI", "my-pkg", "3.0"), (4, "npm", "my-pkg", "1.0")], "id int, ecosystem string, name string, version string")
    got = joins.audit(deps, low.where("package <> 'My_Pkg'"))
    assert made_last(got)
    assert sorted((r.id, r.advisory_id, r.match_type, r.severity) for r in got.collect()) == [(1, "A", "canonical_package_match", "high"), (2, "A", "canonical_package_match", "high"), (4, "B", "exact_package_match", "medium")]


def test_dependencies_of_a_package_are_few_before_files(spark):
    deps = spark.createDataFrame([(i, "p", "npm", i % 9) for i in range(40)], "id int, package string, ecosystem string, risk_score int")
    imports = spark.createDataFrame([("a.js", "p/x", True)], "file string, import_module string, is_external boolean")
    files = spark.createDataFrame([("a.js", ""), ("b.js", "const x = require('p')")], "path string, content string")
    got = reads.dependencies_of_files(deps, imports, files)
    assert "WindowGroupLimit [package" in plan(got)
    assert sorted((r.file, r.id) for r in got.collect()) == [(f, i) for f in ("a.js", "b.js") for i in (8, 16, 17, 26, 35)] or sorted((r.file, r.id) for r in got.collect()) == [(f, i) for f in ("a.js", "b.js") for i in (7, 8, 17, 26, 35)]


def test_best_dependency_of_a_key_first(spark):
    low = spark.createDataFrame([(1, "a_b", "pypi"), (2, "zz", "pypi")], "advisory_id int, package string, ecosystem string")
    deps = spark.createDataFrame([(9, "a-b", "PyPI", "text"), (7, "A.B", "pypi", "import_graph"), (8, "a-b", "pypi", "import_graph")], "id int, package string, ecosystem string, source string")
    got = reads.best_dependency(low, deps)
    assert re.search(r"Aggregate\(key=\[eco|Aggregate\(keys?=\[eco", plan(got))
    assert [(r.advisory_id, r.id, r.strength) for r in got.collect()] == [(1, 7, "strong")]


def test_findings_meet_components_by_path(spark):
    findings = spark.createDataFrame([(i, "src/api/f.py") for i in range(5)] + [(9, "lib/x")], "finding_id int, file_path string")
    parts = spark.createDataFrame([("API", ["src/api"], 1), ("All", ["src", "src/"], 2)], "component string, files array<string>, n int")
    got = rollups.in_component(findings, parts, separator=False)
    assert re.search(r"Join \[(\w+?)#", plan(got))[1] == "file_path"
    assert sorted((r.finding_id, r.component, r.n) for r in got.collect()) == sorted((i, c, n) for i in range(5) for c, n in (("API", 1), ("All", 2)))
