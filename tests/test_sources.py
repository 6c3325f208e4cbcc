import json

from pyspark.sql import functions as F

from riskweave.operators import joins
from riskweave.sources import advisories, manifests, repo, scanners


def deps(*files):
    return {(e, n, v, bool(d)) for p, c in files for e, n, v, d in manifests.parse(p, c)}


def test_formats():
    assert deps(("a/package.json", json.dumps({"dependencies": {"lodash": "^4.17.15"}, "devDependencies": {"jest": "29.0.0"}}))) == {("npm", "lodash", "^4.17.15", False), ("npm", "jest", "29.0.0", True)}
    lock = {"dependencies": {"a": {"version": "1", "dev": True, "dependencies": {"b": {"version": "2"}}}}}
    assert deps(("package-lock.json", json.dumps(lock))) == {("npm", "a", "1", True), ("npm", "b", "2", True)}
    lock = {"packages": {"": {}, "node_modules/x": {"version": "3"}, "node_modules/x/node_modules/@s/y": {"version": "4", "dev": True}}}
    assert deps(("package-lock.json", json.dumps(lock))) == {("npm", "x", "3", False), ("npm", "@s/y", "4", True)}
    assert deps(("yarn.lock", '"@a/b@^1", "@a/b@^1.1":\n  version "1.2.3"\nc@2:\n  version "2.0.0"\n')) == {("npm", "@a/b", "1.2.3", False), ("npm", "c", "2.0.0", False)}
    assert deps(("pnpm-lock.yaml", "packages:\n  /left-pad@1.3.0:\n    x: 1\n")) == {("npm", "left-pad", "1.3.0", False)}
    assert deps(("requirements.txt", "flask==2.3.0\n# x\n-e .\nrequests[socks]>=2.31.0; python_version > '3'\nnoversion\n")) == {("pypi", "flask", "2.3.0", False), ("pypi", "requests", "2.31.0", False)}
    assert deps(("Pipfile.lock", json.dumps({"default": {"a": {"version": "==1.0"}}, "develop": {"b": {"version": "==2.0"}}}))) == {("pypi", "a", "==1.0", False), ("pypi", "b", "==2.0", True)}
    assert deps(("poetry.lock", '[[package]]\nname="a"\nversion="1"\ncategory="dev"\n')) == {("pypi", "a", "1", True)}
    assert deps(("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.1"\n')) == {("crates.io", "serde", "1.0.1", False)}
    assert deps(("go.mod", "module m\nrequire x/single v1.0.0\nrequire (\n\texample.com/a v1.2.3 // indirect\n)\n")) == {("go", "example.com/a", "v1.2.3", False)}
    assert deps(("go.sum", "example.com/a v1.2.3/go.mod h1:x=\n")) == {("go", "example.com/a", "v1.2.3", False)}
    assert deps(("Gemfile.lock", "GEM\n  specs:\n    rails (7.0.1)\n      rack (>= 2)\nPLATFORMS\n  ruby\n")) == {("rubygems", "rails", "7.0.1", False)}
    assert deps(("pom.xml", '<project xmlns="m"><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency></dependencies></project>')) == {("maven", "g:a", "1", True)}
    assert deps(("build.gradle", "implementation 'g:a:1.0'\ntestImplementation(\"g:b:2.0\")")) == {("maven", "g:a", "1.0", False), ("maven", "g:b", "2.0", True)}
    assert deps(("x/App.csproj", '<Project><ItemGroup><PackageReference Include="N" Version="1"/><PackageReference Include="M"><Version>2</Version></PackageReference></ItemGroup></Project>')) == {("nuget", "N", "1", False), ("nuget", "M", "2", False)}
    assert deps(("packages.config", '<packages><package id="a" version="1" developmentDependency="true"/></packages>')) == {("nuget", "a", "1", True)}
    assert deps(("composer.lock", json.dumps({"packages": [{"name": "v/a", "version": "v1.0"}], "packages-dev": [{"name": "v/b", "version": "2"}]}))) == {("packagist", "v/a", "v1.0", False), ("packagist", "v/b", "2", True)}
    assert deps(("composer.json", json.dumps({"require": {"php": ">=8", "ext-x": "*", "v/a": "^1"}}))) == {("packagist", "v/a", "^1", False)}
    assert deps(("pubspec.lock", "packages:\n  async:\n    dependency: transitive\n    source: hosted\n    version: '2.11.0'\n  mine:\n    source: path\n    version: '1.0.0'\n")) == {("pub", "async", "2.11.0", False)}
    assert deps(("mix.lock", '%{"jason": {:hex, :jason, "1.4.1", "x"}, "g": {:git, "u", "r", []}}')) == {("hex", "jason", "1.4.1", False)}
    assert deps(("setup.py", "from setuptools import setup\nsetup(install_requires=['a==1.0'], extras_require={'d': ['b>=2']})")) == {("pypi", "a", "1.0", False), ("pypi", "b", "2", True)}
    assert deps(("setup.cfg", "[options]\ninstall_requires =\n  a==1.0\n[options.extras_require]\nt =\n  b==2\n")) == {("pypi", "a", "1.0", False), ("pypi", "b", "2", True)}
    assert deps(("package.json", "{"), ("pom.xml", "<a>"), ("poetry.lock", "="), ("setup.py", "def"), ("pubspec.lock", "{:"), ("other.txt", "x"), ("package.json", None)) == set()


def test_inventory_and_audit(spark):
    files = [("package.json", json.dumps({"dependencies": {"lodash": "4.17.15", "x": "workspace:*"}})), ("requirements.txt", "my_package==1.5.0\nMy.Package==1.5.0\n"), ("pom.xml", "<p><dependency><groupId>org.apache.logging.log4j</groupId><artifactId>log4j-core</artifactId><version>2.14.0</version></dependency></p>")]
    found = manifests.inventory(spark.createDataFrame(files, "path string, content string"))
    rows = {(r.ecosystem, r.name, r.version) for r in found.collect()}
    assert rows == {("npm", "lodash", "4.17.15"), ("pypi", "My.Package", "1.5.0"), ("maven", "org.apache.logging.log4j:log4j-core", "2.14.0")}
    schema = "id string, ecosystem string, package string, severity string, details string, references array<string>, affected_ranges array<string>, affected_range string, affected_versions array<string>"
    db = spark.createDataFrame([("A1", "npm", "lodash", None, "d" * 600, ["u"] * 5, None, ">=0.0.1,<4.17.20", None), ("A2", "PyPI", "my-package", "HIGH", "", [], [">=1.0,<2.0"], None, None), ("A3", "maven", "org.apache.logging.log4j:log4j-core", "critical", None, None, None, None, ["2.14.0"]), ("A4", "npm", "lodash", "low", None, None, None, "<1.0.0", None)], schema)
    ids = found.withColumn("id", F.col("name"))
    got = {(r.name, r.advisory_id): r for r in joins.audit(ids, db).collect()}
    assert set(got) == {("lodash", "A1"), ("My.Package", "A2"), ("org.apache.logging.log4j:log4j-core", "A3")}
    assert got[("lodash", "A1")].match_type == "exact_package_match" and got[("lodash", "A1")].severity == "medium"
    assert got[("My.Package", "A2")].match_type == "canonical_package_match" and len(got[("lodash", "A1")].details) == 500 and len(got[("lodash", "A1")].references) == 3
    alias = joins.audit(spark.createDataFrame([(1, "maven", "log4j-core", "2.14.0")], "id int, ecosystem string, name string, version string"), db).first()
    assert (alias.advisory_id, alias.match_type) == ("A3", "artifact_alias_match")


def test_osv(spark):
    record = {
        "id": "X-1", "aliases": ["CVE-1"], "summary": "s", "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}], "database_specific": {"severity": "LOW", "cwe_ids": ["CWE-79"]},
        "affected": [
            {"package": {"ecosystem": "npm", "name": "alpha"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2.0"}]}, {"type": "GIT", "events": [{"introduced": "abc"}]}]},
            {"package": {"ecosystem": "npm", "name": "alpha"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "1.3.0"}, {"fixed": "1.4.0"}]}]},
            {"package": {"ecosystem": "npm", "name": "beta"}, "versions": ["2.0.0", "2.1.0"]},
        ],
        "references": [{"url": "https://e/x"}],
    }
    raw = spark.createDataFrame([(json.dumps(record),), (json.dumps(record | {"id": "X-2", "withdrawn": "2024"}),)], "j string")
    got = {r.package: r for r in advisories.from_osv(raw.select(F.from_json("j", advisories.OSV).alias("r")).select("r.*")).collect()}
    a, b = got["alpha"], got["beta"]
    assert (a.affected_range, a.fixed_version, a.cvss_score, a.severity, a.cwes, a.references) == (">=0,<1.2.0 || >=1.3.0,<1.4.0", "1.2.0", 9.8, "critical", ["CWE-79"], ["https://e/x"])
    assert b.affected_versions == ["2.0.0", "2.1.0"] and b.fixed_version is None and len(got) == 2
    base = spark.createDataFrame([("X", ["f"]), ("Y", None)], "id string, vulnerable_functions array<string>")
    extra = spark.createDataFrame([("X", ["f", "_.merge"], [("_.merge", "lodash/merge", 1.0, ["s"]), ("_.merge", "lodash/merge", 0.5, ["t"])])], f"id string, vulnerable_functions array<string>, vulnerable_symbols array<{advisories.SYMBOL}>")
    rich = {r.id: r for r in advisories.enrich(base, extra).collect()}
    assert rich["X"].vulnerable_functions == ["f", "_.merge"] and rich["X"].vulnerable_import_paths == ["lodash/merge"] and len(rich["X"].vulnerable_symbols) == 1 and rich["Y"].vulnerable_functions == []


def test_scanner_reports(spark):
    one = lambda x: spark.createDataFrame([(json.dumps(x),)], "report string")
    s = scanners.semgrep(one({"results": [{"check_id": "r", "path": "./a.py", "start": {"line": 3}, "end": {"line": 4}, "extra": {"message": "m", "severity": "ERROR", "lines": "x", "metadata": {"k": "v"}}}]})).first()
    assert (s.rule_id, s.severity, s.file_path, s.start_line, s.end_line) == ("r", "high", "a.py", 3, 4)
    b = scanners.bandit(one({"results": [{"test_id": "B1", "issue_severity": "MEDIUM", "issue_text": "t", "filename": "b.py", "line_number": 5, "line_range": [5, 6, 7], "code": "c"}]})).first()
    assert (b.severity, b.end_line) == ("medium", 7)
    e = scanners.eslint(one([{"filePath": "/c.js", "messages": [{"ruleId": None, "severity": 2, "message": "p", "line": 1}]}])).first()
    assert (e.rule_id, e.severity, e.file_path) == ("parse-error", "high", "c.js")
    place = lambda f, n: {"physicalLocation": {"artifactLocation": {"uri": f}, "region": {"startLine": n}}}
    result = {"ruleId": "js/x", "level": "warning", "message": {"text": "m"}, "locations": [place("file:///src/a.js", 9)], "properties": {"security-severity": "8.1", "tags": ["external/cwe/cwe-79", "t2"]}, "partialFingerprints": {"b": "2", "a": "1"}}
    flow = result | {"properties": {"tags": ["t1"]}, "codeFlows": [{"threadFlows": [{"locations": [{"location": place("src/b.js", 2) | {"message": {"text": "step"}}}]}]}]}
    reports = spark.createDataFrame([(1, ["s2"], json.dumps({"runs": [{"results": [result]}]})), (2, ["s1"], json.dumps({"runs": [{"results": [flow]}]}))], "ordinal int, suites array<string>, report string")
    hits = scanners.sarif(reports)
    assert {(h.ordinal, h.severity, h.file_path, h.fingerprint) for h in hits.collect()} == {(1, "high", "src/a.js", "a=1|b=2"), (2, "medium", "src/a.js", "a=1|b=2")}
    d = scanners.dedupe(hits).collect()
    assert len(d) == 1 and d[0].suites == ["s1", "s2"] and d[0].tags == ["external/cwe/cwe-79", "t1", "t2"] and d[0].has_data_flow and d[0].severity == "high" and d[0].steps[0].file == "src/b.js"


def test_repository(spark, tmp_path):
    for path, text in {"app.py": "from flask import Flask\n@app.route('/login')\n", "server.js": "const e = require('express')\n", "config.py": "SECRET_KEY = 'x'\n", "requirements.txt": "flask==2.3.0\nsqlalchemy==2.0.0\nrequests==2.31.0\n", "node_modules/x/i.js": "x", "pic.png": "x", "packages/a/package.json": "{}"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = repo.index(repo.read(spark, str(tmp_path))).cache()
    assert {r.path for r in files.collect()} == {"app.py", "server.js", "config.py", "requirements.txt", "packages/a/package.json"}
    assert [(r.language, r.n) for r in repo.languages(files).collect()] == [("python", 2), ("javascript", 1)]
    assert {r.line_count for r in files.where("path = 'app.py'").collect()} == {2}
    found = manifests.dependencies(files)
    assert {r.name for r in found.collect()} == {"flask", "sqlalchemy", "requests"}
    assert {r.framework for r in repo.frameworks(files, found).collect()} == {"flask"}
    assert [r.name for r in repo.listing(files, "").collect()] == ["packages", "app.py", "config.py", "requirements.txt", "server.js"]
    assert [(r.path, r.kind) for r in repo.workspaces(files).collect()] == [("packages/a", "convention")]


def test_malformed_and_empty_manifests_give_no_rows():
    from riskweave.sources import manifests as M

    for name in (*M.FORMATS, "x/App.csproj"):
        for content in ("", None, "{", "[", "<a", "\x00", "null", "[]", "a:[", '{"dependencies":3}', "[[package]]", "<project/>", "require(", "setup(", "{" * 500):
            assert [r for r in M.parse(name, content) if r[1] and r[2]] == [], (name, content)


def test_nested_and_inherited_entries():
    from riskweave.sources import manifests as M

    lock = '{"dependencies":{"a":{"version":"1.0.0","dev":true,"dependencies":{"b":{"version":"2.0.0"}}},"c":{"version":"3.0.0"}}}'
    assert sorted((n, v, bool(d)) for _, n, v, d in M.parse("package-lock.json", lock)) == [("a", "1.0.0", True), ("b", "2.0.0", True), ("c", "3.0.0", False)]


def test_malformed_reports_give_no_hits(spark):
    from riskweave.sources import scanners

    texts = ["", "{", "null", "[]", "{}", '{"results": null}', '{"runs": [{}]}', '{"runs": [{"results": [{}]}]}', None]
    df = spark.createDataFrame([(t,) for t in texts], "report string")
    for reader in (scanners.semgrep, scanners.bandit, scanners.eslint):
        assert reader(df).where("coalesce(rule_id, '') <> '' and rule_id <> 'parse-error'").count() == 0
    assert scanners.sarif(df).where("file_path <> ''").count() == 0


def test_declared_names_of_broken_manifests(spark):
    from riskweave.sources import manifests as M

    rows = [(f"m/{name}", c) for name in M.DECLARING for c in ("", None, "{", "[x", "a: [", "null", "3")]
    assert M.declared(spark.createDataFrame(rows, "path string, content string")).count() == 0


def test_mined_symbols_on_edges(spark):
    from riskweave.sources import advisories

    df = spark.createDataFrame([(1, None, None), (2, "", "`x`" * 3), (3, "method `Open`", "é `Naïve.call()` é")], "id int, summary string, details string")
    assert [(x.id, x.symbol) for x in advisories.text_symbols(df).collect()] == []
    broken = spark.createDataFrame([(1, None)], f"id int, specific {advisories.SPECIFIC}")
    assert advisories.structured_symbols(broken).count() == 0
