from riskweave.sources import rules as R

YAML = """
rules:
  - id: token
    languages: [regex]
    severity: ERROR
    message: m
    pattern-regex: tok_[a-z0-9]{6}
  - id: eval
    languages: [python]
    severity: WARNING
    pattern: eval(...)
"""


def column(df, name):
    return sorted(r[name] for r in df.collect())


def test_corpus(spark):
    files = spark.createDataFrame([("generic/a.yaml", YAML), ("bad.yml", "{:"), ("none.yaml", None), ("x.txt", YAML)], "path string, content string")
    rules = R.read(files).cache()
    assert column(rules, "id") == ["eval", "token"] and [r.rules for r in R.counts(rules).collect()] == [2]
    bad = spark.createDataFrame([("generic/a.yaml", "eval")], "path string, id string")
    assert column(R.without(rules, bad), "id") == ["token"]
    code = spark.createDataFrame([("a.py", "x\ny = 'tok_abc123'\n"), ("b.py", "nothing"), ("c.py", None)], "path string, content string")
    assert [tuple(r) for r in R.matches(code, rules).collect()] == [("a.py", 2, "token", "ERROR")]
    assert R.matches(code, rules.limit(0)).count() == 0


def test_selection(spark):
    frame = lambda values, name="path": spark.createDataFrame([(v,) for v in values], f"{name} string")
    dirs = frame(["python/lang", "python/flask", "javascript/lang", "java/lang", "dockerfile/best", "terraform/aws"])
    chosen = R.directories(dirs, ["python", "typescript"], ["dockerfile", "terraform"], frame(["dockerfile"], "kind"))
    assert column(chosen, "path") == ["dockerfile/best", "javascript/lang", "python/flask", "python/lang"]
    table = spark.createDataFrame([("flask", "python/flask"), ("spring", "java/spring"), ("flask", "python/gone")], "signal string, path string")
    assert column(R.for_signals(table, frame(["flask", "spring"], "signal"), dirs, ["python"]), "path") == ["python/flask"]
    assert column(R.targeted(chosen, frame(["python/lang"]), frame(["dockerfile/best"])), "path") == ["javascript/lang", "python/flask"]
    deps = spark.createDataFrame([("npm", "Express"), ("pypi", "flask")], "ecosystem string, name string")
    assert column(R.signals(deps, spark.createDataFrame([("Flask==1\n",)], "content string"), ["flask", "django"]), "signal") == ["express", "flask"]
    assert column(R.scannable(frame(["a.py", "b.JS", "c.md"]), [".py", ".js"]), "path") == ["a.py", "b.JS"]
    suites = lambda *v: frame(list(v), "suite")
    usual = suites("javascript-security", "javascript-quality", "python-security")
    none = suites("x").limit(0)
    assert column(R.planned_suites(suites("javascript/xss.ql", "python/x.ql"), usual, none, "typescript"), "suite") == ["javascript/xss.ql"]
    assert column(R.planned_suites(none, usual, suites("javascript-quality"), "javascript"), "suite") == ["javascript-security"]
    assert column(R.planned_suites(none, usual, usual, "javascript"), "suite") == ["javascript-quality", "javascript-security"]


def test_matches_by_literals(spark, monkeypatch):
    """Rules with literals take one pass however many there are, and match what a scan of each block matches."""
    ids = range(60)
    known = [(f"r{i}", "LOW", [f"tok_{i}_[a-z]+"]) for i in ids] + [("two", "LOW", ["Alpha|beta_x", "gam+a_tail"]), ("two", "LOW", ["Alpha|beta_x", "gam+a_tail"]), ("kelvin", "LOW", ["(?i)10k_ohm"]), ("long", None, ["a" * 70]), ("free", "LOW", ["[0-9]{5}"]), ("none", "LOW", ["tok_("])]
    rules = spark.createDataFrame(known, "id string, severity string, regexes array<string>").selectExpr("*", "string(null) AS pattern_regex", "array('x/') AS excludes").cache()
    text = "\n".join([f"tok_{i}_abc TOK_{i + 1}_q" for i in ids] + ["", "Alpha beta_x gama_tail Alpha", "10K_ohm é 10k_OHM", "İ" * 9 + "tok_3_é tok_3_z", "b" + "a" * 71, "12345"])
    files = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("x/d", text), ("a", "é tok_7_w\r\n\n" + "y" * 3000 + "tok_59_z")], "path string, content string").cache()
    scanned = None
    rows = R._expressions_of(rules)
    for block in R._blocks(rows):
        scanned = R._scan(files, block)
    want = sorted(map(tuple, scanned.collect()), key=repr)
    monkeypatch.setattr(R, "BLOCK", 4)
    passes, scan = [], R._scan
    monkeypatch.setattr(R, "_scan", lambda *a: passes.append(1) or scan(*a))
    assert sorted(map(tuple, R.matches(files, rules).collect()), key=repr) == want
    assert len(want) > 60 and ("a", 62, "two", "LOW") in want and want.count(("a", 62, "two", "LOW")) == 2 and len(passes) == 1


def test_filter_of_ends_is_exact_at_cuts(monkeypatch):
    import random

    from riskweave.sources import literals as L

    monkeypatch.setattr(L, "STRETCH", 7)
    dice = random.Random(4)
    for _ in range(30):
        texts = ["".join(dice.choice("ab\n") for _ in range(dice.randrange(1, 60))) for _ in range(3)]
        of = {"".join(dice.choice("ab") for _ in range(dice.randrange(2, 30))) for _ in range(8)} | {"ab"}
        ends = {x: L.end_of(x) for x in of}
        import numpy as np

        bits = np.zeros(1 << 16, bool)
        for bit in L.bits_of(np.array([e for e, _, _ in ends.values()]), 1 << 16):
            bits[bit.astype(int)] = True
        held = L.Ends([(size, pair) for _, size, pair in ends.values()], np.packbits(bits, bitorder="little").tobytes())
        found = set(held.lines(texts))
        want = {(i, k + 1, line, ends[x][0]) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n")) for x in of if x in line}
        assert want <= found and all(t.split("\n")[k - 1] == line for i, k, line, _ in found for t in [texts[i]])
