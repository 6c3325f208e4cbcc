"""Range joins against every pair, on files that hold most of the rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskweave.functions import fixed
from riskweave.operators import findings, intervals, joins


def test_blocks_hold_each_place_once(spark):
    r = random.Random(1)
    ranges = [(a, a + r.choice([0, 1, 5, 63, 64, 1000, -1, 10**6])) for a in [r.randint(-50, 5000) for _ in range(200)]] + [(0, 2**31 - 2), (1, 1)]
    df = spark.createDataFrame(ranges, "a long, b long")
    got = df.select("a", "b", intervals.blocks(F.col("a"), F.col("b")).alias("x")).collect()
    for row in got:
        spans = sorted((k.block << k.level, (k.block + 1) << k.level) for k in row.x)
        assert len(spans) <= 64
        if row.a > row.b:
            assert not spans
            continue
        assert spans[0][0] == row.a and spans[-1][1] == row.b + 1 and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))


def test_enclosing_symbols_of_one_hot_file(spark):
    r = random.Random(2)
    symbols = [("hot" if r.random() < 0.9 else "b", f"s{i}", a, a + r.choice([0, 3, 40, 900])) for i, a in enumerate(r.randint(1, 900) for _ in range(400))]
    symbols += [("hot", f"w{i}", 1, 2000) for i in range(300)]
    lines = [(i, r.choice(["hot", "hot", "b", "none"]), r.randint(0, 1900)) for i in range(500)] + [(999, "hot", None)]
    want = {}
    for i, f, at in lines:
        near = sorted(((e - s, -s, n) for g, n, s, e in symbols if g == f and at is not None and s <= at <= e))
        want |= {(i, k + 1): n for k, (_, _, n) in enumerate(near[:2])}
    rows = joins.enclosing_symbols(spark.createDataFrame(lines, "line_id int, file string, line int"), spark.createDataFrame(symbols, "file string, name string, start_line int, end_line int"), 2)
    assert {(x.line_id, x["rank"]): x["name"] for x in rows.collect()} == want and len(want) > 600
    assert sorted(rows.columns) == sorted(["line_id", "file", "line", "name", "start_line", "end_line", "rank"])


def test_hits_of_findings_in_one_hot_file(spark):
    r = random.Random(3)
    span = lambda: r.choice([(None, None), (0, 5), (a := r.randint(1, 300), a + r.choice([0, 2, 30])), (a, None), (a, a - 4), (a, 10**6)])
    categories = [*list(fixed.CATEGORY_WORDS)[:4], "other", None, "SQLI"]
    file = lambda: r.choice(["hot"] * 6 + ["b", None])
    a = [(i, file(), r.choice(categories), *span()) for i in range(250)]
    b = [(i, file(), f"r{i % 5}", r.choice(["an sql query", "weak cipher", "note", None]), "semgrep", *span()) for i in range(250)]
    known = lambda x: x not in (None, 0)

    def near(p, q, s, t):
        return known(p) and known(s) and p <= (s if t is None else t) and s <= (p if q is None else q)

    def said(c, *texts):
        words = fixed.CATEGORY_WORDS.get((c or "").lower(), [])
        return any(w in " ".join(t or "" for t in texts).lower() for w in words)

    want = set()
    for i, f, c, p, q in a:
        found = sorted(h for h, g, rule, m, s, x, y in b if f is not None and f == g and (near(p, q, x, y) or said(c, rule, m, s)))
        want |= {(i, h) for h in found[:5]}
    rows = findings.match_hits(spark.createDataFrame(a, "finding_id int, file_path string, category string, start_line int, end_line int"), spark.createDataFrame(b, "hit_id int, file_path string, rule_id string, message string, scanner string, start_line int, end_line int"))
    assert {(x.finding_id, x.hit_id) for x in rows.collect()} == want and len(want) > 500
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"level#\d+ = level#\d+", plan)) >= 2


def test_hits_of_one_id_come_by_rule(spark):
    a = spark.createDataFrame([(1, "f", "crypto", 10, 12), (2, "f", "x", 40, 40), (3, "f", "crypto", 90, 91)], "finding_id int, file_path string, category string, start_line int, end_line int")
    # one hit_id with many rules: begun in the finding, before it, and told by words
    b = [(7, "f", f"r{i}", "a weak cipher", "semgrep", s, e) for i in range(9, -1, -1) for s, e in ((11, 11), (30, 45))]
    schema = "hit_id int, file_path string, rule_id string, message string, scanner string, start_line int, end_line int"
    want = [(1, "r0"), (1, "r0"), (1, "r1"), (1, "r1"), (1, "r2"), *[(2, f"r{i}") for i in range(5)], (3, "r0"), (3, "r0"), (3, "r1"), (3, "r1"), (3, "r2")]
    for rows in (b, b[::-1]):
        got = findings.match_hits(a, spark.createDataFrame(rows, schema).repartition(3))
        assert sorted((r.finding_id, r.rule_id) for r in got.collect()) == want


def test_findings_and_hits_are_shuffled_once(spark):
    rows = spark.range(3000).select(F.col("id").alias("finding_id"), F.concat(F.lit("f"), F.col("id") % 7).alias("file_path"), F.lit("crypto").alias("category"), (F.col("id") % 50).alias("a"), (F.col("id") % 50 + 9).alias("b"))
    hits = rows.select(F.col("finding_id").alias("hit_id"), F.lit("r").alias("rule_id"), F.lit("m").alias("message"), F.lit("s").alias("scanner"), "file_path", F.col("a").alias("x"), F.col("b").alias("y"))
    got = findings._hits_in_order(rows, hits, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    assert got.count() == 5 * 3000


@pytest.mark.parametrize("whole", [30, 20_000])
def test_hits_of_ids_that_repeat(spark, monkeypatch, whole):
    monkeypatch.setattr(findings, "WHOLE_FILE", whole)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    r = random.Random(4)
    a = [(r.choice([None, *range(150)]), r.choice(["x", "y", f"z{i % 60}"]), r.choice(["crypto", "none"]), n := r.choice([None, 0, r.randint(1, 40)]), n and n + r.choice([0, 3, -2])) for i in range(200)]
    b = [(r.randint(0, 90), r.choice(["x", "y", f"z{i % 60}"]), f"r{i % 4}", r.choice(["weak cipher", "note"]), "semgrep", n := r.choice([None, 0, r.randint(1, 40)]), n and n + r.choice([0, 3, -2])) for i in range(200)]
    near = lambda p, q, s, t: p and s and p <= t and s <= q
    want = []
    for one in {x[0] for x in a}:
        found = sorted((h, rule) for i, f, c, p, q in a if i == one for h, g, rule, m, _, s, t in b if f == g and (near(p, q, s, t) or (c == "crypto" and "cipher" in m)))
        want += [(one, *x) for x in found[:5]]
    try:
        rows = findings.match_hits(spark.createDataFrame(a, "finding_id int, file_path string, category string, start_line int, end_line int"), spark.createDataFrame(b, "hit_id int, file_path string, rule_id string, message string, scanner string, start_line int, end_line int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((x.finding_id, x.hit_id, x.rule_id) for x in rows), key=lambda x: (-1 if x[0] is None else x[0], x[1:])) == sorted(want, key=lambda x: (-1 if x[0] is None else x[0], x[1:])) and len(want) > 100
