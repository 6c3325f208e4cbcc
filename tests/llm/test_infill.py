import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from riskweave.llm import infill as I


def brute(doc_id, text, seed=7, rate=100, spm=50, units=I.LINES):
    t = text or ""
    us = re.findall(units, t)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(us) + 1) for x in h[:2])
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(us), "plain", None, None, t
    p, m, s = "".join(us[:a]), "".join(us[a:b]), "".join(us[b:])
    if h[3] % 100 < spm:
        return len(us), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(us), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = random.Random(13)
    bits = ["<", ">", "P", "S>", "<P", "<M", "\n", "\n\n", "a", "é", "😀", " ", "\r\n", "\t", "$1", "\\", "<P>"]
    out = [None, "", "\n", "\n\n\n", "one line", "<P>", "a<M>b\nc", "x" * 300_000, "y\n" * 50_000, " \u0085\x0b\n\x00z"]
    return out + ["".join(r.choice(bits[:-1] if r.random() < 0.9 else bits) for _ in range(r.randint(0, 40))) for _ in range(400)]


def test_against_brute_force_and_round_trip(spark):
    rows = [(i, t, "x", "kept", i) for i, t in enumerate(texts())] + [(None, "a\nb\nc", "x", None, 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, FORM string, _text string, _draws long").repartition(4)
    for options in ({}, {"rate": 40, "spm": 80, "seed": 3}, {"units": r"[^ ]* |[^ ]+"}):
        out = I.transform(df, **options)
        assert out.columns == ["doc_id", "text", "_text", "_draws", *I.OUTPUTS]
        got = out.withColumn("back", I.restored("output", "form")).collect()
        assert len(got) == len(rows)
        for x in got:
            assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == brute(x.doc_id, x.text, **options)
            assert x.back == (x.text or "")
    assert {"plain", "spm", "psm"} == {x.form for x in got}
    assert I.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        I.transform(df, "FORM")


def test_query_on_the_smallest_table(spark, sf):
    from riskweave.llm import queries

    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.QUERIES["op13_fill_in_middle"](spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Join", plan)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {i: (*brute(i, t)[:4], sha(brute(i, t)[4]), sha(t or "")) for i, t in docs.items()}
    assert {x.doc_id: tuple(x)[1:] for x in out.collect()} == want


def test_texts_that_are_not_rearranged(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, "c<S>d")], "doc_id int, text string")
    assert [(x.form, x.output) for x in I.transform(df, rate=0).orderBy("doc_id").collect()] == [("plain", "a\nb\n"), ("plain", "c<S>d")]
    back = df.select(I.restored(F.col("text"), F.lit("plain")).alias("t")).collect()
    assert [x.t for x in back] == ["a\nb\n", "c<S>d"]
