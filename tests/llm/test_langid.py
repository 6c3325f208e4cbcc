import random
import zlib

import numpy as np

from riskweave.llm import langid as L

WORDS = {"en": "the of and to in that is was for it with".split(), "de": "der die und nicht für schön ein zu größe auf".split(), "fr": "le la et été où que dans une être à".split()}


def text(lang, n, r):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(4)
    rows = [(i, text(l := r.choice(list(WORDS)), r.randint(3, 200), r), l, "x", 1.5) for i in range(600)]
    rows += [(1000, None, "en", "x", 0.0), (1001, "", None, "x", 0.0), (1002, "12 34 !? ½²_", "en", "x", 0.0), (1003, "the of it " * 20000, None, "x", 0.0), (None, "der die und", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = {x.doc_id: x for x in L.identify(df).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score"}
    for k in (1000, 1001, 1002):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[1003].lang_pred == "en" and got[None].lang_pred == "de"
    out = [x for x in got.values() if x.lang and x.text and x.doc_id < 1000 and zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert len(out) > 80 and np.mean([x.lang == x.lang_pred for x in out]) > 0.97
    assert all(0 <= x.score <= 1 for x in got.values())
    assert all(x.lang_pred == "und" for x in L.identify(df.drop("lang").selectExpr("*", "cast(null as string) lang").limit(5)).collect())
    assert L.identify(df.limit(0)).count() == 0


def test_language_of_short_texts_only():
    r = random.Random(8)
    rows = [(text(l, 60, r), l) for l in ("en", "fr") for _ in range(60)]
    rows += [(text("de", 3, r)[:23], "de") for _ in range(120)]
    got, _ = L.train(rows).ready().predict([text("de", 3, r)[:23] for _ in range(60)] + [text("en", 40, r) for _ in range(20)])
    assert got[:60].count("de") >= 50 and got[60:] == ["en"] * 20


def test_pooling_equals_sliding_filters():
    r = random.Random(1)
    net = L.train([(text(l, 60, r), l) for l in WORDS for _ in range(20)]).ready()
    x, n = L.windows([text("fr", 90, r), "", "é"])
    assert n.tolist() == [len(x) - 2, 1, 1]
    plain = np.concatenate([np.max([sum(t[k][row[p + k]] for k in range(len(t))) for p in range(L.LENGTH - len(t) + 1)], axis=0) for t in net.filters for row in [x[0]]])
    assert np.abs(np.maximum(plain + net.bias, 0) - net.pooled(x[:1])[0]).max() < 0.1


def test_sample_is_bounded(spark):
    df = spark.range(4000).selectExpr("id doc_id", "repeat('the of ', 400) text", "if(id % 10 = 0, 'de', 'en') lang")
    got = L.sample(df, per_lang=50)
    assert 60 < len(got) < 160 and {l for _, l in got} == {"de", "en"} and max(len(t) for t, _ in got) <= L.SNIPPET


def test_query_against_an_unrounded_network(spark, sf):
    from riskweave.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    net = L.train(L.sample(docs))
    texts = {x.doc_id: x.text for x in docs.collect()}
    got = {x.doc_id: x for x in queries.QUERIES["op9_language_id"](spark, sf).collect()}
    assert set(got) == set(texts)
    same, off = 0, []
    for i, t in texts.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not L.has_letter(t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        raw = t.encode()
        logs = []
        for a in range(0, len(raw), L.LENGTH):
            row = np.frombuffer(raw[a : a + L.LENGTH].ljust(L.LENGTH, b"\0"), np.uint8)
            kept = np.concatenate([np.max(sum(f[k][row[k : L.LENGTH - len(f) + 1 + k]] for k in range(len(f))), axis=0) for f in net.filters])
            z = np.maximum(kept + net.bias, 0) @ net.out + net.out_bias
            logs.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
        mean = np.mean(logs, axis=0)
        p = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        same += net.langs[int(p.argmax())] == got[i].lang_pred
        off.append(abs(float(p.max()) - got[i].score))
    assert same >= 0.99 * len(off) and np.mean(off) < 0.02


def test_outputs_replace_columns_in_any_case(spark):
    df = spark.createDataFrame([(1, "the of and", "en", "x", "y")], "doc_id long, text string, lang string, Lang_Pred string, SCORE string")
    assert L.identify(df).columns == ["doc_id", "text", "lang", "lang_pred", "score"]


def test_sample_with_a_repeated_id_in_any_partitioning(spark):
    rows = [(8, f"the of and row {i}", "en") for i in range(6000)] + [(i, f"der die und zeile {i}", "de") for i in range(2000)]
    rows += [(9, "le la et une phrase", "fr")] * 5000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [L.sample(df.repartition(n), per_lang=100) for n in (1, 5, 13)]
    assert sorted(got[0]) == sorted(got[1]) == sorted(got[2])
    n = {lang: sum(b == lang for _, b in got[0]) for lang in ("en", "de", "fr")}
    assert 60 < n["en"] < 160 and 60 < n["de"] < 160 and n["fr"] == 1


def test_no_module_defines_a_name_twice():
    import ast
    import pathlib

    import riskweave

    for path in pathlib.Path(riskweave.__file__).parent.rglob("*.py"):
        for scope in [x for x in ast.walk(ast.parse(path.read_text())) if isinstance(x, ast.Module | ast.ClassDef)]:
            names = [x.name for x in scope.body if isinstance(x, ast.FunctionDef | ast.ClassDef)]
            assert len(names) == len(set(names)), path
