"""The pipeline's rows against plain Python versions of its stages, on the smallest tables."""

import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import decontaminate, langid, pii, simhash
from riskweave.session import table

from .test_decontaminate import brute as tiling
from .test_langid import WORDS
from .test_langid import text as words_of
from .test_pii import brute as base_spans
from .test_simhash import brute_components, brute_fingerprint


def test_rows_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    network = langid.train(langid.sample(docs)).ready()
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    langs, _ = network.predict([r.text for r in rows])
    rows = [r for r, lang in zip(rows, langs) if lang != "und"]
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    label, seen, kept = brute_components(sorted(set(prints.values()))), set(), []
    for r in rows:
        if label[prints[r.doc_id]] not in seen:
            seen.add(label[prints[r.doc_id]])
            kept.append(r)
    seeds = [(x, set(zip(*[decontaminate.normal(x).split()[k:] for k in range(5)]))) for x in items]
    clean = []
    for r in kept:
        grams = set(zip(*[decontaminate.normal(r.text).split()[k:] for k in range(5)]))
        if not any(tiling(x, r.text)[0] >= decontaminate.COVERAGE for x, s in seeds if len(s & grams) * 5 >= decontaminate.COVERAGE * len(x.split())):
            clean.append(r)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == [r.doc_id for r in clean] and len(clean) < len(kept) < len(rows) <= 200
    more = {r.doc_id: r.spans for r in pii.with_spans(spark.createDataFrame(clean, docs.schema)).collect()}
    for r in clean:
        assert {*base_spans(r.text)} <= {tuple(s) for s in more[r.doc_id]}
        text = pii.masked(r.text, [tuple(s) for s in more[r.doc_id]])
        assert not base_spans(text) and list(got[r.doc_id].ids) == plain.encode_ordinary(text)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_on_edges(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"
    rows = [(1, None, None, None, None, 1.0, "s"), (1, None, None, None, None, 1.0, "s"), (2, "", "en", None, 0, None, None), (None, "the of and to mail a@b.co", "en", "s", 25, 2.0, "t"), (4, "the of and to it", "en", "s", 16, 2.0, "t"), (4, "the of and to it", "en", "s", 16, 2.0, "t")]
    df = spark.createDataFrame(rows, schema)
    empty = df.limit(0)
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        sizes[name] = out.count()
        assert stage(spark, empty, sf).count() == 0
        if name != "byte_bpe":
            assert out.columns == df.columns
    assert sizes == {"language_id": 3, "simhash_near_dedup": 3, "benchmark_decontamination": 6, "pii": 6, "byte_bpe": 6}
    masked = corpus_pipeline.personal_data(spark, df, sf).where(F.col("text").contains("mail")).first()
    assert masked.text == "the of and to mail [EMAIL]" and masked.n_chars == 26 and masked.score == 2.0
    assert simhash.near_duplicates(df).where("doc_id = 1").first().component_id == 1


def test_rows_without_own_ids_stay(spark, sf):
    texts = ["the red fox runs over a wide green field", "some ships sail past an old stone harbour wall", "seven cooks boil soup in one large copper pot", "a clock strikes nine in the empty market hall"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[3]), (None, texts[2]), (8, None), (None, None), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, df, sf)
    assert out.columns == df.columns
    got = sorted([(r.doc_id, r.text) for r in out.collect()], key=str)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (8, None)], key=str)


def test_uncertain_languages_go(spark, sf):
    r = random.Random(6)
    langs = list(WORDS)
    rows = [(i, words_of(langs[i % 3], r.randint(20, 200), r), langs[i % 3]) for i in range(600)]
    rows += [(1000 + i, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600)), None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [x.doc_id for x in corpus_pipeline.language(spark, df, sf).collect()]
    assert sum(i < 600 for i in got) >= 597 and sum(i >= 1000 for i in got) <= 40


def test_labelled_documents_of_unsure_languages_stay(spark, sf):
    r = random.Random(7)
    rows = [(i, words_of("en", r.randint(20, 200), r), ["en", "sco"][i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert corpus_pipeline.language(spark, df, sf).count() >= 590


def test_stages_keep_columns_of_any_name(spark, sf):
    names = ["found", "more", "key", "_key", "base", "leaks", "_name", "row", "lang_pred", "ids", "_uid"]
    rows = [(i, f"the of and to in {w} mail a{i}@b.co", "en", "s", 30, *[f"{n}{i}" for n in names]) for i, w in enumerate(["red fox runs", "old stone wall", "large copper pot"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns
        assert {(x.doc_id, *[x[n] for n in names]) for x in out.collect()} == {(i, *[f"{n}{i}" for n in names]) for i in range(3)}, name
