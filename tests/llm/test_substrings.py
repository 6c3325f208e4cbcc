import random
from collections import Counter

from riskweave.llm import substrings as S
from riskweave.llm import wordhash


def brute(texts, window):
    words = [[w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w] for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    shared = [word() for _ in range(60)]
    texts = [None, "", " ", "x " * 100, "one", " ".join(shared), "\t".join(shared[5:50])]
    for _ in range(60):
        a, n = r.randrange(50), r.randint(2, 40)
        texts.append(" ".join([word() for _ in range(r.randint(0, 30))] + shared[a : a + n] + [word() for _ in range(r.randint(0, 30))]))
    texts += texts[-3:]
    df = spark.createDataFrame([(i % 40, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    for window, gram in ((8, 5), (35, 20), (3, 3)):
        got = Counter((x.doc_id, x.n_words, x.n_removed, x.kept) for x in S.remove_repeated(df, window=window, gram=gram).collect())
        assert got == Counter((i % 40, *x) for i, x in enumerate(brute(texts, window)))
    assert S.remove_repeated(df.limit(0)).count() == 0


def test_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_BITS", 16)
    monkeypatch.setattr(S, "CELLS_PER_ANCHOR", 0.001)
    texts = [" ".join(str((i * k) % 97) for i in range(90)) for k in range(1, 30)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(x.n_removed == x.n_words for x in S.remove_repeated(df).collect())


def test_segments(monkeypatch):
    texts = [b"ab cd  ef", b"", b" x" * 50, b"y" * 90 + b" z", b"ab"]
    whole, first = wordhash.words(texts)
    monkeypatch.setattr(wordhash, "SEGMENT", 16)
    parts, again = wordhash.words(texts)
    assert (whole == parts).all() and (first == again).all() and first.tolist() == [0, 3, 3, 53, 55, 56]


def test_rows_of_one_half_key_stay_apart():
    import numpy as np
    import pandas as pd

    docs = pd.DataFrame({"id": ["1", "2"], "text": ["a b c d e f", "g h i"], "key": np.array([7, 7]), "key2": np.array([1, 2])})
    marks = pd.DataFrame({"keys": [np.array([[7, 1]]).tobytes()], "n": [np.array([2], np.int32).tobytes()], "pos": [np.array([0, 3], np.int32).tobytes()]})
    out = S._cut(3)(docs, marks)
    assert out["kept"].tolist() == ["", "g h i"] and out["n_removed"].tolist() == [6, 0]


def test_sketch_larger_than_its_bitmaps(spark, monkeypatch):
    import numpy as np

    r = random.Random(3)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    shared = words(60)
    texts = [words(4000) for _ in range(40)] + [f"{words(30)} {shared} {words(30)}" for _ in range(9)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    hashes, first = wordhash.words([t.encode() for t in texts])
    _, at, grams = S.anchors(hashes, first, S.WINDOW, S.GRAM)
    many = Counter(grams[np.unique(at)].tolist())
    for beyond, least in ((0.001, 0.0), (64, 0.9)):
        monkeypatch.setattr(S, "MOST_BITS", 16)
        monkeypatch.setattr(S, "CELLS_BEYOND", beyond)
        found = S.sketch(docs, sum(map(len, texts)))
        own = np.array(sorted(many), np.uint64)
        passed = dict(zip(own.tolist(), found.repeated(own).tolist()))
        assert all(passed[k] for k, n in many.items() if n > 1) and max(many.values()) > 5
        # cells for each anchor, not bits, decide how many anchors of one place are sorted out
        assert sum(not passed[k] for k, n in many.items() if n == 1) >= least * sum(n == 1 for n in many.values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((x.doc_id, x.n_words, x.n_removed, x.kept) for x in S.remove_repeated(df).collect())
    assert got == Counter((i, *x) for i, x in enumerate(brute(texts, S.WINDOW)))


def test_rows_that_repeat_are_folded_or_not(spark, monkeypatch):
    r = random.Random(6)
    word = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    texts = [word(60) for _ in range(40)]
    texts += [None] * 300 + [texts[0]] * 200 + ["few\t words  here"] * 50 + [f"{word(9)} {texts[1]} {word(3)}", texts[2] + " x"]
    df = spark.createDataFrame([(None if t is None else i % 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    want = Counter((None if t is None else i % 7, *x) for i, (t, x) in enumerate(zip(texts, brute(texts, S.WINDOW))))
    for classes in (1 << 18, 1):
        monkeypatch.setattr(S, "MOST_CLASSES", classes)
        assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept) for x in S.remove_repeated(df).collect()) == want
    docs = df.selectExpr("coalesce(text, '') text", "xxhash64(1, doc_id, text) key", "xxhash64(2, doc_id, text) key2", "cast(doc_id as string) id")
    rest, done = S._folded(docs, 1, S.WINDOW)
    assert rest.groupBy("key", "key2").count().agg({"count": "max"}).first()[0] == 1 and done.count() == 551
