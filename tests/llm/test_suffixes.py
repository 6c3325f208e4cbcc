import random
from collections import Counter

import numpy as np
import pytest

from riskweave.llm import suffixes as S
from riskweave.llm import wordhash as W


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
        out.append((bytes(b for b, g in zip(x, gone) if not g), len(x), int(gone.sum()), spans))
    return out


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcé😀") for _ in range(r.randint(1, 5)))
    words = lambda n: " ".join(word() for _ in range(n))
    shared = words(400)
    texts = [None, "", " ", "x" * 1000, "ab" * 600, "ab" * 200, shared]
    for _ in range(60):
        a, n = r.randrange(len(shared) - 50), r.choice([5, 20, 60, 200, 450, 700])
        texts.append(words(r.randint(0, 30)) + shared[a : a + n] + words(r.randint(0, 30)) + r.choice(["", shared[a + 7 : a + n]]))
    near = words(300)
    texts += [near[:i] + "#" + near[i + 1 :] for i in range(0, len(near) - 1, 90)]
    return texts + texts[-4:] + [texts[3], texts[7], None]


def rows(out):
    return Counter((x.doc_id, bytes(x.kept), x.n_bytes, x.n_removed, x.n_spans) for x in out.collect())


@pytest.mark.parametrize("length", [1, 9, 30, 160, 400])
def test_against_brute_force(spark, length):
    texts = corpus()
    df = spark.createDataFrame([(i % 50, t, "k", i) for i, t in enumerate(texts)], "doc_id int, text string, kept string, place long").repartition(5)
    assert rows(S.remove_repeated(df, length=length)) == Counter((i % 50, *x) for i, x in enumerate(brute(texts, length)))
    assert S.remove_repeated(df, length=length).schema["doc_id"].dataType.simpleString() == "int"


def test_small_places_segments_and_unfolded_copies(spark, monkeypatch):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(S, "MOST_CLASSES", 1)
    monkeypatch.setattr(S, "LEAST", 3)
    want = Counter((i, *x) for i, x in enumerate(brute(texts, 60)))
    assert rows(S.remove_repeated(df, length=60)) == want
    monkeypatch.setattr(S, "BUCKET", 50)
    monkeypatch.setattr(S, "PLACE_BYTES", 500)
    assert rows(S.remove_repeated(df, length=60)) == want


def test_empty_tables(spark):
    df = spark.createDataFrame([("a", None), ("b", "x" * 500)], "doc_id string, text string")
    assert S.remove_repeated(df.limit(0)).count() == 0
    assert rows(S.remove_repeated(df.where("text is null"))) == Counter([("a", b"", 0, 0, 0)])
    assert rows(S.remove_repeated(df)) == Counter([("a", b"", 0, 0, 0), ("b", b"", 500, 500, 1)])
    with pytest.raises(ValueError):
        S.remove_repeated(df, length=0)


@pytest.mark.parametrize("length", [1, 25, 26, 146, 400, 2000])
def test_cover_has_all_differences(length):
    v, d = S.cover(length)
    assert v <= max(1, length // 2) and (v == 1 or len(d) < v)
    assert {int(x) for x in ((d[:, None] - d) % v).ravel()} == set(range(v))


def test_names_and_runs_in_segments(monkeypatch):
    buf = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    at = np.unique(np.random.default_rng(2).integers(0, 4900, 700))
    starts = np.concatenate([[-9, -3], at[::9]])
    whole, runs = S.names(buf, at, 90, W.RUN_A), S.covered(5000, starts, 13)
    monkeypatch.setattr(S, "SEGMENT", 64)
    assert (S.names(buf, at, 90, W.RUN_A) == whole).all() and (S.covered(5000, starts, 13) == runs).all()
    assert runs.tolist() == [any(s <= i < s + 13 for s in starts) for i in range(5000)]
    assert len(set(whole.tolist())) == len({buf[i : i + 90].tobytes() for i in at})
