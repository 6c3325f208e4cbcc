import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from riskweave.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(5)
    alphabet = ["a", "Straße", "l'", "'", "'ll", "'re", " ", "  ", "\n", "\n\n", "\t", "12", "é", "漢字", "!?", "<|endoftext|>", "I'd", "🙂", " "]
    made = ["".join(r.choice(alphabet) for _ in range(n)) for n in (1, 5, 40, 400, 3000)]
    return [None, "", " ", "x" * 5000, " " * 3000, "'" * 700, *made, *made]


def test_chunked_ids_equal_whole_ids(plain):
    with open(PATH, "rb") as f:
        encoding, pattern, names = bpe.codec(f.read(), P.PATTERN)
    for text in texts():
        for size, overlap in ((8, 6), (50, 20), (400, 64)):
            got = bpe.encode_text(encoding, pattern, text or "", size, overlap).tolist()
            assert got == plain.encode_ordinary(text or "")
            assert b"".join(names[i] for i in got).decode() == (text or "")


@pytest.mark.parametrize("spread", [0, 10**9])
def test_frames(spark, plain, spread):
    rows = [(i, t, "old", i % 2) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, _k int")
    out = bpe.encode(df, bpe.Vocabulary(spark, PATH, P.PATTERN), with_bytes=True, size=200, overlap=32, spread=spread)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and set(out.columns) == {"doc_id", "text", "_k", "ids", "decoded"}
    for i, t, _, _ in rows:
        assert list(got[i].ids) == plain.encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode()
    again = bpe.decode(out.drop("decoded"), bpe.Vocabulary(spark, PATH, P.PATTERN)).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again)
    assert bpe.encode(df.limit(0), bpe.Vocabulary(spark, PATH, P.PATTERN)).count() == 0


def test_long_runs_reach_no_library_limit(plain):
    with open(PATH, "rb") as f:
        encoding, pattern, names = bpe.codec(f.read(), P.PATTERN)
    for text in (" " * 100_000, "\n" * 90_000 + "w" * 80_000, "ab " * 9 + "x" * 120_000 + " y", " " * 70_000 + "word"):
        assert bpe.encode_text(encoding, pattern, text).tolist() == plain.encode_ordinary(text)
    # the library panics on these as a whole; a match of the pattern is encoded as the library encodes one
    for text, last in ((" " * 2_000_000, " "), ("\n" * 2_000_000, "\n"), (" " * 2_000_000 + "word", " word"), ("a" + "\n" * 1_500_000 + "word, and more", "word, and more")):
        got = bpe.encode_text(encoding, pattern, text).tolist()
        assert b"".join(names[i] for i in got).decode() == text
        want = plain.encode_ordinary(last)
        assert got[-len(want) :] == want


def test_runs_of_white_space_in_frames(spark, plain):
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b c", "word " * 20_000]
    df = spark.createDataFrame([(i, t, "u") for i, t in enumerate(texts)], "doc_id long, text string, _uid string")
    for spread in (0, None):
        out = bpe.encode(df, bpe.Vocabulary(spark, PATH, P.PATTERN), with_bytes=True, spread=spread)
        assert set(out.columns) == {"doc_id", "text", "_uid", "ids", "decoded"}
        got = {r.doc_id: r for r in out.collect()}
        assert all(bytes(got[i].decoded).decode() == t and got[i]._uid == "u" for i, t in enumerate(texts))
        assert list(got[2].ids) == plain.encode_ordinary(texts[2])
