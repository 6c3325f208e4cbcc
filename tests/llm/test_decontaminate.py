import random
import time

from riskweave.llm import decontaminate as D


def brute(item, doc, least=5):
    """Greedy tiling as defined: every pass looks for the longest unmarked common run."""
    a, b = D.normal(item).split(), D.normal(doc).split()
    ma, mb, tiles = [False] * len(a), [False] * len(b), 0
    while True:
        best, where = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best:
                    best, where = k, [(i, j)]
                elif k == best:
                    where.append((i, j))
        if best < least:
            return sum(ma) / max(1, len(a)), tiles
        for i, j in where:
            if not any(ma[i : i + best]) and not any(mb[j : j + best]):
                ma[i : i + best] = [True] * best
                mb[j : j + best] = [True] * best
                tiles += 1


def test_tiles_match_brute_force():
    r = random.Random(7)
    word = lambda n: r.choice("abcdefghijklmnopqrstuvwxyz"[:n]) * 2
    for trial in range(60):
        item = [word(26) for _ in range(30)]
        parts = [item[0:10], item[10:20], item[20:30]]
        r.shuffle(parts)
        doc = " ".join([word(26) for _ in range(8)] + sum((p + [word(26)] * r.randint(0, 2) for p in parts[: r.randint(1, 3)]), []))
        want = brute(" ".join(item), doc)
        found = D.Index([(1, " ".join(item))]).leaks([doc], 0.0001)[0]
        got = found[0]["coverage"] if found else 0.0
        assert abs(got - want[0]) < 1e-9, trial


def test_frame(spark):
    r = random.Random(1)
    passage = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    items = [(i, passage(30)) for i in range(6)] + [(90, "too short"), (91, None), (92, ""), (None, passage(20))]
    w = items[1][1].split()
    docs = [
        (1, f"{passage(40)} {items[0][1].upper()}! {passage(9)}"),
        (2, " ".join(w[20:] + ["zz"] + w[:10] + ["yy"] + w[10:20])),
        (3, " ".join(w[:12])),
        (4, None),
        (5, ""),
        (6, passage(3000) + " " + items[9][1]),
        (1, f"{items[0][1]} {items[0][1]} {items[2][1]}"),
        (8, "too short"),
    ]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, leaks string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 31):
        got = sorted((r.doc_id, r.text or "", sorted(str(x.item_id) for x in r.leaks)) for r in D.with_leaks(df, bench, block_words=block).collect())
        want = sorted([(1, docs[0][1], ["0"]), (2, docs[1][1], ["1"]), (3, docs[2][1], []), (4, "", []), (5, "", []), (6, docs[5][1], ["None"]), (1, docs[6][1], ["0", "2"]), (8, docs[7][1], [])])
        assert got == want
    kept = D.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]
    assert D.clean(df, bench.limit(0)).count() == len(docs) and D.clean(df.limit(0), bench).count() == 0


def test_repetitive_texts_match_brute_force():
    r = random.Random(9)
    for trial in range(60):
        word = lambda: r.choice("ab"[: r.randint(1, 2)])
        item, doc = " ".join(word() for _ in range(r.randint(5, 30))), " ".join(word() for _ in range(r.randint(5, 40)))
        want = brute(item, doc)
        found = D.Index([(1, item)]).leaks([doc], 0.0001)[0]
        assert (found[0]["coverage"], found[0]["tiles"]) == want if found else want[0] == 0, trial


def test_repeated_words_take_time_in_proportion():
    start = time.process_time()
    same = D.Index([(1, "x " * 20_000), (2, "x y " * 9_000)]).leaks(["x " * 30_000, "y x " * 20_000 + "x " * 500, "z " * 9], 0.5)
    assert [[(x["item_id"], x["tiles"]) for x in row] for row in same] == [[(1, 1)], [(2, 1)], []]
    assert time.process_time() - start < 20


def test_ids_of_other_types_and_clashing_names(spark):
    r = random.Random(2)
    items = [(f"item-{i}", " ".join(f"w{r.randrange(10**6)}" for _ in range(20))) for i in range(3)]
    rows = [(i, t, ["kept", str(i)], "m", "n") for i, (_, t) in enumerate(items[:2])] + [(9, "nothing of that", ["x"], "m", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, leaks array<string>, more string, _leaks string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (1 << 20, 21):
        got = {x.doc_id: [y.item_id for y in x.leaks] for x in D.with_leaks(df, bench, block_words=block).collect()}
        assert got == {0: ["item-0"], 1: ["item-1"], 9: []}
        kept = D.clean(df, bench, block_words=block).collect()
        assert [(x.doc_id, x.leaks, x.more, x._leaks) for x in kept] == [(9, ["x"], "m", "n")]


def test_many_blocks_are_written_between(spark, monkeypatch):
    r = random.Random(8)
    items = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(20))) for i in range(12)]
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in items] + [(99, "none of that")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "AT_ONCE", 3)
    got = {x.doc_id: [y.item_id for y in x.leaks] for x in D.with_leaks(df, bench, block_words=20).collect()}
    assert got == {i: [i] for i, _ in items} | {99: []}
