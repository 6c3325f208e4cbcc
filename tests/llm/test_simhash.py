import random

import numpy as np
import xxhash

from riskweave.llm import simhash as S


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def make(n, seed):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = r.choice(out)
        for b in r.sample(range(64), r.randint(0, 5)):
            x ^= 1 << b
        out.append(x)
    return sorted(set(out))


def components_of(values, hot):
    fps = np.array(values, np.uint64)
    k, f = S.keys(fps, hot)
    order = np.lexsort((f, k))
    a, b = S.linked(k[order], f[order])
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist()):
        p, q = root(x), root(y)
        parent[max(p, q)] = min(p, q)
    return {v: root(v) for v in values}


def test_links_lose_no_component():
    for seed in range(6):
        values = make(60, seed)
        want = brute_components(values)
        none = [np.empty(0, np.uint64)] * 2
        every = [np.array([v & 0xFFFFFFFF for v in values], np.uint64), np.array([v >> 32 for v in values], np.uint64)]
        some = [every[0][::3], every[1][::4]]
        for hot in (none, every, some):
            assert components_of(values, hot) == want


def test_fingerprint():
    r = random.Random(1)
    for text in [None, "", " \t ", "One", "A b", "a  B\nc", "ÀB c d", *[" ".join(r.choice("abcDE") * r.randint(1, 3) for _ in range(n)) for n in (3, 9, 70)]]:
        assert S.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


def test_frame(spark):
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 40)) for _ in range(80)) for _ in range(6)]
    texts = [None, "", *base, *base]
    for b in base:
        w = b.split()
        for _ in range(6):
            w[r.randrange(80)] = "zz"
            texts.append(" ".join(w))
    rows = [(i * 7 % 101, t, i) for i, t in enumerate(texts)] + [(500, "x", 1), (500, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    label = brute_components(sorted({brute_fingerprint(t) for _, t, _ in rows}))
    least = {}
    for i, t, _ in rows:
        k = label[brute_fingerprint(t)]
        least[k] = min(least.get(k, i), i)
    want = sorted((i, brute_fingerprint(t), least[label[brute_fingerprint(t)]]) for i, t, _ in rows)
    assert sorted((x.doc_id, x.fingerprint & (2**64 - 1), x.component_id) for x in got) == want
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_chains_and_stars_settle(spark):
    from riskweave.llm.components import labels

    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(5000 - i, 6000) for i in range(1, n)] + [(9, 9)]
    got = {r.node: r.label for r in labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = [set(range(n + 1)), {1000 + i for i in range(n)}, {5000 - i for i in range(1, n)} | {6000}]
    assert set(got) == set().union(*groups)
    assert all(len({got[x] for x in g}) == 1 for g in groups) and len(set(got.values())) == 3


def test_star_by_blocks_of_bits(monkeypatch):
    for seed, direct in ((1, 4), (2, 16), (3, 4)):
        monkeypatch.setattr(S, "DIRECT", direct)
        values = make(90, seed)
        # a crowded key: one segment is shared
        values += [v & 0xFFFFFFFF00000000 | 7 for v in values]
        values = sorted(set(values))
        want, got = brute_components(values), {v: v for v in values}
        a, b = S.star(np.array(values, np.uint64))
        got.update(zip(a.tolist(), b.tolist()))
        assert got == want


def test_star_of_very_many_values():
    import time

    r = np.random.default_rng(1)
    values = np.unique(r.integers(0, 2**32, 60_000, dtype=np.uint64) << np.uint64(32) | np.uint64(9))
    dense = np.unique(np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 32, (9000, 2), dtype=np.uint64), axis=1))
    start = time.process_time()
    S.star(values)
    a, _ = S.star(dense)
    assert len(a) == len(dense) - 1 and time.process_time() - start < 30
