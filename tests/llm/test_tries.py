import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from riskweave.llm import tries as T


def rebuild(rows, block=100, most=6):
    """Plain Python: rebuilt turns of each conversation. Turns of one number must be alike here."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    if block is None:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        # remainders have the sign of the dividend
        b = c - (abs(c) % block) * (1 if c >= 0 else -1)
        out[c] = own.get(b, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in kids[k])
    out = set()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.add((min(m), len(k), parent, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


def check(df, convs, **options):
    got = T.prefix_trie(df, **options).collect()
    want, n = brute(convs)
    assert len(got) == n and {tuple(x)[:8] for x in got} == want
    # intervals nest as the prefixes do
    order = sorted(got, key=lambda x: x.preorder)
    assert [x.preorder for x in order] == list(range(n))
    stack = []
    for x in order:
        while stack and stack[-1].subtree_end <= x.preorder:
            stack.pop()
        assert x.depth == len(stack) and (not stack or x.subtree_end <= stack[-1].subtree_end)
        if stack:
            assert x.parent_conv_id == stack[-1].conv_id
        stack.append(x)


def rows_of(r, n, words):
    rows = []
    for c in r.sample(range(-250, 700), n):
        turns = [(r.choice(["user", "bot", None]), r.choice(words)) for _ in range(r.choice([1, 2, 2, 3, 5, 9]))]
        rows += [(c, t if t else None, *x) for t, x in enumerate(turns)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_brute_force(spark):
    r = random.Random(12)
    rows = rows_of(r, 120, ["a", "bb", "ccc", None, "é😀", ""])
    rows += [(c, t, "user", f"copy {t}") for c in range(900, 960) for t in range(4)]
    # a conversation far longer than others, with a copy and a branch
    rows += [(c, t, "user", f"long {t % 7}" if c < 802 or t < 250 else "other") for c in (800, 801, 802) for t in range(300)]
    rows += [(800, 150, "user", "long 3")] * 3
    rows += [(None, 1, "user", "no conversation")] * 5
    df = spark.createDataFrame([(*x, "k1", 1) for x in rows], SCHEMA + ", k1 string, d int").repartition(7)
    rows = [x if x[:2] != (800, 150) else (800, 150, "user", "long 3") for x in rows]
    check(df, rebuild(rows))
    check(df, rebuild(rows, None), block=None)
    check(df, rebuild(rows, 10, 3), block=10, most=3)


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "x") for c in range(101, 140)]
    df = spark.createDataFrame(rows, SCHEMA)
    convs = rebuild(rows)
    assert any(not v for v in convs.values())
    check(df, convs)
    assert T.prefix_trie(df.limit(0)).count() == 0
    assert T.prefix_trie(df.where("conv_id is null")).count() == 0
    check(df.where("conv_id = 101"), {101: convs[101]})


def test_one_chunk_for_each_turn_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 2)
    r = random.Random(3)
    rows = [(c, t, "user", f"same {t}") for c in range(40) for t in range(12)] + [(c, t, "user", r.choice("ab")) for c in range(50, 90) for t in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = T._chunks(df, "conv_id", "turn", "role", "text")
        assert chunks.select("c", "part").distinct().count() > chunks.select("c").distinct().count()
        check(df, rebuild(rows, None), block=None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("depth", [1, 2, 40])
def test_chains_one_below_another(spark, depth):
    rows = [(c, t, "user", str(t)) for c in range(depth) for t in range(c + 1)]
    check(spark.createDataFrame(rows, SCHEMA), rebuild(rows, None), block=None)
