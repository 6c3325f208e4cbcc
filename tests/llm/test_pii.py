import random
import re

from riskweave.llm import pii as P

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and P.luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(m[0])]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def test_base_equals_the_patterns():
    r = random.Random(6)
    bits = ["a@b.co", "@", ".", "x.y", "1", "23", "255", "256", "007", "1.2.3.4", "-", " ", "+1", "+49 (30) 123-456", "4111 1111 1111 1111", "5", "é", "(", ")", "%", "\n", "4111-1111", "0000"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert P.base_spans(text) == brute(text), text
    for text in (None, "", "🙂 a@b.c 🙂 10.0.0.1", "9" * 5000 + " " + "a" * 5000 + "@b.c"):
        assert P.base_spans(text) == brute(text)
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def test_bootstrapping(spark):
    r = random.Random(2)
    rows = [(i, f"hello there, reach me: user{i}@mail.org or not", "s", "b") for i in range(8)]
    rows += [(100, "then reach me: ab12-99x done", "s", "b"), (101, "a weight of 12345kg here", "s", "b"), (102, None, "s", "b"), (103, "", "s", "b"), (100, "then reach me: ab12-99x done", "s", "b")]
    rows += [(200 + i, f"a weight of {r.randint(10000, 99999)}kg here", "s", "b") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, base string")
    got = {}
    for x in P.with_spans(df).collect():
        got.setdefault(x.doc_id, []).append([tuple(s) for s in x.spans])
    assert got[100] == [[("id", 15, 23)]] * 2
    assert got[0] == [[("email", 23, 37)]] and got[101] == [[]] and got[102] == [[]] and got[103] == [[]]
    assert sum(map(len, got.values())) == len(rows)
    masked = {x.doc_id: x.text for x in P.redact(df).collect()}
    assert masked[100] == "then reach me: [ID] done" and masked[3] == "hello there, reach me: [EMAIL] or not" and masked[102] is None
    assert P.redact(df).columns == df.columns and P.redact(df.limit(0)).count() == 0


def test_identifiers_find_further_ones(spark):
    x, y, z = ([f"{c}{i}x-{i * 37 % 91}q" for i in range(9)] for c in "kmz")
    texts = [f"hello, reach me: user{i}@mail.org or not" for i in range(40)]
    texts += [f"hello, reach me: {v} or not" for v in x]
    # met after a seeded context, then after two that no seed stands in
    texts += [f"the badge number {v} here" for v in (*x, *y)]
    texts += [f"a locker code {v} here" for v in (*y, *z[:3])]
    texts += ["a weight of 12345kg here", f"a weight of {x[0]} here"] + [f"a weight of {i}99kg here" for i in range(100, 112)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text: [s.kind for s in r.spans] for r in P.with_spans(df).collect()}
    assert all(got[t] == (["email"] if "@" in t else [] if "weight" in t else ["id"]) for t in texts), [t for t in texts if not got[t]]


def test_masking_joins_overlaps():
    assert P.masked("abcdefgh", [("card", 1, 4), ("phone", 3, 6), ("ip", 7, 8)]) == "a[CARD]g[IP]"
    assert P.masked("abc", []) == "abc"


def test_long_numbers_and_far_contexts():
    # zeros before a part count for nothing, however many they are
    for text in ("0" * 5000 + ".1.1.1", "1.2.3." + "0" * 9000 + "255", "1.2.3." + "0" * 9000 + "256", "9" * 6000 + ".1.1.1", "0" * 5000):
        want = [] if "256" in text or text.startswith("9") or "." not in text else [("ip", 0, len(text))]
        assert P.base_spans(text) == want
    assert P.pattern_before("call " + "x" * 500 + " ab1", 506) == "call " + "x" * 500
    assert P.pattern_before("x" * 5000 + " ab1", 5001) is None
    assert P.patterns_of("my badge #: ab1 here", 12, 15) == ["w my badge", "l badge #:", "f badge aa9 here"]
    assert P.patterns_of("ab1", 0, 3) == P.patterns_of("call 12 ab1", 8, 11) == []


def scores(edges):
    """The generations of the graph, in plain Python."""
    own = {}
    for p, i, seed, out in edges:
        s, o = own.get((p, i), (False, False))
        own[p, i] = (s or seed, o or out)
    held, known = {i: 1.0 for (_, i), (s, _) in own.items() if s}, 0

    def doubt(conf):
        score = {}
        for (p, i), (_, out) in own.items():
            if not out and conf.get(p, 0) > 0:
                score[i] = score.get(i, 1.0) * (1 - min(conf[p], 0.999999))
        return {i: 1 - d for i, d in score.items()}

    while True:
        score = dict(held)
        for k in range(P.ROUNDS):
            conf, support = {}, {}
            for p in {p for p, _ in own}:
                mine = [i for q, i in own if q == p]
                conf[p] = sum(score.get(i, 0.0) for i in mine) / (len(mine) + P.SMOOTH)
                support[p] = sum(held.get(i, 0.0) >= P.CONFIDENT for i in mine)
            if k < P.ROUNDS - 1:
                more = doubt(conf)
                score = {i: max(held.get(i, 0.0), more.get(i, 0.0)) for _, i in own}
        good = {p: c for p, c in conf.items() if c >= P.CONFIDENT and support[p] >= P.SUPPORT}
        if len(good) == known:
            return good
        known = len(good)
        held = {i: 1.0 for (_, i), (s, _) in own.items() if s}
        for i, s in doubt(good).items():
            held[i] = max(held.get(i, 0.0), s)


def test_scores_against_brute_force(spark):
    for seed in range(3):
        r = random.Random(seed)
        edges = [(f"p{r.randrange(8)}", f"i{r.randrange(60)}") for _ in range(160)]
        kind = {i: r.random() for _, i in edges}
        edges = [(p, i, kind[i] < 0.75, kind[i] > 0.97) for p, i in edges]
        got = {x.pattern: x.confidence for x in P.confident(spark.createDataFrame(edges, "pattern string, instance string, seed boolean, refuted boolean")).collect()}
        want = scores(edges)
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in got)


def planted():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    code = lambda: f"{r.choice('xyz')}{r.randrange(10**5):05}-{r.choice('qrs')}"
    phone = lambda: f"+1 (555) {r.randrange(100, 999)}-{r.randrange(1000, 9999)}"
    texts, hidden = [], set()
    for i in range(20):
        # each form has its own seeds: a label, and a frame of one word before and one after
        texts += [f"{word()} {word()} member: {phone()} {word()}", f"{word()} hereby u{i}@mail.org attends {word()}", f"{word()} number of 99{i}00x pieces, {word()}"]
    for i in range(6):
        hidden.add(len(texts))
        texts.append(f"{word()} {word()} member: {code()} {word()}")
    for i in range(4):
        # a refuted card number stays, even in a good context
        texts.append(f"{word()} {word()} member: 411111111111111{'02345'[i]} {word()}")
    return texts, hidden


def test_labels_find_unseen_identifiers(spark, monkeypatch):
    texts, hidden = planted()
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in enumerate(texts)], "doc_id long, text string, found string, more string, _key string, key string")
    for most in (1 << 16, 0):
        monkeypatch.setattr(P, "MOST_PATTERNS", most)
        out = P.with_spans(df)
        assert out.columns == [*df.columns, "base", "spans"]
        got = {x.doc_id: x for x in out.collect()}
        assert {i for i, x in got.items() if any(s.kind == "id" for s in x.spans)} == hidden
        assert all({tuple(s) for s in x.base} <= {tuple(s) for s in x.spans} and x.found == "a" and x._key == "c" for x in got.values())
        masked = P.redact(df).collect()
        assert all(("[ID]" in x.text) == (x.doc_id in hidden) and (x.found, x.more, x._key, x.key) == ("a", "b", "c", "d") for x in masked)


def test_clean_texts_gain_nothing(spark):
    r = random.Random(5)
    words = "the of and to in for with on at by from up about into over after".split()
    clean = [" ".join(r.choice([*words, *words, f"{r.randrange(10**6)}kg", f"v{r.randrange(99)}.{r.randrange(99)}"]) for _ in range(60)) for _ in range(200)]
    others = [" ".join(r.choice([*words, f"u{r.randrange(10**4)}@m.org"]) for _ in range(10)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(clean + others)), "doc_id long, text string")
    got = {x.doc_id: [s.kind for s in x.spans] for x in P.with_spans(df).collect()}
    assert not any(got[i] for i in range(len(clean))) and sum(map(len, got.values())) > 10


def test_query_against_brute_force(spark, sf):
    import hashlib

    from riskweave.llm import queries

    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {i: P.instances(t, brute(t)) for i, t in docs.items()}
    good = scores([(p, x, seed, out) for rows in found.values() for p, x, seed, out, _, _ in rows])
    names = (*P.KINDS, "id")
    written = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    got = {x.doc_id: x for x in queries.QUERIES["op8_pii"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        base = brute(t)
        new = {("id", a, b) for p, _, seed, out, a, b in found[i] if not seed and not out and p in good}
        every = sorted([*base, *new], key=lambda s: (s[1], names.index(s[0]), s[2]))
        assert got[i].base_sha256 == hashlib.sha256(written(base).encode()).hexdigest() and got[i].spans == written(every)
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [sum(s[0] == k for s in base) for k in P.KINDS]
