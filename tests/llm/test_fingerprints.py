import hashlib
import random

from pyspark.sql import functions as F

from riskweave.llm import fingerprints as P


def test_edits_follow_ids(spark, monkeypatch):
    r = random.Random(8)
    rows = [(r.randrange(10**6), " ".join(r.choice("abcdefg") * 2 for _ in range(r.randint(0, 60))), "c") for _ in range(400)]
    rows += [(7, None, "c"), (8, "", "c"), (9, "🙂é" * 31, "c"), (10, "x", "c"), (10, "y", "c"), (10, "x", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sketch string").repartition(7)
    ordered = sorted((i, t or "") for i, t, _ in rows)
    want = []
    for k, (i, t) in enumerate(ordered):
        n, nxt = len(t) // 2, ordered[(k + 1) % len(ordered)][1]
        want.append((i, t, t[: len(t) - n] + nxt[:n]))
    for step, parts in ((64, 4), (2, 40)):
        monkeypatch.setattr(P, "STEP", step)
        monkeypatch.setattr(P, "PARTS", parts)
        got = P.edited(df).collect()
        assert sorted((x.doc_id, x.text, x.edited) for x in got) == sorted(want)
    assert all(x.sketch == x.edited_sketch for x in got if x.text == x.edited)
    one = P.edited(df.where("doc_id = 9")).collect()
    large = spark.createDataFrame([(2**62 + 3 * i, f"t{i}") for i in range(400)], "id long, text string").repartition(6)
    assert sorted((x.id - 2**62) // 3 for x in P.with_next(large, "id", ["text"]).where("next_text = concat('t', cast(((id - 4611686018427387904) / 3 + 1) % 400 as int))").collect()) == list(range(400))
    assert len(one) == 1 and one[0].sketch == one[0].next_sketch
    assert P.edited(df.limit(0)).count() == 0
    assert P.edited(spark.createDataFrame([(None, "a b"), (1, "c d")], "doc_id long, text string")).count() == 2


def test_estimates(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(30000)]
    a, b = " ".join(words), " ".join(words[:6000])
    out = P.sketch(P.sketch(spark.createDataFrame([(a, b)], "a string, b string"), "a", "sa"), "b", "sb")
    x = out.select(P.containment(F.col("sb"), F.col("sa")).alias("within"), P.likeness(F.col("sa"), F.col("sb")).alias("like"), (P.merged(F.col("sa"), F.col("sb")) == F.col("sa")).alias("same"), F.size("sa").alias("n")).first()
    assert x.within == 1.0 and abs(x.like - 0.2) < 0.04 and x.same and abs(x.n - 30000 / P.SHARE) < 300


def test_ids_as_texts_and_many_parts(spark, monkeypatch):
    r = random.Random(5)
    rows = [(f"doc-{r.randrange(10**6):06}", f"text {i} {'é' * (i % 9)}") for i in range(300)] + [(None, "null id"), ("doc-", ""), ("doc-é🙂", "x")]
    ordered = sorted(((i or "").encode(), t) for i, t in rows)
    want = sorted((i.decode(), t, ordered[(k + 1) % len(ordered)][1]) for k, (i, t) in enumerate(ordered))
    df = spark.createDataFrame(rows, "id string, text string").repartition(5)
    for step, chars in ((64, 64 << 20), (3, 20)):
        monkeypatch.setattr(P, "STEP", step)
        monkeypatch.setattr(P, "PART_CHARS", chars)
        got = [(x.id or "", x.text, x.next_text) for x in P.with_next(df, "id", ["text"]).collect()]
        assert sorted(got) == want


def brute_sketch(spark, texts):
    """Sketches from the hashes of all shingles, without Spark's array functions."""
    shingles = []
    for t in texts:
        w = [x for x in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        shingles.append([w[i : i + 5] for i in range(len(w) - 4)] or ([w] if w else []))
    flat = sorted({tuple(s) for row in shingles for s in row})
    words = spark.createDataFrame([(i, list(s)) for i, s in enumerate(flat)] or [(0, [""])], "i int, s array<string>")
    one = F.xxhash64(F.array_join(F.transform("s", lambda w: F.xxhash64(w)), " "))
    five = F.xxhash64(*[F.xxhash64(F.get("s", k)) for k in range(5)])
    hashed = {flat[x.i]: x.h for x in words.select("i", F.when(F.size("s") == 5, five).otherwise(one).alias("h")).collect()} if flat else {}
    out = []
    for row in shingles:
        h = {hashed[tuple(s)] for s in row}
        out.append(sorted(x for x in h if x < P.THRESHOLD) or ([min(h)] if h else []))
    return out


def test_query_against_brute_force(spark):
    from riskweave.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((x.doc_id, x.text or "") for x in docs.collect())
    texts = [t for _, t in rows]
    nexts = texts[1:] + texts[:1]
    edits = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts)]
    own, edited = brute_sketch(spark, texts), brute_sketch(spark, edits)
    like = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 1.0
    text = lambda s: ",".join(f"{h % 2**64:016x}" for h in s)
    got = {x.doc_id: x for x in queries.QUERIES["op4_fingerprints"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edits[k].encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (text(own[k]), text(edited[k]))
        assert abs(x.near_edited - like(own[k], edited[k])) < 1e-12 and abs(x.near_next - like(own[k], own[(k + 1) % len(rows)])) < 1e-12


def test_null_and_odd_ids_do_not_gather_the_table(spark):
    import re

    rows = [(f"doc-{i:012}", f"text {i}") for i in range(20000)] + [(None, "null"), ("zzz", "odd"), ("", "none")]
    df = spark.createDataFrame(rows, "id string, text string").repartition(6)
    assert df.select(P._rank(df, "id", "text").alias("r")).distinct().count() == 20003
    out = P.with_next(df, "id", ["text"])
    ordered = sorted(((i or "").encode(), t) for i, t in rows)
    assert sorted((x.id or "", x.text, x.next_text) for x in out.collect()) == sorted((i.decode(), t, ordered[(k + 1) % len(ordered)][1]) for k, (i, t) in enumerate(ordered))
    largest = max_part(spark, df)
    assert largest < 0.3 * len(rows), largest
    # one id for a third of all rows
    rows = [(None if i % 3 == 0 else i, f"{i * 7919 % 10**6:06} text") for i in range(20000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(6)
    assert max_part(spark, df) < 0.3 * len(rows)
    got = sorted((x.id is not None, x.id or 0, x.text, x.next_text) for x in P.with_next(df, "id", ["text"]).collect())
    ordered = sorted((i is not None, i or 0, t) for i, t in rows)
    assert got == [(*x, ordered[(k + 1) % len(ordered)][2]) for k, x in enumerate(ordered)]
    assert re.fullmatch("[0-9A-F]+![0-9A-F]*", df.select(P._rank(df, "id", "text")).first()[0])


def max_part(spark, df):
    """The rows of the largest part between the cuts of the sample."""
    rank = P._rank(df, "id", "text")
    parts = P.PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    luck = df.select(F.xxhash64("id", "text").alias("l"), rank.alias("r")).groupBy("l").agg(F.min("r").alias("r")).orderBy("l").limit(P.SAMPLE * parts)
    sample = sorted(x.r for x in luck.collect())
    cuts = sorted({sample[i * len(sample) // parts] for i in range(parts)})
    counts = df.groupBy(P._count_upto(rank, cuts, P.STEP)).count().collect()
    return max(x["count"] for x in counts)
