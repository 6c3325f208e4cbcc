"""Suffix-array dedup of byte strings: bytes covered by a string of LENGTH bytes that also starts
anywhere else go.

Sorting every suffix of a corpus would move many times its bytes. A difference cover says which
need sorting. Its positions (mod a period v, from the rule of Colbourn and Ling) are so chosen that
any two suffixes have a common offset under v at which both meet the cover. The suffixes at cover
positions are ranked first, at two depths, in buckets over the cluster:

1. LENGTH - v + 1 bytes. If two strings of LENGTH bytes are equal, then so are the cover suffixes
   at their common offset, to this depth. So only suffixes with a tied cover suffix at an offset
   under v can be tied themselves; all others are never sorted.
2. LENGTH + v - 1 bytes, for tied ones only. Suffixes tied for so long settle all v suffixes that
   start at and after them: long ties are resolved by the ranks of the cover. One of each such
   class, its first, still sends its own suffixes on, so that others can meet them.

Then the suffixes that are left are sorted bucket by bucket, each bucket alone in one task: neighbours
that agree in LENGTH bytes are repeated. Suffixes are told apart by names instead of by their bytes:
64-bit polynomials of the bytes, beside the bucket that another polynomial gives; the first rank needs
32 bits, since a false tie there only means that a suffix is sorted for nothing. So the order is that
of names, in which equal strings stand together as in any order.

A task holds one place (about PLACE_BYTES of texts, and a longer text alone) or one bucket of about
BUCKET names. Places are files of a bucketed table, so texts are shuffled once, and what goes to and
fro afterwards are names, without positions, and bits in the order of the names. Copies of a text
are one text for all this: classes larger than rows / MOST_CLASSES, which are fewer than MOST_CLASSES,
are folded before the shuffle with a broadcast of their keys, smaller ones are sorted in their place.

Defined cases: a null or empty text has no bytes; texts under LENGTH bytes keep all; repeated rows and
repeated ids count as separate texts; an empty table gives an empty result. Of the input, only the id
and the text are read; the output is the id, ``kept`` (the bytes left, concatenated), ``n_bytes``,
``n_removed`` and ``n_spans`` (maximal removed runs).
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import wordhash as W

LENGTH = 400
PLACE_BYTES, BUCKET, MOST_CLASSES = 2 << 20, 1 << 18, 1 << 18
#: Bytes that are hashed at a time.
SEGMENT = 1 << 20
#: Fewest places and buckets, so that small inputs are spread, too.
LEAST = 64


def cover(length: int) -> tuple[int, np.ndarray]:
    """A period of at most half the length (or 1) and the residues of a difference cover of it."""
    v, d = 1, [0]
    for r in range(length):
        period = 24 * r * r + 36 * r + 13
        if period > length // 2:
            break
        v, d = period, [0]
        for step in [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r:
            d.append(d[-1] + step)
    return v, np.array(d, np.int64)


def names(buf: np.ndarray, at: np.ndarray, length: int, base: int) -> np.ndarray:
    """The names of the strings of a length at ascending places."""
    out = np.empty(len(at), np.uint64)
    for a in range(0, len(buf), SEGMENT):
        lo, hi = np.searchsorted(at, (a, a + SEGMENT))
        if lo < hi:
            sums, i = W.prefix(W.CODE[buf[a : a + SEGMENT + length]], base), at[lo:hi] - a
            out[lo:hi] = W.mix((sums[i + length] - sums[i]) * W.powers(base, len(sums))[1][i])
    return out


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in a run of a width from one of the ascending starts (which may be
    before the first place)."""
    out = np.zeros(n, bool)
    for a in range(0, n, SEGMENT) if len(starts) else ():
        b = min(n, a + SEGMENT)
        s = starts[np.searchsorted(starts, a - width, "right") : np.searchsorted(starts, b)]
        edge = np.zeros(b - a + 1, np.int32)
        np.add.at(edge, np.maximum(s - a, 0), 1)
        np.subtract.at(edge, np.minimum(s - a + width, b - a), 1)
        out[a:b] = np.cumsum(edge[:-1], dtype=np.int32) > 0
    return out


class Place:
    """The texts of a place, one after another, and what the rounds have found out about them."""

    def __init__(self, docs: pd.DataFrame, length: int, buckets: int):
        self.docs = docs.sort_values(["key", "key2", "id"], na_position="first", kind="stable")
        texts = self.docs["text"].tolist()
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.length, self.buckets = length, buckets
        self.period, self.residues = cover(length)

    def fits(self, at: np.ndarray, length: int) -> np.ndarray:
        """Which strings of a length stay in texts that are long enough to have repeats."""
        doc = np.searchsorted(self.first, at, "right") - 1
        return (at + length <= self.first[doc + 1]) & (self.sizes[doc] >= self.length)

    def cover_suffixes(self) -> np.ndarray:
        n = len(self.buf)
        at = (np.arange(0, n, self.period)[:, None] + self.residues).ravel()
        at = at[at < n]
        return at[self.fits(at, self.length - self.period + 1)]

    def asked(self, round: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, names and buckets of a round's strings, once the rounds before it are learnt."""
        if round == 1:
            at = self.cover_suffixes()
            name = names(self.buf, at, self.length - self.period + 1, W.RUN_A)
            return at, name.astype(np.uint32), (name >> np.uint64(32)) % np.uint64(self.buckets)
        if round == 2:
            at, size = self.tied, self.length + self.period - 1
            at = at[self.fits(at, size)]
        else:
            at, size = self.open, self.length
        return at, names(self.buf, at, size, W.RUN_A), names(self.buf, at, size, W.RUN_B) % np.uint64(self.buckets)

    def learn(self, answers: pd.DataFrame, rounds: int) -> None:
        """Works out what the answers of so many rounds mean."""
        n, v = len(self.buf), self.period
        for k in range(1, rounds + 1):
            at, _, bucket = self.asked(k)
            order = np.argsort(bucket, kind="stable")
            rows = answers[answers["round"] == k].sort_values("bucket")
            counts = np.bincount(bucket.astype(np.int64), minlength=self.buckets)
            tied, lead = np.zeros(len(at), bool), np.zeros(len(at), bool)
            sizes = counts[rows["bucket"].to_numpy(np.int64)]
            for out, column in ((tied, "tied"), (lead, "lead")):
                bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=m) for x, m in zip(rows[column], sizes, strict=True)]
                if bits:
                    out[order] = np.concatenate(bits).astype(bool)
            if k == 1:
                self.tied = at[tied]
            elif k == 2:
                maybe = covered(n, self.tied - v + 1, v)
                self.sure = covered(n, at[tied], v)
                at = np.flatnonzero(maybe & (~self.sure | covered(n, at[lead], v)))
                self.open = at[self.fits(at, self.length)]
            else:
                self.starts = np.union1d(np.flatnonzero(self.sure), at[tied])

    def cut(self) -> pd.DataFrame:
        """The rows that are asked for, without the bytes that repeated strings cover."""
        gone = covered(len(self.buf), self.starts, self.length)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        own = self.first[:-1][self.sizes > 0]
        edge[own] = gone[own]
        sums = lambda x: [int(np.count_nonzero(x[a:b])) for a, b in zip(self.first[:-1], self.first[1:], strict=True)]
        kept = [self.buf[a:b][~gone[a:b]].tobytes() for a, b in zip(self.first[:-1], self.first[1:], strict=True)]
        out = pd.DataFrame({"id": self.docs["id"].tolist(), "kept": kept, "n_bytes": self.sizes, "n_removed": sums(gone), "n_spans": sums(edge)})
        return out[~self.docs["folded"].to_numpy(bool)].astype({"n_removed": "int64", "n_spans": "int64"})


def _asks(round: int, length: int, buckets: int):
    """A round's messages of a place: its names, by bucket, in the order of their places."""

    def messages(docs: pd.DataFrame, answers: pd.DataFrame | None) -> pd.DataFrame:
        rows = []
        if len(docs):
            place = Place(docs, length, buckets)
            if round > 1:
                place.learn(answers, round - 1)
            _, name, bucket = place.asked(round)
            order = np.argsort(bucket, kind="stable")
            name, bucket = name[order], bucket[order].astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            own = int(docs["place"].iloc[0])
            rows = [(int(b[0]), own, x.tobytes()) for b, x in zip(np.split(bucket, cuts), np.split(name, cuts), strict=True) if len(b)]
        return pd.DataFrame(rows, columns=["bucket", "place", "names"]).astype({"bucket": "int32", "place": "int32"})

    if round == 1:
        return lambda docs: messages(docs, None)
    return messages


def _sorted(round: int):
    """Sorts a bucket: which names stand beside an equal one, and which are the first of those."""
    kind = np.uint32 if round == 1 else np.uint64

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        name = np.concatenate([np.frombuffer(x, kind) for x in pdf["names"]])
        order = np.argsort(name, kind="stable")
        same = np.concatenate([[False], name[order[1:]] == name[order[:-1]], [False]])
        tied, lead = np.empty(len(name), bool), np.empty(len(name), bool)
        tied[order], lead[order] = same[1:] | same[:-1], same[1:] & ~same[:-1]
        cuts = np.cumsum([len(x) // kind().itemsize for x in pdf["names"]])[:-1]
        packed = lambda flags: [np.packbits(x).tobytes() for x in np.split(flags, cuts)]
        return pd.DataFrame({"place": pdf["place"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "round": np.int32(round), "tied": packed(tied), "lead": packed(lead)})

    return run


def _placed(docs: DataFrame, places: int) -> DataFrame:
    """The texts as a bucketed table, whose files keep a place's rows together from then on."""
    spark = docs.sparkSession
    n = max(1, min(places, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    name = f"riskweave_{uuid.uuid4().hex}"
    path = common.shared_path(spark)
    out = docs.withColumn("place", F.pmod("key", F.lit(places)).cast("int")).repartition(n, "place")
    out.write.option("compression", "zstd").option("path", path).bucketBy(n, "place").sortBy("place").saveAsTable(name)
    return spark.table(name)


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, kept, n_bytes, n_removed, n_spans of every row; see the module."""
    if length < 1:
        raise ValueError("strings need a byte")
    id_type = df.schema[id_col].dataType.simpleString()
    half = lambda salt: F.xxhash64(F.lit(salt), F.col("text"))
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumns({"key": half(1), "key2": half(2)})
    size = F.octet_length("text").cast("long")
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    places = max(LEAST, total // PLACE_BYTES)
    v, residues = cover(length)

    # classes of copies, so large that there are fewer than MOST_CLASSES of them
    large = docs.groupBy("key", "key2").count().where(F.col("count") > max(1, rows // MOST_CLASSES))
    large = F.broadcast(common.written(large.select("key", "key2")))
    copies = docs.join(large, ["key", "key2"])
    one = copies.groupBy("key", "key2").agg(F.first("text").alias("text"))
    single = docs.join(large, ["key", "key2"], "left_anti").select("id", "text", "key", "key2", F.lit(False).alias("folded"))
    texts = single.unionByName(one.select(F.lit(None).cast("string").alias("id"), "text", "key", "key2", F.lit(True).alias("folded")))
    texts = _placed(texts.withColumn("text", F.col("text").cast("binary")), places)

    buckets = max(LEAST, total * len(residues) // v // BUCKET)
    answers = None
    for k in (1, 2, 3):
        asks = _asks(k, length, buckets)
        group = texts.groupBy("place")
        if answers is None:
            sent = group.applyInPandas(asks, "bucket int, place int, names binary")
        else:
            sent = group.cogroup(answers.groupBy("place")).applyInPandas(asks, "bucket int, place int, names binary")
        found = common.written(sent.groupBy("bucket").applyInPandas(_sorted(k), "place int, bucket int, round int, tied binary, lead binary"))
        answers = found if answers is None else answers.unionByName(found)

    def cut(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"id": [], "kept": [], "n_bytes": [], "n_removed": [], "n_spans": []}).astype({"n_bytes": "int64", "n_removed": "int64", "n_spans": "int64"})
        place = Place(docs, length, buckets)
        place.learn(answers, 3)
        return place.cut()

    out = texts.groupBy("place").cogroup(answers.groupBy("place")).applyInPandas(cut, "id string, kept binary, n_bytes long, n_removed long, n_spans long")
    # a text with copies is repeated as a whole, or too short to be
    whole = size >= length
    copied = copies.select(
        "id",
        F.when(whole, F.lit("")).otherwise(F.col("text")).cast("binary").alias("kept"),
        size.alias("n_bytes"),
        F.when(whole, size).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
    )
    return out.unionByName(copied).select(F.col("id").cast(id_type).alias(id_col), "kept", "n_bytes", "n_removed", "n_spans")
