"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments only. Of two fingerprints at 3 bits or fewer, one
segment differs by at most one bit, so its variants with one bit as a wildcard (and the whole
segment, for no difference) are indexed: 33 keys for each segment. Fingerprints that share a key
are verified by their distance and linked.

Only distinct fingerprints are indexed, so copies cost nothing. Fingerprints of one key stand
together in a sorted partition and are linked by a star for each connected part: a key never
emits all its pairs, and where it has many fingerprints only those that agree in a block of the other
bits are compared. A segment value that more than max(HOT, N / HOT_SHARE) fingerprints share
is hot (there are at most HOT_SHARE of those for each segment, which bounds what is broadcast);
below its keys, the other segment's halves are indexed the same way, which spreads the key
and loses no pair: of 3 differing bits one half has at most one.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows
and ids each give a row; a null id never is a component's least id while another is there; an
empty table gives an empty result. Only id and text are read of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, components

DISTANCE, SHINGLE, SEED = 3, 3, 42
HOT, HOT_SHARE = 4096, 100_000
EXACT = 32
#: So many fingerprints of one key are compared with each other; more are split by blocks of their bits.
DIRECT = 512


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint of a text, as a signed 64-bit number."""
    import xxhash

    h = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [h(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[i : i + (1 << 15)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """Adds ``fingerprint`` (bigint)."""
    field = T.StructField("fingerprint", T.LongType(), False)
    return common.with_columns(df, [field], lambda texts: [[fingerprint(x, width) for x in texts]], text_col)


def keys(fps: np.ndarray, hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index keys, and the fingerprint of each. Plain keys are segment, wildcard bit and the rest
    of the segment; keys below a hot one are mixed and negative."""
    from .wordhash import mix

    out_k, out_f = [], []
    for s in (0, 1):
        seg = (fps >> np.uint64(32 * s)) & np.uint64(0xFFFFFFFF)
        other = (fps >> np.uint64(32 * (1 - s))) & np.uint64(0xFFFFFFFF)
        is_hot = np.isin(seg, hot[s])
        for p in range(EXACT + 1):
            bit = np.uint64(1 << p) if p < EXACT else np.uint64(0)
            k = (seg & ~bit) | np.uint64(p << 32 | s << 39)
            burning = is_hot | np.isin(seg ^ bit, hot[s]) if len(hot[s]) else is_hot
            out_k.append(k[~burning])
            out_f.append(fps[~burning])
            for q in (0, 1) if burning.any() else ():
                half = (other[burning] >> np.uint64(16 * q)) & np.uint64(0xFFFF)
                for r in range(17):
                    low = half & ~np.uint64(1 << r) if r < 16 else half
                    below = mix(mix(k[burning]) ^ (low | np.uint64(r << 16 | q << 24)))
                    out_k.append(below | np.uint64(1 << 63))
                    out_f.append(fps[burning])
    return np.concatenate(out_k).view(np.int64), np.concatenate(out_f).view(np.int64)


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the edges a, b: the least index of each connected part."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def _near(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a few values, enough to connect their parts: each value is compared with those that
    are not yet reached, so a group of near ones costs little and memory follows the values."""
    left, a, b, queue = np.arange(len(values)), [], [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        i = queue.pop()
        near = np.bitwise_count(values[left] ^ values[i]) <= distance
        if near.any():
            found = left[near]
            a.append(np.full(len(found), i))
            b.append(found)
            queue.extend(found.tolist())
            left = left[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(values: np.ndarray, at: np.ndarray, bits: list[int], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among many values that differ at most in these bits. Values at the distance agree in one
    of distance + 1 blocks of the bits, so only those that share a block's value are compared."""
    if len(at) <= DIRECT or len(bits) <= distance:
        a, b = _near(values[at], distance)
        return at[a], at[b]
    out_a, out_b = [], []
    for k in range(distance + 1):
        block = bits[k :: distance + 1]
        own = values[at] & np.uint64(sum(1 << x for x in block))
        order = np.argsort(own, kind="stable")
        rest = [x for x in bits if x not in block]
        for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            if len(part) > 1:
                a, b = _links(values, at[part], rest, distance)
                out_a.append(a)
                out_b.append(b)
    none = np.empty(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def star(values: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each of some distinct fingerprints to the least of its connected part."""
    differ = np.bitwise_or.reduce(values ^ values[0]) if len(values) else 0
    a, b = _links(values, np.arange(len(values)), [x for x in range(64) if int(differ) >> x & 1], distance)
    label = _roots(np.arange(len(values)), a, b)
    leaf = np.flatnonzero(label != np.arange(len(values)))
    return values[leaf], values[label[leaf]]


def linked(k: np.ndarray, f: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges among fingerprints that share a key; k is sorted, and f within k."""
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(first, len(k)))
    # under a wildcard, those with one value of the bit are linked by the whole segment's key
    plain = k >= 0
    place = ((k >> 39) & 1) * 32 + ((k >> 32) & 63)
    wild = plain & (((k >> 32) & 63) < EXACT)
    bit = (f.view(np.uint64) >> np.where(wild, place, 0).astype(np.uint64)).astype(np.uint8) & 1
    both = np.maximum.reduceat(bit, first) != np.minimum.reduceat(bit, first)
    use = (size > 1) & (both | ~wild[first])
    group = np.repeat(np.arange(len(first)), size)
    # counted without a sign: bitwise_count takes a signed number's absolute value
    near = (np.bitwise_count((f ^ f[first][group]).view(np.uint64)) <= distance) & use[group]
    near[first] = False
    full = np.bincount(group, near, len(first)) == size - 1
    quick = near & full[group]
    a, b = [f[quick]], [f[first][group[quick]]]
    for g in np.flatnonzero(use & ~full):
        x, y = star(np.unique(f[first[g] : first[g] + size[g]].view(np.uint64)), distance)
        a.append(x.view(np.int64))
        b.append(y.view(np.int64))
    return np.concatenate(a), np.concatenate(b)


def _index(sent):
    def run(batches):
        hot = [np.array(x, np.uint64) for x in sent.value]
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), 4096):
                k, f = keys(fps[i : i + 4096], hot)
                yield pa.RecordBatch.from_pydict({"k": k, "f": f})

    return run


def _link(batches):
    """Rows sorted by key; the last key of a batch waits for the next batch."""
    rest_k, rest_f = [], []

    def edges(k, f):
        a, b = linked(k, f)
        order = np.unique(np.stack([a, b]), axis=1) if len(a) else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_pydict({"a": order[0], "b": order[1]})

    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))
        if cut == 0 and rest_k and rest_k[0][0] == k[0]:
            rest_k.append(k)
            rest_f.append(f)
            continue
        head_k, head_f = np.concatenate([*rest_k, k[:cut]]), np.concatenate([*rest_f, f[:cut]])
        if len(head_k):
            yield edges(head_k, head_f)
        rest_k, rest_f = [k[cut:]], [f[cut:]]
    if rest_k:
        yield edges(np.concatenate(rest_k), np.concatenate(rest_f))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints at the distance or less."""
    spark, n = fps.sparkSession, fps.count()
    segments = fps.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.shiftright("fingerprint", 32 * s).bitwiseAND(0xFFFFFFFF).alias("v")) for s in (0, 1)])).alias("x"))
    many = max(HOT, n // HOT_SHARE)
    hot = segments.groupBy("x.s", "x.v").count().where(F.col("count") > many).collect()
    sent = spark.sparkContext.broadcast([[r.v for r in hot if r.s == s] for s in (0, 1)])
    index = fps.select("fingerprint").mapInArrow(_index(sent), "k long, f long")
    return index.repartition("k").sortWithinPartitions("k", "f").mapInArrow(_link, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """id, ``fingerprint``, ``component_id``: the least id that links of DISTANCE bits reach; width is
    the words of a shingle."""
    docs = common.written(fingerprints(df.select(id_col, text_col), text_col, width).select(id_col, "fingerprint"))
    fps = common.written(docs.groupBy("fingerprint").agg(F.min(id_col).alias("least")))
    found = components.labels(links(fps))
    joined = found.join(fps.withColumnRenamed("fingerprint", "node"), "node")
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    of = common.written(found.join(least, "label").select(F.col("node").alias("fingerprint"), "component_id"))
    # fingerprints without a link are their own component
    of = fps.join(of, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    return docs.join(of, "fingerprint").select(id_col, "fingerprint", "component_id")
