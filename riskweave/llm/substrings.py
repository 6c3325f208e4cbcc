"""Substring dedup: words covered by a window of 35 words that also starts anywhere else.

A count-min sketch sorts out the windows that cannot be repeated. Counting every window would
fill any sketch, so each window is counted through its anchor: of the 16 runs of 20 words in
it, the one of the least hash. Equal windows have equal anchors at different places, so an
anchor's count is never below its windows' counts, and the sketch never below either: no
repeated window is lost. Partitions count their anchors in sketches that are merged block by
block, spread over the cluster, so the sketch has CELLS_PER_ANCHOR cells for each anchor whatever
their number. Only whether a cell holds two or more is kept, in bitmaps of at most 2**MOST_BITS
bits; of a larger sketch, cells that differ in their last bits share one, so what fills the bitmaps
is the number of repeated anchors, not of all.

The second pass takes the windows whose anchor is estimated repeated and groups them by 96 bits
of hashes of their words' 64-bit hashes. Rows are told apart by keys of 128 bits. Each task groups its own first, so a window that is common everywhere sends
one row per task and no key grows hot; what is unique in a task meets the other tasks' windows
in buckets of packed arrays. Positions of repeated windows return to their texts in buckets of
rows. Beyond some 2**MOST_BITS repeated anchors more windows pass; the result stays the same.

Copies of a text, whatever their ids, are one text for all this, so rows that repeat gather in no task:
large classes of copies are folded before any shuffle.

Defined cases: a null or empty text has no words; texts under 35 words keep all; repeated rows
and repeated ids count as separate texts; an empty table gives an empty result. Of the input,
only the id and the text are read; the output is the id, ``kept`` (the kept words, joined by
one space), ``n_words`` and ``n_removed``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import wordhash as W

WINDOW, GRAM = 35, 20
#: Cells of a sketch for each expected anchor, also where the bitmaps hold fewer; log2 of the most
#: bits of a bitmap, and of the most cells; cells of a block.
CELLS_PER_ANCHOR, CELLS_BEYOND, MOST_BITS, MOST_CELLS, BLOCK = 8, 4, 28, 40, 1 << 16
#: Anchors, or windows, that a task holds before it passes them on; code points of a bucket.
HELD, BUCKET_CHARS = 1 << 20, 4 << 20
#: Classes of copies larger than rows / MOST_CLASSES are fewer than MOST_CLASSES, so their keys are broadcast.
MOST_CLASSES = 1 << 18
KNOWN = 65_535


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, each one's anchor position, and the hashes of the runs at all positions."""
    grams = W.runs(W.prefix(hashes, W.RUN_A), W.RUN_A, gram)
    starts = np.flatnonzero(W.within(first, window))
    if not len(starts):
        return starts, starts, grams
    span = window - gram + 1
    best = np.empty(len(grams) - span + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    for i in range(0, len(best), 1 << 16):
        best[i : i + (1 << 16)] = view[i : i + (1 << 16)].argmin(1)
    return starts, starts + best[starts], grams


def cells(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of a run in each of the two rows of the sketch."""
    shift = np.uint64(64 - bits)
    return (grams * np.uint64(W.RUN_B)) >> shift, (W.mix(grams ^ np.uint64(W.BYTES))) >> shift


def _texts(batch, at: int) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(at).to_pylist()]


def _counted(window: int, gram: int, bits: int):
    """Pass 1 of a partition: rows (table, block, cells seen once, cells seen more often)."""

    def rows(held):
        found = np.concatenate(held)
        for t, cell in enumerate(cells(found, bits)):
            cell, n = np.unique(cell, return_counts=True)
            block = (cell >> np.uint64(16)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(block)) + 1
            low = cell.astype(np.uint16)
            parts = [(int(b[0]), c[m < 2].tobytes(), c[m > 1].tobytes()) for b, c, m in zip(np.split(block, cuts), np.split(low, cuts), np.split(n, cuts), strict=True)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([(t << 32 | b) >> 5 for b, _, _ in parts], pa.int64()), "at": pa.array([t << 32 | b for b, _, _ in parts], pa.int64()), "once": [x for _, x, _ in parts], "more": [x for _, _, x in parts]})

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in common.steps(batch, "text"):
                hashes, first = W.words(_texts(part, 0))
                _, at, grams = anchors(hashes, first, window, gram)
                held.append(grams[np.unique(at)])
                n += len(held[-1])
                if n > HELD:
                    yield from rows(held)
                    held, n = [], 0
        if n:
            yield from rows(held)

    return run


def _merged(fold: int):
    """Adds up sketches: the bitmap of cells counted twice or more, for each block; 2**fold cells
    share a bit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for at, rows in pdf.groupby("at"):
            n = np.zeros(BLOCK, np.uint8)
            for once, more in zip(rows["once"], rows["more"], strict=True):
                c = np.frombuffer(once, np.uint16)
                n[c] = np.minimum(n[c] + 1, 2)
                n[np.frombuffer(more, np.uint16)] = 2
            found = np.flatnonzero(n > 1)
            if len(found):
                t, block = at >> 32, at & 0xFFFFFFFF
                bit = (block * BLOCK + found) >> fold
                held = out.setdefault(int(t << 32 | int(bit[0]) // BLOCK), np.zeros(BLOCK, bool))
                held[bit % BLOCK] = True
        return pd.DataFrame([(k, np.packbits(v).tobytes()) for k, v in out.items()], columns=["at", "bits"]).astype({"at": "int64"})

    return run


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps of one block together."""
    return pd.DataFrame({"at": pdf["at"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]]).tobytes()]})


class Sketch:
    """The merged sketch: two bitmaps of fixed size."""

    def __init__(self, rows, bits: int):
        self.bits = bits
        self.maps = np.zeros((2, (1 << bits) // BLOCK * (BLOCK // 8)), np.uint8)
        for at, packed in rows:
            t, b = at >> 32, at & 0xFFFFFFFF
            self.maps[t, b * (BLOCK // 8) : (b + 1) * (BLOCK // 8)] = np.frombuffer(packed, np.uint8)

    def repeated(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones(len(grams), bool)
        for bitmap, cell in zip(self.maps, cells(grams, self.bits), strict=True):
            cell = cell.astype(np.int64)
            out &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return out


def sketch(docs: DataFrame, chars: int, window: int = WINDOW, gram: int = GRAM) -> Sketch:
    """Merges the partitions' sketches of a table (columns text, key)."""
    expected = max(1, chars / 6 * 2 / (window - gram + 2))
    log2 = lambda cells: int(max(16, np.ceil(np.log2(max(1, cells * expected)))))
    kept = min(MOST_BITS, log2(CELLS_PER_ANCHOR))
    bits = max(kept, min(MOST_CELLS, log2(CELLS_BEYOND)))
    rows = docs.select("text").mapInArrow(_counted(window, gram, bits), "part long, at long, once binary, more binary")
    merged = rows.groupBy("part").applyInPandas(_merged(bits - kept), "at long, bits binary")
    if bits > kept:
        merged = merged.groupBy("at").applyInPandas(_joined, "at long, bits binary")
    return Sketch([(r.at, bytes(r.bits)) for r in merged.toLocalIterator()], kept)


def _windows(sent, window: int, gram: int, buckets: int):
    """Pass 2 of a partition: its windows estimated repeated, grouped among themselves."""

    def rows(held, tables):
        h1, h2, idx, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        table = np.concatenate(tables)
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(new) - 1
        many = np.empty(len(order), bool)
        many[order] = np.bincount(group)[group] > 1
        lead = np.zeros(len(order), bool)
        lead[order[new]] = True
        bucket = (h1 % np.uint64(buckets)).astype(np.int64)
        bucket[many & ~lead] = -1
        spread = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[spread])) + 1
        out = {"bucket": [], "h1": [], "h2": [], "idx": [], "pos": [], "keys": []}

        def put(where, at, h, known):
            used, small = np.unique(idx[at], return_inverse=True)
            small = np.where(known, KNOWN, small).astype(np.uint16)
            for name, x in (("bucket", where), ("h1", h1[at].tobytes() if h else b""), ("h2", h2[at].tobytes() if h else b""), ("idx", small.tobytes()), ("pos", pos[at].tobytes()), ("keys", table[used].tobytes())):
                out[name].append(x)

        for at in np.split(spread, cuts):
            if bucket[at[0]] >= 0:
                put(int(bucket[at[0]]), at, True, many[at])
        sure = np.flatnonzero(many)
        if len(sure):
            put(int(h1[0] % np.uint64(buckets)), sure, False, np.zeros(len(sure), bool))
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in out.items()})

    def run(batches):
        seen, held, tables, n, docs = sent.value, [], [], 0, 0
        for batch in batches:
            for part in common.steps(batch, "text"):
                hashes, first = W.words(_texts(part, 0))
                starts, at, grams = anchors(hashes, first, window, gram)
                if not len(starts):
                    continue
                starts = starts[seen.repeated(grams[at])]
                if not len(starts):
                    continue
                a = W.runs(W.prefix(hashes, W.RUN_A), W.RUN_A, window)[starts]
                b = W.runs(W.prefix(hashes, W.RUN_B), W.RUN_B, window)[starts].astype(np.uint32)
                doc = np.searchsorted(first, starts, "right") - 1
                held.append((a, b, (doc + docs).astype(np.uint16), (starts - first[doc]).astype(np.int32)))
                tables.append(np.stack([part.column(k).to_numpy() for k in (1, 2)], 1))
                n, docs = n + len(starts), docs + part.num_rows
                # a step's rows and these stay under what 16 bits can number
                if n > HELD or docs > 60_000:
                    yield from rows(held, tables)
                    held, tables, n, docs = [], [], 0, 0
        if n:
            yield from rows(held, tables)

    return run


def _grouped(places: int):
    """The windows of a bucket: positions of those that two tasks have, and those known before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2, key, pos, known = [], [], [], [], []
        out_key, out_pos = [], []
        for r in pdf.itertuples(index=False):
            idx, p, table = np.frombuffer(r.idx, np.uint16), np.frombuffer(r.pos, np.int32), np.frombuffer(r.keys, np.int64).reshape(-1, 2)
            k = table[np.where(idx == KNOWN, 0, idx)]
            if r.h1:
                h1.append(np.frombuffer(r.h1, np.uint64))
                h2.append(np.frombuffer(r.h2, np.uint32))
                known.append(idx == KNOWN)
                key.append(k)
                pos.append(p)
            else:
                out_key.append(k)
                out_pos.append(p)
        if h1:
            h1, h2, key, pos, known = (np.concatenate(x) for x in (h1, h2, key, pos, known))
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            group = np.cumsum(np.concatenate([[False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            hit = order[(np.bincount(group)[group] > 1) & ~known[order]]
            out_key.append(key[hit])
            out_pos.append(pos[hit])
        key, pos = np.concatenate(out_key), np.concatenate(out_pos)
        place = np.mod(key[:, 0], places)
        order = np.lexsort((pos, key[:, 1], key[:, 0], place))
        key, pos, place = key[order], pos[order], place[order]
        # a key's rows stand together, a place's keys too
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(key))).astype(np.int32)
        rows = []
        for at in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(place[starts])) + 1) if len(key) else []:
            a, b = starts[at[0]], starts[at[-1]] + sizes[at[-1]]
            rows.append((int(place[a]), key[starts[at]].tobytes(), sizes[at].tobytes(), pos[a:b].tobytes()))
        return pd.DataFrame(rows, columns=["place", "keys", "n", "pos"]).astype({"place": "int32"})

    return run


def _cut(window: int):
    """The texts of a place without the words that repeated windows cover."""

    def run(docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.repeat(np.frombuffer(k, np.int64).reshape(-1, 2), np.frombuffer(n, np.int32), axis=0) for k, n in zip(marks["keys"], marks["n"], strict=True)] or [np.empty((0, 2), np.int64)])
        pos = np.concatenate([np.frombuffer(p, np.int32) for p in marks["pos"]] or [np.empty(0, np.int32)])
        order = np.lexsort((key[:, 1], key[:, 0]))
        key, low, pos = key[order, 0], key[order, 1], pos[order]
        kept, n_words, n_removed = [], [], []
        for text, k, k2 in zip(docs["text"], docs["key"].to_numpy(), docs["key2"].to_numpy(), strict=True):
            w = (text or "").encode("utf-8", "surrogatepass").split()
            a, b = np.searchsorted(key, k), np.searchsorted(key, k, "right")
            at = pos[a:b][low[a:b] == k2]
            n_words.append(len(w))
            if len(at):
                edge = np.zeros(len(w) + 1, np.int32)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                w = [w[i] for i in keep]
            n_removed.append(n_words[-1] - len(w))
            kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
        out = pd.DataFrame({"id": docs["id"], "kept": kept, "n_words": np.array(n_words, np.int64), "n_removed": np.array(n_removed, np.int64)})
        return out[~docs["folded"].to_numpy(bool)] if "folded" in docs else out

    return run


def _folded(docs: DataFrame, most: int, window: int) -> tuple[DataFrame, DataFrame]:
    """Texts of which more than so many copies are there, as one folded row each, with all others; and the
    copies' results, which need no search: a text with copies is repeated as a whole, or too short."""
    same = {f"t{k}": F.xxhash64(F.lit(k), F.col("text")) for k in (1, 2)}
    keyed = docs.withColumns(same)
    large = F.broadcast(common.written(keyed.groupBy(*same).count().where(F.col("count") > most).select(*same)))
    copies = keyed.join(large, list(same))
    one = common.written(copies.groupBy(*same).agg(F.first("text").alias("text")))
    one = one.select("text", F.col("t1").alias("key"), F.col("t2").alias("key2"), F.lit(None).cast("string").alias("id"), F.lit(True).alias("folded"))
    rest = keyed.join(large, list(same), "left_anti").drop(*same).withColumn("folded", F.lit(False))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+", -1), "")
    done = copies.select("id", words.alias("w")).select("id", F.when(F.size("w") >= window, "").otherwise(F.array_join("w", " ")).alias("kept"), F.size("w").cast("long").alias("n_words"), F.when(F.size("w") >= window, F.size("w")).otherwise(0).cast("long").alias("n_removed"))
    return rest.unionByName(one), done


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, kept, n_words, n_removed of every row; see the module."""
    if not 0 < gram <= window:
        raise ValueError("an anchor must fit its window")
    spark, id_type = df.sparkSession, df.schema[id_col].dataType.simpleString()
    half = lambda salt: F.xxhash64(F.lit(salt), F.col(id_col), F.col(text_col))
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), half(1).alias("key"), half(2).alias("key2"), F.col(id_col).cast("string").alias("id"))
    rows, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    docs, copied = _folded(docs, max(1, rows // MOST_CLASSES), window)
    places = max(64, chars // BUCKET_CHARS)
    sent = spark.sparkContext.broadcast(sketch(docs, chars, window, gram))
    found = docs.select("text", "key", "key2").mapInArrow(_windows(sent, window, gram, places), "bucket int, h1 binary, h2 binary, idx binary, pos binary, keys binary")
    marks = found.groupBy("bucket").applyInPandas(_grouped(places), "place int, keys binary, n binary, pos binary")
    placed = docs.withColumn("place", F.pmod("key", F.lit(places)).cast("int"))
    out = placed.groupBy("place").cogroup(marks.groupBy("place")).applyInPandas(_cut(window), "id string, kept string, n_words long, n_removed long")
    return out.unionByName(copied).select(F.col("id").cast(id_type).alias(id_col), "kept", "n_words", "n_removed")
