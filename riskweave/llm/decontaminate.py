"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents become sequences of word hashes. Karp-Rabin hashes of 5 words are
the seeds: a document is looked at only where it shares one with an item. The length of the longest
common run of unmarked words is found by halving, with Karp-Rabin hashes of that many words; all
matches of that length that do not overlap are marked, those that come first in the item, and then
in the document, first; then shorter ones, until no match of 5 unmarked words is left. Places are
never paired: however often item and document repeat a passage, a pass takes time and memory in
proportion to their words. The marked share of an item's words, in whatever order the document has
them, is its coverage.

The benchmark is the query set. It is read in blocks of at most BLOCK_WORDS words, whatever its
size; each block's index is broadcast (that bound proves its size) and each adds its findings to
the documents in a pass without a shuffle, so a passage that is in very many documents makes no
hot key. After AT_ONCE blocks the rows are written and their indexes go, so memory does not grow
with the benchmark.

Words are lower-cased runs of ASCII letters and digits and of characters beyond ASCII. Defined
cases: null and empty texts hold no leak; an item of fewer than 5 words is too short to prove one
and never matches; equal items are reported each; repeated rows are each reported; an empty
benchmark or table leaks nothing. Item ids may be of any simple type. All input columns stay, but one
named ``leaks`` is replaced by with_leaks; clean keeps that, too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import wordhash as W

MIN_MATCH, COVERAGE, BLOCK_WORDS, AT_ONCE = 5, 0.6, 1 << 20, 8


def leaks_field(name: str, item_type: T.DataType) -> T.StructField:
    """The array of what a text leaks: item, coverage, number of tiles."""
    one = T.StructType([T.StructField("item_id", item_type), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.IntegerType())])
    return T.StructField(name, T.ArrayType(one, False), False)


_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP)


class Runs:
    """The runs of a sequence of word hashes, and which of its words are still free."""

    def __init__(self, hashes: np.ndarray, free: np.ndarray):
        self.sums, self.free = W.prefix(hashes, W.RUN_A), free

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of so many free words."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[length:] == taken[:-length]) if length <= len(self.free) else np.empty(0, np.int64)
        return at, W.runs(self.sums, W.RUN_A, length)[at] if len(at) else np.empty(0, np.uint64)

    def longest(self) -> int:
        edge = np.diff(np.concatenate([[0], self.free, [0]]).astype(np.int8))
        return int(max(np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1), default=0))


def tiles(item: np.ndarray, doc: np.ndarray, free: np.ndarray, length: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, words) of at least so many words, from
    the word hashes of both and the document's words that may match at all."""
    a, b = Runs(item, np.ones(len(item), bool)), Runs(doc, free.copy())
    out: list[tuple[int, int, int]] = []
    most = min(a.longest(), b.longest())
    while most >= length:
        # a common run of n words holds one of n - 1
        low, high = length - 1, most
        while low < high:
            n = (low + high + 1) // 2
            if np.isin(a.of(n)[1], b.of(n)[1]).any():
                low = n
            else:
                high = n - 1
        if low < length:
            break
        (at, x), (to, y) = a.of(low), b.of(low)
        order = np.argsort(y, kind="stable")
        y, to = y[order], to[order]
        first, last = np.searchsorted(y, x), np.searchsorted(y, x, "right")
        # what is taken stays so, hence each hash's places are gone through once
        seen: dict[int, int] = {}
        for i, lo, hi in zip(at[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist(), strict=True):
            if not a.free[i : i + low].all():
                continue
            k = seen.get(lo, lo)
            while k < hi and not b.free[to[k] : to[k] + low].all():
                k += 1
            seen[lo] = k
            if k < hi:
                j = int(to[k])
                a.free[i : i + low] = b.free[j : j + low] = False
                out.append((i, j, low))
        most = low - 1
    return out


class Index:
    """Seeds of a block of the benchmark: sorted hashes with the item and place of each, and a
    bitmap that rejects most words quickly."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], length: int = MIN_MATCH):
        self.length = length
        hashes, first = W.words([normal(x) for _, x in items])
        seeds = W.runs(W.prefix(hashes, W.RUN_A), W.RUN_A, length)
        at = np.flatnonzero(W.within(first, length))
        order = np.argsort(seeds[at], kind="stable")
        at = at[order]
        self.seeds = seeds[at]
        self.item = np.searchsorted(first, at, "right") - 1
        self.place = at - first[self.item]
        self.ids = [i for i, _ in items]
        self.hashes, self.first = hashes, first
        self.words = np.diff(first)
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self._low(self.seeds)] = True

    def _low(self, seeds):
        return (seeds & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def leaks(self, texts: list[str | None], least: float) -> list[list[dict]]:
        hashes, first = W.words([normal(x) for x in texts])
        seeds = W.runs(W.prefix(hashes, W.RUN_A), W.RUN_A, self.length)
        out: list[list[dict]] = [[] for _ in texts]
        at = np.flatnonzero(self.seen[self._low(seeds)])
        if not len(at) or not len(self.seeds):
            return out
        lo, hi = np.searchsorted(self.seeds, seeds[at]), np.searchsorted(self.seeds, seeds[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        doc = np.searchsorted(first, at, "right") - 1
        inside = at + self.length <= first[doc + 1]
        at, lo, hi, doc = at[inside], lo[inside], hi[inside], doc[inside]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1) if len(at) else []:
            d = int(doc[part[0]])
            # each seed once, however often the text has it: its entries are places of items
            own, one, back = np.unique(lo[part], return_index=True, return_inverse=True)
            n = hi[part][one] - own
            entry = np.repeat(own - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            seed, item = np.repeat(np.arange(len(own)), n), self.item[entry]
            found, places = np.unique(item, return_counts=True)
            # even all seeds together may not reach the coverage
            for k in found[places * self.length >= least * self.words[found]].tolist():
                mine = np.zeros(len(own), bool)
                mine[seed[item == k]] = True
                start = at[part][mine[back]] - first[d]
                low, top = int(start[0]), int(start[-1]) + self.length
                edge = np.zeros(top - low + 1, np.int32)
                edge[start - low] += 1
                edge[start - low + self.length] -= 1
                got = tiles(self.hashes[self.first[k] : self.first[k + 1]], hashes[first[d] + low : first[d] + top], np.cumsum(edge[:-1]) > 0, self.length)
                share = sum(x[2] for x in got) / int(self.words[k])
                if share >= least:
                    out[d].append({"item_id": self.ids[k], "coverage": share, "tiles": len(got)})
        return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int):
    """The benchmark in lists of (id, text) of at most so many words (or one item)."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    held, n = [], 0
    for r in rows.toLocalIterator():
        words = len(normal(r.t).split())
        if held and n + words > most:
            yield held
            held, n = [], 0
        held.append((r.i, r.t))
        n += words
    if held:
        yield held


def _leaks(df: DataFrame, benchmark: DataFrame, name: str, text_col: str, item_col: str, item_text: str, coverage: float, block_words: int) -> DataFrame:
    """Adds what each text leaks under a free name."""
    field = leaks_field(name, benchmark.schema[item_col].dataType)
    kind = common._arrow([field])[0].type
    found, held = None, []
    for items in blocks(benchmark, item_col, item_text, block_words):
        if len(held) == AT_ONCE:
            found = common.written(found)
            for old in held:
                old.unpersist()
            held = []
        sent = df.sparkSession.sparkContext.broadcast(Index(items))
        held.append(sent)

        def run(texts, sent=sent):
            return [pa.array(sent.value.leaks(texts, coverage), kind)]

        if found is None:
            found = common.with_columns(df, [field], run, text_col)
        else:
            (more,) = common.free(found, "more")
            found = common.with_columns(found, [T.StructField(more, field.dataType, False)], run, text_col)
            found = found.withColumn(name, F.concat(name, more)).drop(more)
    return df.withColumn(name, F.array().cast(field.dataType)) if found is None else found


def with_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds ``leaks``: the items of which a text covers so much."""
    df = df.drop(*[c for c in df.columns if c.lower() == "leaks"])
    return _leaks(df, benchmark, "leaks", text_col, item_col, item_text, coverage, block_words)


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows without a leak, with all their columns."""
    (name,) = common.free(df, "leaks")
    return _leaks(df, benchmark, name, text_col, item_col, item_text, coverage, block_words).where(F.size(name) == 0).select(*df.columns)
