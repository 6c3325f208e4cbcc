"""Language identification by a byte convolutional network.

Bytes of a text stand in windows of 256. Filters of widths 2, 3 and 4 slide over a window, the
largest response of each is kept, and a softmax over the kept responses gives the window's
language; a text's is that of its windows' mean log-probabilities, over the whole text. It is
trained in numpy, on the driver, on about PER_LANG different texts of each language, twice as many
at most (chosen by a hash of id and text) and SNIPPET code points of each: a bound fixed by parameter, whatever the table's size.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
where nothing is labelled. Of equally likely languages the first in the alphabet is predicted. Equal texts get equal predictions; repeated rows each give a row. All
input columns stay, but those named like an output (``lang_pred``, ``score``) are replaced.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTHS, FILTERS, LENGTH = (2, 3, 4), 8, 256
PER_LANG, SNIPPET, EPOCHS, BATCH, RATE = 400, 1200, 12, 64, 0.02
UNKNOWN = "und"
_word = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Is there a letter? Numbers that are no digits (fractions, say) are word characters, too."""
    return bool(text) and any(m[0].isalpha() for m in _word.finditer(text))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, and how many each has; a text's last one is filled with zeros."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    n = np.array([max(1, -(-len(x) // LENGTH)) for x in raw], np.int64)
    joined = b"".join(x.ljust(int(k) * LENGTH, b"\0") for x, k in zip(raw, n, strict=True))
    return np.frombuffer(joined, np.uint8).reshape(-1, LENGTH), n


class Network:
    """Tables [offset][byte][filter] of each width, and the softmax layer."""

    def __init__(self, langs: list[str], seed: int = 9):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.filters = [r.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = r.normal(0, 0.3, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)
        self.pairs = None

    def ready(self):
        """Rounds the responses to 7 bits: a width's look-ups, at most two, add up in a byte, and
        the eight filters of a width stand in one 64-bit number."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        t2, t3, t4 = self.filters
        self.pairs, self.scales = [], []
        for tables in ((pair(t2[0], t2[1]),), (pair(t3[0], t3[1]), t3[2]), (pair(t4[0], t4[1]), pair(t4[2], t4[3]))):
            step = np.max([np.ptp(t, axis=0) for t in tables], axis=0) / 127 + 1e-9
            self.pairs.append([np.rint((t - t.min(0)) / step).astype(np.uint8).view(np.uint64)[:, 0] for t in tables])
            self.scales.append((step, sum(t.min(0) for t in tables)))
        return self

    def pooled(self, x: np.ndarray) -> np.ndarray:
        (p2,), (p3, s3), (p4, q4) = self.pairs
        out = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        for i in range(0, len(x), 256):
            b = x[i : i + 256]
            p = b[:, :-1].astype(np.int64) << 8 | b[:, 1:]
            for k, z in enumerate((p2.take(p), p3.take(p[:, :-1]) + s3.take(b[:, 2:]), p4.take(p[:, :-2]) + q4.take(p[:, 2:]))):
                step, least = self.scales[k]
                out[i : i + 256, k * FILTERS : (k + 1) * FILTERS] = _largest(z) * step + least
        return np.maximum(out + self.bias, 0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        return _log_softmax(self.pooled(x) @ self.out + self.out_bias)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, x in enumerate(texts) if has_letter(x)] if self.langs else []
        if not at:
            return langs, scores
        x, n = windows([texts[i] for i in at])
        sums = np.add.reduceat(self.log_probabilities(x), np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
        p = np.exp(_log_softmax(sums / n[:, None]))
        for i, row in zip(at, p, strict=True):
            k = int(row.argmax())
            langs[i], scores[i] = self.langs[k], float(min(1.0, row[k]))
        return langs, scores


def _largest(z: np.ndarray) -> np.ndarray:
    """The largest of each byte of the 64-bit numbers in a row, by halving the row."""
    n, z = z.shape[1], z.view(np.uint8)
    while n > 1:
        half = (n + 1) // 2
        z, n = np.maximum(z[:, : half * 8], z[:, (n - half) * 8 : n * 8]), half
    return z


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(samples: list[tuple[str, str]], seed: int = 9) -> Network:
    """Fits a network to (text, language) pairs by Adam; the same samples give the same one."""
    samples = sorted(set(samples))
    net = Network(sorted({b for _, b in samples}), seed)
    if not samples:
        return net
    x, n = windows([a for a, _ in samples])
    y = np.repeat([net.langs.index(b) for _, b in samples], n)
    full = np.count_nonzero(x, axis=1) >= 24
    # short windows teach little, but a language that has no others keeps them
    use = full | (np.bincount(y, full, len(net.langs)) == 0)[y]
    x, y = x[use], y[use]
    r = np.random.default_rng(seed)
    params = [*net.filters, net.bias, net.out, net.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    # each language weighs the same
    weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(net.langs))) / len(net.langs))[y].astype(np.float32)
    for _ in range(EPOCHS):
        order = r.permutation(len(x))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            b, grads = x[at], [np.zeros_like(p) for p in params]
            kept, where = [], []
            for t in net.filters:
                w = len(t)
                z = sum(t[k][b[:, k : LENGTH - w + 1 + k]] for k in range(w))
                where.append(z.argmax(1))
                kept.append(np.take_along_axis(z, where[-1][:, None, :], 1)[:, 0])
            h = np.concatenate(kept, 1) + net.bias
            a = np.maximum(h, 0)
            d = np.exp(_log_softmax(a @ net.out + net.out_bias))
            d[np.arange(len(at)), y[at]] -= 1
            d *= (weight[at] / len(at))[:, None]
            grads[-2], grads[-1] = a.T @ d, d.sum(0)
            dh = (d @ net.out.T) * (h > 0)
            grads[-3] = dh.sum(0)
            for f, (t, pos) in enumerate(zip(net.filters, where, strict=True)):
                g = dh[:, f * FILTERS : (f + 1) * FILTERS]
                for k in range(len(t)):
                    np.add.at(grads[f][k], (np.take_along_axis(b, pos + k, 1), np.arange(FILTERS)[None, :]), g)
            step += 1
            for p, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id"):
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """About per_lang different labelled texts of each language, and never more than twice that of one.
    Rows that repeat an id and text count once, so they crowd out neither other rows nor a language."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    luck = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)), F.lit(2**30))
    counts = {r[lang_col]: r["n"] for r in labelled.groupBy(lang_col).agg(F.approx_count_distinct(luck).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1, per_lang / max(1, n)) * 2**30)))])
    start = F.pmod(F.xxhash64(F.col(id_col), F.lit("start")), F.greatest(F.lit(1), F.length(text_col) - SNIPPET)) + 1
    picked = labelled.where(luck <= share[F.col(lang_col)]).select(F.substring(F.col(text_col), start.cast("int"), F.lit(SNIPPET)).alias("t"), F.col(lang_col).alias("l"), luck.alias("luck"))
    # repeated rows are one example; so few rows are left of a language that one task may rank them
    ranked = picked.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy("luck", "t")))
    return [(r.t, r.l) for r in ranked.where(F.col("rank") <= 2 * per_lang).collect()]


def predict(df: DataFrame, network: Network, text_col: str = "text", outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, or under other names."""
    sent = df.sparkSession.sparkContext.broadcast(network)
    fields = [T.StructField(outputs[0], T.StringType(), False), T.StructField(outputs[1], T.DoubleType(), False)]

    def run(texts):
        net = sent.value
        if net.langs and net.pairs is None:
            net.ready()
        return net.predict(texts)

    return common.with_columns(df, fields, run, text_col)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on the table's labels outside the held-out fold and predicts every row."""
    return predict(df, train(sample(df, id_col, text_col, lang_col)), text_col)
