"""Byte-level BPE encoding and decoding of whole texts by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Each chunk is split into
pre-tokens on its own, in parallel. The pattern looks only ahead, so from any true boundary
on, the split of a chunk is the split of the text: two neighbours are stitched at the first
boundary in their overlap that both have, and what lies between two stitches is encoded on
its own. Where the overlap holds no common boundary (one word longer than it, say) its chunks
stay together; a piece that is longer than a chunk for that reason is encoded match by match of
the pattern, because the library's own splitter fails on very long runs of white space. Decoding
concatenates the bytes of the ids.

Defined cases: a null text counts as empty and has no tokens; repeated rows each give a row;
an empty table gives an empty table; all input columns stay, but those named like an output
(``ids``, ``decoded``) are replaced.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Code points of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 32_768, 512
#: Boundaries so near a chunk's end may be due to the cut (a contraction has 3 characters).
MARGIN = 4
IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)
DECODED = T.StructField("decoded", T.BinaryType(), False)

_cache: dict = {}


class Vocabulary:
    """The bytes of a rank file and the split pattern; they travel to executors as one broadcast."""

    def __init__(self, spark, path: str, pattern: str):
        with open(path, "rb") as f:
            self.sent = spark.sparkContext.broadcast((f.read(), pattern))

    def codec(self):
        return codec(*self.sent.value)


def codec(ranks_file: bytes, pattern: str):
    """tiktoken encoding, compiled pattern and the bytes of each id; made once in a process."""
    key = (hash(ranks_file), pattern)
    if key not in _cache:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x)}
        names = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            names[rank] = token
        encoding = tiktoken.Encoding("riskweave", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _cache.clear()
        _cache[key] = (encoding, regex.compile(pattern), names)
    return _cache[key]


def boundaries(pattern, text: str) -> list[int]:
    """Starts of the pre-tokens at which a text may be cut: what precedes is no white space,
    because a run of white space is split by what follows it."""
    return [m.start() for m in pattern.finditer(text) if m.start() == 0 or not text[m.start() - 1].isspace()]


def ends_of_chunk(pattern, chunk: str, start: int, size: int, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """A chunk's boundaries in what it shares with its predecessor, and with its successor."""
    marks = boundaries(pattern, chunk)
    head = [start + m for m in marks if m < overlap]
    tail = [] if last else [start + m for m in marks if size <= m <= len(chunk) - MARGIN and m < marks[-1]]
    return head, tail


def chunk_starts(n: int, size: int) -> range:
    return range(0, max(n, 1), size)


def encode_piece(encoding, pattern, text: str, longest: int):
    """Ids of a piece between two boundaries."""
    import numpy as np

    if len(text) <= longest:
        return encoding.encode_to_numpy(text, disallowed_special=())
    one = encoding._core_bpe.encode_single_piece
    return np.array([i for m in pattern.finditer(text) for i in one(m[0].encode("utf-8", "replace"))], np.uint32)


def encode_text(encoding, pattern, text: str, size: int = CHUNK, overlap: int = OVERLAP):
    """Ids of a text, through chunks and stitches, in one process."""
    import numpy as np

    if len(text) <= size:
        return encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    cuts, before = [0], []
    for s in chunk_starts(len(text), size):
        head, tail = ends_of_chunk(pattern, text[s : s + size + overlap], s, size, overlap, s + size >= len(text))
        shared = set(before) & set(head)
        if shared:
            cuts.append(min(shared))
        before = tail
    cuts.append(len(text))
    longest = 2 * (size + overlap)
    return np.concatenate([encode_piece(encoding, pattern, text[a:b], longest) for a, b in zip(cuts, cuts[1:], strict=False)]).astype(np.int32)


def _ids_array(found) -> pa.Array:
    import numpy as np

    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    values = np.concatenate(found) if found else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), type=pa.list_(pa.field("element", pa.int32(), False)))


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", with_bytes: bool = False, size: int = CHUNK, overlap: int = OVERLAP, spread: int | None = None) -> DataFrame:
    """Adds ``ids`` to every row, and with with_bytes the ids' bytes as ``decoded``.

    Texts of up to ``spread`` code points (8 chunks by default) are chunked, stitched and
    encoded by the task that reads them; the chunks of longer ones are dealt over the cluster."""
    spread = 8 * size if spread is None else spread
    fields = [IDS, DECODED] if with_bytes else [IDS]
    df = df.drop(*[c for c in df.columns if c.lower() in (IDS.name, DECODED.name)])
    text = F.coalesce(F.col(text_col), F.lit(""))

    def one(texts):
        encoding, pattern, names = vocabulary.codec()
        found = [encode_text(encoding, pattern, x or "", size, overlap) for x in texts]
        out = [_ids_array(found)]
        return [*out, [b"".join([names[i] for i in x.tolist()]) for x in found]] if with_bytes else out

    short = common.with_columns(df.where(F.length(text) <= spread), fields, one, text_col)
    return short.unionByName(_encode_long(df.where(F.length(text) > spread), vocabulary, text_col, with_bytes, size, overlap))


def _encode_long(df: DataFrame, vocabulary: Vocabulary, text_col: str, with_bytes: bool, size: int, overlap: int) -> DataFrame:
    """The same for long texts, a chunk at a time: cut, split, stitch, encode, join."""
    (name,) = common.free(df, "_uid")
    uid = [T.StructField("_uid", T.StringType())]
    schema = T.StructType([*uid, T.StructField("_k", T.IntegerType()), T.StructField("_last", T.BooleanType()), T.StructField("_chunk", T.StringType())])

    def named(texts, seen: dict, part: int) -> list[str]:
        import hashlib

        out = []
        for x in texts:
            h = hashlib.blake2b(repr(x).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            seen[h] = seen.get(h, 0) + 1
            out.append(f"{h}-{part}-{seen[h]}")
        return out

    # A row's name is its content, its partition and its number among equal rows there.
    def tag(batches):
        from pyspark import TaskContext

        seen: dict = {}
        for batch in batches:
            for part in common.steps(batch, text_col):
                names = named([tuple(r.values()) for r in part.to_pylist()], seen, TaskContext.get().partitionId())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string())], schema=pa.schema([*part.schema, pa.field(name, pa.string())]))

    # Written, because both the chunks and the last join read the names: a row must keep its own.
    rows = common.written(df.mapInArrow(tag, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])))

    def cut(batches):
        for batch in batches:
            for x, u in zip(*batch.columns, strict=True):
                x, u = x.as_py() or "", u.as_py()
                for k, s in enumerate(chunk_starts(len(x), size)):
                    yield pa.RecordBatch.from_pydict({"_uid": [u], "_k": pa.array([k], pa.int32()), "_last": [s + size >= len(x)], "_chunk": [x[s : s + size + overlap]]})

    def split(batches):
        _, pattern, _ = vocabulary.codec()
        for batch in batches:
            ends = [ends_of_chunk(pattern, c, k * size, size, overlap, last) for c, k, last in zip(batch.column(3).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            marks = [pa.array([e[i] for e in ends], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], names=[*batch.schema.names, "_head", "_tail"])

    ints = T.ArrayType(T.IntegerType())
    chunks = rows.select(text_col, name).mapInArrow(cut, schema).repartition("_uid", "_k")
    chunks = chunks.mapInArrow(split, T.StructType([*schema.fields, T.StructField("_head", ints), T.StructField("_tail", ints)]))
    w, doc = Window.partitionBy("_uid").orderBy("_k"), Window.partitionBy("_uid")
    stitch = F.array_min(F.array_intersect("_tail", F.lead("_head").over(w)))
    pieces = chunks.withColumn("_to", F.when(F.col("_last"), F.col("_k") * size + F.length("_chunk")).otherwise(stitch))
    pieces = pieces.withColumn("_from", F.coalesce(F.lag("_to").over(w), F.lit(0))).withColumn("_whole", F.bool_or(F.col("_to").isNull()).over(doc))
    pieces = pieces.select("_uid", "_k", "_chunk", (F.col("_from") - F.col("_k") * size).alias("_a"), (F.col("_to") - F.col("_k") * size).alias("_b"), "_whole")

    def encode_pieces(batches):
        encoding, _, _ = vocabulary.codec()
        for batch in batches:
            for r in batch.to_pylist():
                ids = [] if r["_whole"] else encoding.encode_ordinary(r["_chunk"][r["_a"] : r["_b"]])
                rest = r["_chunk"][:size] if r["_whole"] else ""
                yield pa.RecordBatch.from_pydict({"_uid": [r["_uid"]], "_k": pa.array([r["_k"]], pa.int32()), "_ids": pa.array([ids], pa.list_(pa.int32())), "_rest": [rest]})

    done = pieces.mapInArrow(encode_pieces, T.StructType([*uid, T.StructField("_k", T.IntegerType()), T.StructField("_ids", ints), T.StructField("_rest", T.StringType())]))

    def join(pdf):
        import pandas as pd

        encoding, pattern, names = vocabulary.codec()
        pdf = pdf.sort_values("_k")
        rest = "".join(pdf["_rest"])
        ids = encode_text(encoding, pattern, rest, size, overlap).tolist() if rest else [int(i) for x in pdf["_ids"] for i in x]
        return pd.DataFrame({"_uid": [pdf["_uid"].iloc[0]], "ids": [ids], "decoded": [b"".join([names[i] for i in ids]) if with_bytes else b""]})

    joined = done.groupBy("_uid").applyInPandas(join, T.StructType([*uid, IDS, DECODED]))
    out = rows.join(joined.withColumnRenamed("_uid", name), name).drop(name)
    return out if with_bytes else out.drop("decoded")


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the bytes of the ids, concatenated (null ids: none)."""
    df = df.drop(*[c for c in df.columns if c.lower() == DECODED.name])

    def run(batches):
        _, _, names = vocabulary.codec()
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for part in common.steps(batch):
                new = pa.array([b"".join([names[i] for i in x or ()]) for x in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, new], names=[*part.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, DECODED]))
