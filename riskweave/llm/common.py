"""What the corpus operators share: Arrow passes that keep a row's columns, and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that one Python step turns into a result batch, so that memory does not
#: follow Spark's own batch size when texts are long.
STEP_ROWS, STEP_BYTES = 512, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local one serves a session
    whose tasks run on the driver's machine; a cluster must set it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskweave-"))
            kept = spark.sparkContext.getCheckpointDir()
        path = kept
    return path.rstrip("/")


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: it cuts lineage, survives lost
    executors, and goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = shared_path(spark)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/riskweave-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def steps(batch: pa.RecordBatch, size_of: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices of bounded rows and bytes (of one column)."""
    if not size_of:
        for i in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(i, STEP_ROWS)
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(size_of))), 0).to_pylist()
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and (total + n > STEP_BYTES or i - at >= STEP_ROWS):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def with_columns(df: DataFrame, fields: list[T.StructField], fn: Callable, text_col: str) -> DataFrame:
    """Adds fields computed from a text column by fn(list of str or None) -> a list of Arrow-able
    lists, one for each field. A field replaces an input column of the same name."""
    names = {f.name.lower() for f in fields}
    if text_col.lower() in names:
        raise ValueError(f"{text_col} is both input and output")
    df = df.drop(*[c for c in df.columns if c.lower() in names])
    schema = T.StructType([*df.schema.fields, *fields])
    arrow = _arrow(fields)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in steps(batch, text_col):
                new = fn(part.column(at).to_pylist())
                new = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(new, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema=pa.schema([*part.schema, *arrow]))

    return df.mapInArrow(run, schema)


def _arrow(fields: list[T.StructField]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType(fields))


def row_key(doc_id: str, text: str):
    """A key of 128 bits that tells apart rows of one id with different texts."""
    half = lambda salt: F.lpad(F.hex(F.xxhash64(F.lit(salt), F.col(doc_id), F.col(text))), 16, "0")
    return F.concat(half(1), half(2))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, or where the table has such a column, others that it has not."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
