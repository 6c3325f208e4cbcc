"""Scan events: an append-only log whose id is the offset, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The states of a scan, and those that may follow each.
TRANSITIONS = {"pending": ["running", "cancelled"], "running": ["completed", "failed", "cancelled"], "completed": [], "failed": [], "cancelled": []}


def page(events: DataFrame, after: int, limit: int = 100) -> DataFrame:
    """Events after an id, in order; the last id of a page asks for the next one."""
    return events.where(F.col("event_id") > after).orderBy("event_id").limit(limit)


def progress(events: DataFrame) -> DataFrame:
    """The newest state of each scan: last writer by id. In a stream this is an update-mode
    aggregate whose state is one row for each scan."""
    return events.groupBy("scan_id").agg(F.max_by("event_type", "event_id").alias("phase"), F.max("event_id").alias("last_event"), F.count("*").alias("n"))


def read_log(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    """The log as a stream; nothing is dropped when readers are slow."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Appends a stream of events to the log, exactly once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_progress(events: DataFrame, sink, checkpoint: str):
    """Passes each micro-batch of changed states to sink(frame, batch id)."""
    return progress(events).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type in windows of event time; late ones count until the watermark passes."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def _depth(state: str) -> int:
    """How many transitions may follow a state; the states have no cycle."""
    return max((1 + _depth(s) for s in TRANSITIONS[state]), default=0)


def checked_transitions(requests: DataFrame) -> DataFrame:
    """State requests (scan_id, event_id, state) with the state each leaves its scan in and whether it
    was allowed; a scan begins pending.

    A scan takes few transitions however many requests it has, so each is the least event after the
    one before that asks for a state that may follow: an aggregate, not a walk over the scan."""
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>"))])
    taken = requests.select("scan_id").distinct().withColumns({"now": F.lit("pending"), "last": F.lit(None).cast("bigint"), "log": F.array().cast("array<struct<event_id:bigint,state:string>>")})
    for _ in range(_depth("pending")):
        after = requests.join(taken.select("scan_id", "now", "last"), "scan_id").where((F.col("last").isNull() | (F.col("event_id") > F.col("last"))) & F.array_contains(allowed[F.col("now")], F.col("state")))
        step = after.groupBy("scan_id").agg(F.min(F.struct(F.col("event_id").cast("bigint").alias("event_id"), "state")).alias("step"))
        taken = taken.join(step, "scan_id", "left").select(
            "scan_id",
            F.coalesce("step.state", "now").alias("now"),
            F.coalesce("step.event_id", "last").alias("last"),
            F.when(F.col("step").isNotNull(), F.array_append("log", F.col("step"))).otherwise(F.col("log")).alias("log"),
        )
    before = F.filter("log", lambda x: x["event_id"] <= F.col("event_id"))
    out = requests.join(taken.select("scan_id", "log"), "scan_id")
    state = F.coalesce(F.try_element_at(before, F.lit(-1))["state"], F.lit("pending"))
    return out.select("scan_id", "event_id", state.alias("state"), F.exists("log", lambda x: x["event_id"] == F.col("event_id")).alias("accepted"))
