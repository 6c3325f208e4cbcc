"""Each scan's feed of events: numbered, up to the event that ends it, closed when it has been idle.

As a stream it is a stateful operator with a timer for each scan; as a batch the same rows come from
windows. Events of a scan come in the order of their times and ids. One that comes again, or behind a
later one of its scan, is not passed on: so a restart from a checkpoint repeats nothing."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

FEED = "scan_id long, feed long, n long, event_id long, event_type string, kind string, ts timestamp"
PASSED = "scan_id long, feed long, n long, event_id long, event_type string, kind string, us long"
STATE = "feed long, n long, last long, last_id long, ended boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Feed(StatefulProcessor):
    """What is kept of a scan: its feed (named by its first event), how many events it has passed on, the
    last of them, and whether it has ended."""

    def __init__(self, ended: list[str], idle: int):
        self.ended, self.idle = ended, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", STATE)

    def handleInputRows(self, key, rows, timerValues):
        (scan,) = key
        feed, n, last, last_id, over = self.state.get() if self.state.exists() else (None, 0, None, None, False)
        for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
            if last is not None and (r.us, r.event_id) <= (last, last_id):
                continue
            if last is not None and r.us - last > self.idle:
                if not over:
                    yield self._timeout(scan, feed, n, last)
                feed, n, over = None, 0, False
            feed, last, last_id = (r.event_id if feed is None else feed), r.us, r.event_id
            if over:
                continue
            n, over = n + 1, r.event_type in self.ended
            yield Row(scan_id=scan, feed=feed, n=n, event_id=r.event_id, event_type=r.event_type, kind="end" if over else "event", us=r.us)
        if last is not None:
            self.state.update((feed, n, last, last_id, over))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer((last + self.idle) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        (scan,) = key
        if self.state.exists():
            feed, n, last, _, over = self.state.get()
            self.state.clear()
            if not over:
                yield self._timeout(scan, feed, n, last)

    def _timeout(self, scan, feed, n, last):
        return Row(scan_id=scan, feed=feed, n=n + 1, event_id=None, event_type=None, kind="timeout", us=last + self.idle)

    def close(self) -> None:
        pass


def stream(events: DataFrame, ended: list[str], idle: datetime.timedelta, delay: str = "10 minutes") -> DataFrame:
    """The feeds of a stream of events (scan_id, event_id, event_type, ts). A scan's state goes when it has
    been idle; that needs the state store that keeps timers (see ``ROCKSDB``). An event that comes after
    that, though it is older, begins a feed of its own."""
    rows = events.select("scan_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", delay)
    feed = _Feed(ended, idle // datetime.timedelta(microseconds=1))
    out = rows.groupBy("scan_id").transformWithState(statefulProcessor=feed, outputStructType=T.StructType.fromDDL(PASSED), outputMode="Append", timeMode="EventTime")
    return out.select("scan_id", "feed", "n", "event_id", "event_type", "kind", F.timestamp_micros("us").alias("ts"))


def batch(events: DataFrame, ended: list[str], idle: datetime.timedelta) -> DataFrame:
    """The feeds of a whole log. Feeds that a later event of the scan shows to be idle are closed; the last
    one of a scan stays open, unless it has ended."""
    whole = events.select("scan_id", "event_id", "event_type", "ts").dropDuplicates(["scan_id", "event_id", "ts"])
    scan = Window.partitionBy("scan_id").orderBy("ts", "event_id")
    apart: Column = F.coalesce(F.col("ts") - F.lag("ts").over(scan) > F.lit(idle), F.lit(False))
    # a window in a window needs a column between them
    rows = whole.withColumn("_apart", apart)
    rows = rows.withColumn("part", F.count_if(F.col("_apart")).over(scan)).drop("_apart")
    own = Window.partitionBy("scan_id", "part").orderBy("ts", "event_id")
    rows = rows.withColumn("feed", F.first("event_id").over(own)).withColumn("n", F.row_number().over(own).cast("long"))
    last = F.col("event_type").isin(ended)
    rows = rows.withColumn("_before", F.coalesce(F.max(last).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    passed = rows.where(~F.col("_before")).select("scan_id", "feed", "n", "event_id", "event_type", F.when(last, "end").otherwise("event").alias("kind"), "ts")
    feeds = rows.groupBy("scan_id", "part", "feed").agg(F.count("*").alias("n"), F.max("ts").alias("ts"), F.bool_or(last).alias("_ended"))
    newest = F.max("part").over(Window.partitionBy("scan_id"))
    idle_ = feeds.withColumn("_newest", newest).where((F.col("part") < F.col("_newest")) & ~F.col("_ended"))
    closed = idle_.select("scan_id", "feed", (F.col("n") + 1).alias("n"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"), F.lit("timeout").alias("kind"), (F.col("ts") + F.lit(idle)).alias("ts"))
    return passed.unionByName(closed)


def appended(events: DataFrame, cancelled: DataFrame, longest: int = 2000) -> DataFrame:
    """What of a scan's events (scan_id, event_id, message) is appended to its log: nothing from the event on
    at which it was cancelled (scan_id, event_id); messages are cut."""
    at = cancelled.groupBy("scan_id").agg(F.min("event_id").alias("_at"))
    rows = events.join(at, "scan_id", "left").where(F.col("_at").isNull() | (F.col("event_id") < F.col("_at"))).drop("_at")
    return rows.withColumn("message", F.substring("message", 1, longest))
