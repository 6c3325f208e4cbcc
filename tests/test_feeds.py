"""A stream of feeds against the batch, over a restart from its checkpoint."""

import datetime

from riskweave.session import table
from riskweave.streaming import events as E
from riskweave.streaming import feeds as D

IDLE = datetime.timedelta(hours=36)


def test_stream_equals_batch_after_a_restart(spark, sf, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", D.ROCKSDB)
    log = table(spark, sf, "events").withColumnRenamed("user_id", "scan_id").where("scan_id is not null").selectExpr("scan_id", "event_id", "event_type", "cast(ts as timestamp) ts")
    cuts = sorted(log.approxQuantile("event_id", [0.3, 0.6, 0.8], 0.0))
    parts = [log.where(f"event_id > {a} and event_id <= {b}") for a, b in zip([-1, *cuts], [*cuts, 10**9])]
    try:
        for some in (parts[:2], parts[2:]):
            for part in some:
                part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
            stream = E.read_log(spark, str(tmp_path / "log"), log.schema, files_per_batch=1)
            query = D.stream(stream, ["error"], IDLE).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = [tuple(x) for x in spark.read.schema(D.FEED).parquet(str(tmp_path / "out")).collect()]
    want = {tuple(x) for x in D.batch(log, ["error"], IDLE).collect()}
    assert len(got) == len(set(got))
    # the stream also closes feeds that time has shown to be idle, though no event came after them
    newest = {}
    for x in want:
        newest[x[0]] = max(newest.get(x[0], -1), x[1])
    more = set(got) - want
    assert want <= set(got) and all(x[5] == "timeout" and newest[x[0]] == x[1] for x in more)
    assert {x[5] for x in want} == {"event", "end", "timeout"}


def test_cancelled_scans_append_nothing(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 3000), (1, 2, "b"), (1, 3, "c"), (2, 1, None)], "scan_id long, event_id long, message string")
    cancelled = spark.createDataFrame([(1, 3), (1, 2)], "scan_id long, event_id long")
    assert sorted((x.scan_id, x.event_id, len(x.message or "")) for x in D.appended(rows, cancelled).collect()) == [(1, 1, 2000), (2, 1, 0)]
    assert D.batch(spark.createDataFrame([], "scan_id long, event_id long, event_type string, ts timestamp"), ["error"], IDLE).count() == 0
