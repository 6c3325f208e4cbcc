from riskweave.session import table
from riskweave.streaming import events as E


def test_stream_equals_batch(spark, sf, tmp_path):
    log = table(spark, sf, "events").withColumnRenamed("user_id", "scan_id")
    for i in range(3):
        log.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    seen = {}

    def sink(frame, _):
        seen.update({r.scan_id: (r.phase, r.last_event, r.n) for r in frame.collect()})

    stream = E.read_log(spark, str(tmp_path / "log"), log.schema, files_per_batch=1)
    E.write_progress(stream, sink, str(tmp_path / "c1")).awaitTermination()
    assert seen == {r.scan_id: (r.phase, r.last_event, r.n) for r in E.progress(log).collect()}
    E.append_log(stream, str(tmp_path / "copy"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "copy")).count() == log.count()


def test_pages_follow_ids(spark, sf):
    log, after, ids = table(spark, sf, "events"), -1, []
    while rows := E.page(log, after, 300).collect():
        ids += [r.event_id for r in rows]
        after = ids[-1]
    assert ids == sorted(r.event_id for r in log.collect())


def test_transitions(spark):
    rows = [(1, 1, "running"), (1, 2, "completed"), (1, 3, "running"), (2, 1, "completed"), (2, 2, "cancelled")]
    got = {(r.scan_id, r.event_id): (r.state, r.accepted) for r in E.checked_transitions(spark.createDataFrame(rows, "scan_id int, event_id long, state string")).collect()}
    assert got == {(1, 1): ("running", True), (1, 2): ("completed", True), (1, 3): ("completed", False), (2, 1): ("pending", False), (2, 2): ("cancelled", True)}


def test_windows_with_watermark(spark, sf):
    out = E.rates(table(spark, sf, "events"))
    assert out.agg({"n": "sum"}).first()[0] == table(spark, sf, "events").count()
