import os

from folio_spark.operators import logs
from folio_spark.streaming import log_stream as L


def test_streams_equal_batches_and_resume(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "seq bigint, timestamp timestamp, source string, level string, message string, target string, job_id string, stage string, fields string"
    rows = [(i, None, "app", "info", f"token=abc{i} done", "t", "job/1" if i % 2 else None, "s", "{}") for i in range(20)]
    spark.createDataFrame(rows, schema).selectExpr("* except(timestamp)", "timestamp_seconds(1700000000 + seq * 60) AS timestamp").write.parquet(path)
    counted = L.drain(L.window_counts(L.read(spark, path), "timestamp", ["level"], "10 minutes"), "t", "complete")
    assert sum(r.events for r in counted.collect()) == 20
    out = str(tmp_path / "logs")
    L.hub(L.read(spark, path), out).awaitTermination()
    L.hub(L.read(spark, path), out).awaitTermination()
    written = spark.read.json(out)
    assert written.count() == 20 and {r.base_name for r in written.select("base_name").distinct().collect()} == {"job-1", "app"}
    assert written.where("message LIKE '%abc%'").count() == 0
    keyed = L.read(spark, path).selectExpr("job_id AS key", "timestamp").where("key IS NOT NULL")
    assert L.drain(L.distinct_work(keyed, "timestamp"), "d").count() == 1


def test_windows_close_and_late_events_are_left_out(spark, tmp_path):
    """The second file lets the watermark pass the first hours, which holds from the batch after the next; an event of the last file that belongs there comes too late."""
    for k, hours in enumerate([[0, 0, 1], [5, 9], [9], [0, 9]]):
        rows = [(f"2030-01-01 {h:02}:10:00", "a") for h in hours]
        spark.createDataFrame(rows, "t string, kind string").selectExpr("cast(t AS timestamp) AS t", "kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for path in (tmp_path / "in").glob("*.parquet"):
            if path.stat().st_mtime > 1e9:
                os.utime(path, (1000 + 10 * k, 1000 + 10 * k))
    stream = L.read(spark, str(tmp_path / "in"), files_per_trigger=1)
    got = {(r.start.hour, r.events) for r in L.drain(L.window_counts(stream, "t", ["kind"]), "late").collect()}
    assert got == {(0, 2), (1, 1), (5, 1)}


def test_filter_and_ring(spark):
    df = spark.createDataFrame([(i, "error" if i % 2 else "info", "Msg", "t", None, "s", None, "app") for i in range(6)], "seq bigint, level string, message string, target string, job_id string, stage string, fields string, source string")
    assert df.where(logs.matches(level="error", text="msg")).count() == 3 and df.where(logs.matches(job="x")).count() == 0
    assert [r.seq for r in logs.ring(df, 2).collect()] == [5, 4]
