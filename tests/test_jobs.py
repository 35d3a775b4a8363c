from pyspark.sql import functions as F

from folio_spark.operators import jobs, logs


def test_history_is_repaired(spark):
    rows = [("a", "processing", None, "x", 1), ("b", "completed", None, None, 2), ("c", "completed", None, "own", 3), ("d", "failed", "bad", "y", 4), ("e", "completed", None, None, 5)]
    outputs = spark.createDataFrame([("b", "file"), ("b", "file"), ("d", "file")], "job_id string, output string")
    got = {r.job_id: (r.status, r.error, r.output, r.migrate, r.n) for r in jobs.repaired(spark.createDataFrame(rows, "job_id string, status string, error string, output string, n int"), outputs).collect()}
    assert got == {"a": ("canceled", jobs.CLOSED, None, False, 1), "b": ("completed", None, "file", False, 2), "c": ("completed", None, "own", True, 3), "d": ("failed", "bad", None, False, 4), "e": ("completed", None, None, False, 5)}


def test_progress_lines(spark):
    rows = spark.createDataFrame([("[2/3] vision 4/10 57% Reading page",), ("[1/3] extraction 5% ",), ("warning: [1/3]",), (None,)], "line string")
    got = [tuple(r)[1:] for r in jobs.progress_lines(rows).collect()]
    assert got == [(2, 3, "vision", 4, 10, 57, "Reading page"), (1, 3, "extraction", None, None, 5, "")]


def test_durations_and_named_runs(spark):
    rows = spark.createDataFrame([(850,), (12_345,), (245_000,), (7_380_000,), (None,)], "ms bigint")
    assert [r.s for r in rows.select(jobs.shown_duration(F.col("ms")).alias("s")).collect()] == ["850 ms", "12.3 s", "4m 05s", "2h 03m", None]
    assert jobs.named_runs(spark.createDataFrame([("a",), ("b",)], "run_id string"), spark.createDataFrame([("b",), ("b",), ("c",)], "run_id string")).count() == 1


def test_log_files(spark):
    names = {"desktop.jsonl": True, "desktop.7.jsonl": True, "desktop.70000.jsonl": False, "desktop-old.jsonl": True, "job-a_1-b.jsonl": True, "job-a.2.jsonl": True, "job-.jsonl": False, "job-a.b.jsonl": False, "../desktop.jsonl": False, "x\\desktop.jsonl": False, "desktop.json": False, "": False}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.ok for r in rows.select("n", logs.file_name_ok(F.col("n")).alias("ok")).collect()} == names
    content = '{"level":"info","seq":1}\n{"level":"warn","seq":2}\nbroken\n{"level":"error","seq":3}\n'
    files = spark.createDataFrame([("p", content), ("q", "")], "path string, content string")
    assert [r.seq for r in logs.tail_events(files, "level string, seq int").orderBy("line_no").collect()] == [1, 2, 3]
    assert [r.seq for r in logs.tail_events(files, "level string, seq int", most=40).orderBy("line_no").collect()] == [3]


def test_events_are_captured(spark):
    raw = ['{"level":"WARN","target":"t","fields":{"message":"m","job_id":"j","stage":"s","n":1}}', '{"level":"DEBUG","fields":{"message":"x"}}', "no json"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "seq int, raw string")
    got = logs.captured(rows)
    assert [(r.seq, r.level, r.message, r.job_id, r.stage) for r in got.where("seq < 2").collect()] == [(0, "warn", "m", "j", "s")]
    assert logs.captured(rows, least="off").count() == 0 and logs.captured(rows, least="trace").count() == 3
