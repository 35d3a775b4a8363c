"""Runs and jobs: catalog, queue and status views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.session import numbered

TERMINAL = ("completed", "failed", "canceled")


def newest_first(runs: DataFrame, n: int) -> DataFrame:
    return runs.select("run_id", "run_ts", "input_path", "status").distinct().orderBy(F.desc("run_ts"), "run_id", "status", "input_path").limit(n)


def queue_order(jobs: DataFrame) -> DataFrame:
    """Waiting jobs in the order they will run: queued (or created) time, created time, id."""
    return jobs.where("status = 'queued'").orderBy(F.coalesce("queued_at", "created_at"), "created_at", "job_id")


def queue_places(jobs: DataFrame) -> DataFrame:
    """Every waiting job with its place (from 1) in the order of ``queue_order``."""
    order = [F.coalesce("queued_at", "created_at"), "created_at", "job_id"]
    return numbered(jobs.where("status = 'queued'"), order, "_at").withColumn("place", (F.col("_at") + 1).cast("int")).drop("_at")


def statuses(jobs: DataFrame, latest: int = 5) -> DataFrame:
    """All live jobs and the latest finished ones."""
    done = jobs.where(F.col("status").isin(*TERMINAL)).orderBy(F.desc("completed_at"), "job_id").limit(latest)
    return jobs.where(~F.col("status").isin(*TERMINAL)).unionByName(done)


def totals(jobs: DataFrame) -> DataFrame:
    """ok, failed, canceled, cached, unsupported and live counts."""
    s = F.col("status")
    return jobs.agg(*[F.count_if(s == k).alias(k) for k in ("completed", "failed", "canceled", "cached", "unsupported")], F.count_if(~s.isin(*TERMINAL, "cached", "unsupported")).alias("live"))


def new_jobs(history: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Jobs that the snapshot of earlier ids doesn't have."""
    return history.join(snapshot.select("job_id").distinct(), "job_id", "left_anti")


def duration_ms(started: str, ended: str) -> Column:
    return F.greatest(F.lit(0), (F.unix_millis(F.col(ended).cast("timestamp")) - F.unix_millis(F.col(started).cast("timestamp"))))


def state_from_events(events: DataFrame) -> DataFrame:
    """job_id, status: the last state of each job in its event log (job_id, seq, state)."""
    return events.groupBy("job_id").agg(F.max_by("state", "seq").alias("status"))


#: Fixed value: what a job says that was running when its application ended.
CLOSED = "App closed before processing completed."


def repaired(history: DataFrame, outputs: DataFrame) -> DataFrame:
    """The history as it is after a restart: jobs that were running are canceled with an error, and only
    completed ones have an output: that of ``outputs`` (job_id, output) or else the one they carry. ``migrate`` marks
    completed jobs whose own output must be written out.
    """
    kept = outputs.groupBy("job_id").agg(F.max("output").alias("_file"))
    rows = history.join(kept, "job_id", "left")
    running, done = F.col("status") == "processing", F.col("status") == "completed"
    return rows.select(
        *[F.col(c) for c in history.columns if c not in ("status", "error", "output")],
        F.when(running, "canceled").otherwise(F.col("status")).alias("status"), F.when(running, CLOSED).otherwise(F.col("error")).alias("error"),
        F.when(done, F.coalesce("_file", "output")).alias("output"), (done & F.col("_file").isNull() & F.col("output").isNotNull()).alias("migrate"),
    )


#: Fixed value: the shape of a progress line.
PROGRESS = r"^\[(\d+)/(\d+)\]\s+(\w+)(?:\s+(\d+)/(\d+))?\s+(\d+)%\s+(.*)$"


def progress_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The columns of ``lines`` with stage_index, total_stages, stage, page, total_pages, progress, message of progress lines; others are left out."""
    def part(k: int, number: bool = True) -> Column:
        found = F.regexp_extract(line, PROGRESS, k)
        return F.nullif(found, F.lit("")).cast("int") if number else found

    names = (("stage_index", 1, True), ("total_stages", 2, True), ("stage", 3, False), ("page", 4, True), ("total_pages", 5, True), ("progress", 6, True), ("message", 7, False))
    return lines.where(F.col(line).rlike(PROGRESS)).select("*", *[part(k, n).alias(name) for name, k, n in names])


def run_manifest(runs: DataFrame) -> DataFrame:
    """One row for each batch of runs by ``backend``: totals by status, pages, and the time from the first start to the last end."""
    ended = F.col("run_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce("duration_ms", F.lit(0)) / 1000)
    status = F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))
    by = runs.groupBy("backend", F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"), F.sum("page_count").alias("pages"), F.min("run_ts").alias("began"), F.max(ended).alias("ended"))
    return by.groupBy("backend").agg(status.alias("totals"), F.sum("n").alias("runs"), F.sum("pages").alias("pages"), (F.unix_millis(F.max("ended").cast("timestamp")) - F.unix_millis(F.min("began").cast("timestamp"))).alias("wall_clock_ms"))


def named_runs(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The runs whose id is wanted (run_id)."""
    return runs.join(wanted.select("run_id").distinct(), "run_id", "left_semi")


def shown_duration(ms: Column) -> Column:
    """Milliseconds as people read them: 850 ms, 12.3 s, 4m 05s, 2h 03m."""
    seconds = F.floor(ms / 1000)
    return (
        F.when(ms.isNull(), None).when(ms < 1000, F.format_string("%d ms", ms.cast("bigint"))).when(ms < 60_000, F.format_string("%.1f s", ms / 1000))
        .when(ms < 3_600_000, F.format_string("%dm %02ds", F.floor(seconds / 60), seconds % 60)).otherwise(F.format_string("%dh %02dm", F.floor(seconds / 3600), F.floor(seconds / 60) % 60))
    )
