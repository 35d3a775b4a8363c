"""Log events: filtering, redaction, routing by job, and the latest of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.functions.text import log_base_name, redact, redact_fields


def matches(level: str | None = None, source: str | None = None, job: str | None = None, text: str | None = None) -> Column:
    """Filter: equal level and source, parts of the job id, and parts of message, target, stage, job or fields."""
    out = F.lit(True)
    if level:
        out &= F.col("level") == level
    if source:
        out &= F.col("source") == source
    if job:
        out &= F.contains(F.lower("job_id"), F.lit(job.lower()))
    if text:
        out &= F.contains(F.lower(F.concat_ws(" ", "message", "target", "stage", "job_id", "fields")), F.lit(text.lower()))
    return F.coalesce(out, F.lit(False))


def redacted(logs: DataFrame) -> DataFrame:
    """Log events without secrets in message, target, file and, at any depth, fields; only those that are there."""
    plain = {c: redact(c) for c in ("message", "target", "file") if c in logs.columns}
    return logs.withColumns(plain | ({"fields": redact_fields("fields")} if "fields" in logs.columns else {}))


def routed(logs: DataFrame) -> DataFrame:
    """Events with the base name of the file they go to: their job's, else ``app``."""
    return logs.withColumn("base_name", log_base_name("job_id"))


def ring(logs: DataFrame, n: int = 2000) -> DataFrame:
    """The last ``n`` events by sequence number."""
    return logs.orderBy(F.desc("seq")).limit(n)


def within_days(logs: DataFrame, now: str, days: int) -> DataFrame:
    """Events not older than ``days`` before ``now``."""
    return logs.where(F.col("timestamp") >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days)))


def captured(events: DataFrame, raw: str = "raw", least: str = "info") -> DataFrame:
    """Log events of JSON records: job id and stage lifted out of the fields, records below the ``least`` level left out; ``off`` leaves out all."""
    levels = ("trace", "debug", "info", "warn", "error")
    if least == "off":
        return captured(events, raw, "error").limit(0)
    level = F.lower(F.coalesce(F.get_json_object(raw, "$.level"), F.lit("info")))
    names = {"timestamp": "$.timestamp", "target": "$.target", "message": "$.fields.message", "job_id": "$.fields.job_id", "stage": "$.fields.stage", "fields": "$.fields"}
    rows = events.select(*[c for c in events.columns if c != raw], level.alias("level"), *[F.get_json_object(raw, p).alias(n) for n, p in names.items()])
    return rows.where(F.col("level").isin(*levels[levels.index(least) :]))


def file_name_ok(name: Column) -> Column:
    """Whether a log file may be asked for by this name: no path, and one of the shapes that are written (rotation numbers up to 65,535)."""
    stem = F.regexp_replace(name, r"(\.jsonl)+$", "")
    def rotation(prefix: str) -> Column:
        number = F.regexp_extract(stem, rf"^{prefix}\.(\d{{1,5}})$", 1)
        return (number != "") & (F.nullif(number, F.lit("")).cast("int") <= 65_535)

    shaped = (stem == "desktop") | stem.startswith("desktop-") | rotation("desktop") | stem.rlike(r"^job-[A-Za-z0-9_-]+$") | rotation("job-[A-Za-z0-9_-]+")
    return F.coalesce(name.endswith(".jsonl") & ~name.rlike(r"[/\\]") & shaped, F.lit(False))


def tail(text: Column, most: int = 1_048_576) -> Column:
    """The lines in the last ``most`` bytes of a file's content, without the broken line that the window begins with."""
    raw = F.encode(text, "UTF-8")
    cut = F.decode(F.substring(raw, -most, most), "UTF-8")
    whole = F.when(F.octet_length(text) > most, F.when(F.contains(cut, F.lit("\n")), F.regexp_replace(cut, r"^[^\n]*\n", "")).otherwise(cut)).otherwise(text)
    return F.filter(F.split(whole, "\n"), lambda x: x != "")


def tail_events(files: DataFrame, schema: str, most: int = 1_048_576) -> DataFrame:
    """Events at the end of log files (path, content): one row for each line of the window that is JSON of the schema; others are left out."""
    lines = files.select("path", F.posexplode(tail(F.col("content"), most)).alias("line_no", "line"))
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    return lines.withColumn("event", parsed).where("event IS NOT NULL AND line RLIKE '^\\\\s*[{]'").select("path", "line_no", "event.*")
