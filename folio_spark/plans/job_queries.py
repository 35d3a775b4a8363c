"""Queries over runs, jobs and logs. Orders stand in for jobs, events for log events."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio_spark.functions import text as X
from folio_spark.operators import jobs, logs
from folio_spark.session import table


def job_rows(spark, root):
    """Orders as jobs: O waits, P runs, F is finished; a third of the finished failed."""
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("completed")
    done = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("o_orderkey").cast("int") % 50)
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("job_id"), state.alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("queued_at"), F.when(F.col("o_orderstatus") == "F", done).alias("completed_at"),
    )


def log_rows(spark, root):
    """Events as log events: errors are errors, purchases warnings, the rest information."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warn").otherwise("info")
    message = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" token="), F.col("event_id").cast("string"), F.lit(" did "), F.col("event_type"))
    job = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("job/"), F.col("user_id").cast("string")))
    return table(spark, root, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").alias("timestamp"), F.lit("pipeline").alias("source"), level.alias("level"), message.alias("message"),
        F.lit("app::stage").alias("target"), job.alias("job_id"), F.col("event_type").alias("stage"), F.col("props").alias("fields"),
    )


def _history(spark, root):
    """Jobs with what they carry themselves: every finished one an output, failed ones an error."""
    own = F.when(F.col("status") == "completed", F.concat(F.lit("own "), F.col("job_id").cast("string")))
    return job_rows(spark, root).select("job_id", "status", F.when(F.col("status") == "failed", "bad input").alias("error"), own.alias("output"))


def _history_outputs(spark, root):
    """Output files of the completed jobs whose customer's balance is not negative."""
    paid = table(spark, root, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    done = table(spark, root, "orders").where("o_orderstatus = 'F' AND o_orderkey % 3 <> 0").join(paid, "o_custkey", "left_semi")
    return done.select(F.col("o_orderkey").alias("job_id"), F.concat(F.lit("file "), F.col("o_orderkey").cast("string")).alias("output"))


def _progress(spark, root):
    """A progress line for every page, and a line that is none."""
    pages = table(spark, root, "pages")
    at = F.concat(F.lit("[2/3] vision "), (F.col("pos") + 1).cast("string"), F.lit("/"), (F.col("pos") + 5).cast("string"), F.lit(" "), (F.col("pos") % 100).cast("string"), F.lit("% Reading "), F.coalesce("doc_title", F.lit("")))
    return pages.select("page_id", at.alias("line")).unionByName(pages.select("page_id", F.lit("vision: 4/10").alias("line")))


def _secret_fields():
    """Fields with secrets at several depths: in members of secret names, after words that announce them, and bare."""
    return F.concat(F.lit('{"event":'), F.col("seq").cast("string"), F.lit(',"by":{"api-key":{"id":7},"note":"password: hunter2 ok"},"all":["xoxb-kept","xoxb-'), F.lpad(F.col("seq").cast("string"), 14, "0"), F.lit('"]}'))


QUERIES = {
    "runs_newest": lambda s, r: jobs.newest_first(table(s, r, "runs"), 20),
    "run_totals": lambda s, r: jobs.totals(table(s, r, "runs")),
    "run_inputs": lambda s, r: table(s, r, "runs").groupBy(F.regexp_extract("input_path", r"\.([^./]+)$", 1).alias("kind")).agg(F.count("*").alias("runs"), F.sum("page_count").alias("pages"), F.max("duration_ms").alias("longest_ms")),
    "queue_order": lambda s, r: jobs.queue_order(job_rows(s, r)).select("job_id", "queued_at"),
    "queue_places": lambda s, r: jobs.queue_places(job_rows(s, r)).select("job_id", "queued_at", "place"),
    "job_statuses": lambda s, r: jobs.statuses(job_rows(s, r)).select("job_id", "status"),
    "job_status_totals": lambda s, r: jobs.totals(job_rows(s, r)),
    "new_jobs": lambda s, r: jobs.new_jobs(job_rows(s, r), job_rows(s, r).where("job_id % 10 <> 0")).select("job_id", "status"),
    "history_repaired": lambda s, r: jobs.repaired(_history(s, r), _history_outputs(s, r)).select("job_id", "status", "error", "output", "migrate"),
    "progress_lines": lambda s, r: jobs.progress_lines(_progress(s, r)).drop("line"),
    "run_manifest": lambda s, r: jobs.run_manifest(table(s, r, "runs")).select("backend", F.col("totals")["completed"].alias("completed"), "runs", "pages", "wall_clock_ms"),
    "shown_durations": lambda s, r: table(s, r, "runs").select("duration_ms", jobs.shown_duration(F.col("duration_ms")).alias("shown")).distinct(),
    "job_durations": lambda s, r: job_rows(s, r).where("completed_at IS NOT NULL").select("job_id", jobs.duration_ms("created_at", "completed_at").alias("ms")),
    "log_levels": lambda s, r: log_rows(s, r).groupBy("level", "stage").agg(F.count("*").alias("events")),
    "log_filter": lambda s, r: log_rows(s, r).where(logs.matches(level="error", job="job/1", text="did ERROR")).select("seq", "level", "job_id"),
    "log_redact": lambda s, r: logs.redacted(log_rows(s, r)).select("seq", "message"),
    "log_redact_fields": lambda s, r: logs.redacted(log_rows(s, r).select("seq", _secret_fields().alias("fields"))).select("seq", "fields"),
    "log_by_job": lambda s, r: logs.routed(log_rows(s, r)).groupBy("base_name").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq")),
    "log_ring": lambda s, r: logs.ring(log_rows(s, r)).select("seq", "level"),
    "log_retention": lambda s, r: logs.within_days(log_rows(s, r), "2024-01-15 00:00:00", 7).groupBy("level").agg(F.count("*").alias("events")),
    "entity_names": lambda s, r: table(s, r, "part").select("p_partkey", X.normalize_entity(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("entity"), X.yaml_scalar("p_name").alias("quoted")),
}
_JOBS = """SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, o_orderdate AS created_at,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 1 HOUR END AS queued_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_minutes(CAST(o_orderkey % 50 AS INTEGER)) END AS completed_at FROM orders"""
_LOGS = """SELECT event_id AS seq, ts AS timestamp, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' ELSE 'info' END AS level,
 'user ' || user_id || ' token=' || event_id || ' did ' || event_type AS message, CASE WHEN user_id % 5 <> 0 THEN 'job/' || user_id END AS job_id, event_type AS stage FROM events"""
_TOTALS = ", ".join(f"count(*) FILTER (status = '{k}') AS {k}" for k in ("completed", "failed", "canceled", "cached", "unsupported")) + ", count(*) FILTER (status NOT IN ('completed', 'failed', 'canceled', 'cached', 'unsupported')) AS live"
SQL = {
    "runs_newest": "SELECT * FROM (SELECT DISTINCT run_id, run_ts, input_path, status FROM runs) ORDER BY run_ts DESC, run_id, status, input_path LIMIT 20",
    "run_totals": f"SELECT {_TOTALS} FROM runs",
    "run_inputs": "SELECT regexp_extract(input_path, '\\.([^./]+)$', 1) AS kind, count(*) AS runs, CAST(sum(page_count) AS BIGINT) AS pages, max(duration_ms) AS longest_ms FROM runs GROUP BY 1",
    "queue_order": f"SELECT job_id, queued_at FROM ({_JOBS}) WHERE status = 'queued' ORDER BY coalesce(queued_at, created_at), created_at, job_id",
    "queue_places": f"SELECT job_id, queued_at, CAST(row_number() OVER (ORDER BY coalesce(queued_at, created_at), created_at, job_id) AS INTEGER) AS place FROM ({_JOBS}) WHERE status = 'queued'",
    "job_statuses": f"SELECT job_id, status FROM ({_JOBS}) WHERE status NOT IN ('completed', 'failed', 'canceled') UNION ALL SELECT job_id, status FROM (SELECT * FROM ({_JOBS}) WHERE status IN ('completed', 'failed', 'canceled') ORDER BY completed_at DESC, job_id LIMIT 5)",
    "job_status_totals": f"SELECT {_TOTALS} FROM ({_JOBS})",
    "new_jobs": f"SELECT job_id, status FROM ({_JOBS}) WHERE job_id % 10 = 0",
    "history_repaired": f"""SELECT j.job_id, CASE j.status WHEN 'processing' THEN 'canceled' ELSE j.status END AS status, CASE j.status WHEN 'processing' THEN '{jobs.CLOSED}' WHEN 'failed' THEN 'bad input' END AS error,
 CASE WHEN j.status = 'completed' THEN CASE WHEN c_acctbal >= 0 THEN 'file ' || job_id ELSE 'own ' || job_id END END AS output, coalesce(j.status = 'completed' AND NOT coalesce(c_acctbal >= 0, false), false) AS migrate
 FROM ({_JOBS}) j JOIN orders o ON o.o_orderkey = j.job_id LEFT JOIN customer c ON c.c_custkey = o.o_custkey""",
    "progress_lines": "SELECT page_id, 2 AS stage_index, 3 AS total_stages, 'vision' AS stage, pos + 1 AS page, pos + 5 AS total_pages, pos % 100 AS progress, 'Reading ' || coalesce(doc_title, '') AS message FROM pages",
    "run_manifest": "SELECT backend, nullif(count(*) FILTER (status = 'completed'), 0) AS completed, count(*) AS runs, CAST(sum(page_count) AS BIGINT) AS pages, epoch_ms(max(run_ts + to_milliseconds(coalesce(duration_ms, 0)))) - epoch_ms(min(run_ts)) AS wall_clock_ms FROM runs GROUP BY backend",
    "shown_durations": """SELECT DISTINCT duration_ms, CASE WHEN duration_ms < 1000 THEN duration_ms || ' ms' WHEN duration_ms < 60000 THEN printf('%.1f s', duration_ms / 1000) WHEN duration_ms < 3600000 THEN printf('%dm %02ds', duration_ms // 60000, duration_ms // 1000 % 60)
 ELSE printf('%dh %02dm', duration_ms // 3600000, duration_ms // 60000 % 60) END AS shown FROM runs""",
    "job_durations": f"SELECT job_id, greatest(0, epoch_ms(completed_at) - epoch_ms(created_at)) AS ms FROM ({_JOBS}) WHERE completed_at IS NOT NULL",
    "log_levels": f"SELECT level, stage, count(*) AS events FROM ({_LOGS}) GROUP BY level, stage",
    "log_filter": f"SELECT seq, level, job_id FROM ({_LOGS}) WHERE level = 'error' AND contains(job_id, 'job/1') AND contains(lower(message), 'did error')",
    "log_redact": f"SELECT seq, regexp_replace(message, 'token=[0-9]+', 'token=[REDACTED]') AS message FROM ({_LOGS})",
    "log_redact_fields": """SELECT seq, '{"event":' || seq || ',"by":{"api-key":"[REDACTED]","note":"password: [REDACTED] ok"},"all":["xoxb-kept","[REDACTED]"]}' AS fields FROM (SELECT event_id AS seq FROM events)""",
    "log_by_job": f"SELECT coalesce(replace(job_id, '/', '-'), 'app') AS base_name, count(*) AS events, max(seq) AS last_seq FROM ({_LOGS}) GROUP BY 1",
    "log_ring": f"SELECT seq, level FROM ({_LOGS}) ORDER BY seq DESC LIMIT 2000",
    "log_retention": f"SELECT level, count(*) AS events FROM ({_LOGS}) WHERE timestamp >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 7 DAY GROUP BY level",
    "entity_names": "SELECT p_partkey, lower(trim(p_name)) AS entity, '\"' || p_name || '\"' AS quoted FROM part",
}
