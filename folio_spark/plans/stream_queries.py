"""Queries that run a stream over the events to its end.

Windows and sessions are appended once the watermark, two hours before the latest event, has passed them, and
their state is dropped; those still open at the end aren't given out. Totals by event type are a few rows, given out complete.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folio_spark.streaming import log_stream as L


def _events(spark, root):
    return L.read(spark, f"{root}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df, *names):
    """Timestamps without zone, as they are stored."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


QUERIES = {
    "stream_window_counts": lambda s, r: _plain(L.drain(L.window_counts(_events(s, r), "ts", ["event_type"]), "counts"), "start"),
    "stream_user_sessions": lambda s, r: _plain(L.drain(L.sessions(_events(s, r), "ts", "user_id"), "sessions"), "start", "end"),
    "stream_event_values": lambda s, r: L.drain(_events(s, r).groupBy("event_type").agg(F.count("*").alias("events"), F.max("value").alias("largest")), "values", "complete"),
}
_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"""
SQL = {
    "stream_window_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
    "stream_user_sessions": _SESSIONS,
    "stream_event_values": "SELECT event_type, count(*) AS events, max(value) AS largest FROM events GROUP BY event_type",
}
