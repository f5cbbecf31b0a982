"""Queries of the streaming extension, run to the end over a table's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.plans import cohort as C
from cohortlens.plans.registry import query
from cohortlens.sources.files import scratch
from cohortlens.streaming import running

LAST = "SELECT * FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, event_type, count(*) AS n, sum(value) AS total, (SELECT max(ts) FROM events) AS last FROM events GROUP BY ALL)"


@query("ST1_stream_windows", f"SELECT epoch(d)::BIGINT AS window_start, event_type, n, total FROM ({LAST}) WHERE d + INTERVAL 1 DAY <= last - INTERVAL 1 DAY", "total")
def st1(spark, sf):
    """Daily totals by type; windows that the watermark has not closed stay open."""
    stream = running.event_stream(spark, sf, C.table(spark, sf, "events").schema)
    running.drain(running.windowed_totals(stream), path := scratch(spark, "stream"), scratch(spark, "state"))
    return spark.read.parquet(path).select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", "total")


@query("ST2_stream_sessions", """WITH g AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events))
    SELECT user_id, floor(epoch(min(ts)))::BIGINT AS session_start, count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def st2(spark, sf):
    """Events of one user less than six hours apart, once the watermark has passed their end."""
    stream = running.event_stream(spark, sf, C.table(spark, sf, "events").schema)
    running.drain(running.sessions(stream, "6 hours"), path := scratch(spark, "sessions"), scratch(spark, "state"))
    return spark.read.parquet(path).select("user_id", F.unix_timestamp("session_start").alias("session_start"), "n")
