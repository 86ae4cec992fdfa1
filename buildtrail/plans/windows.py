"""Batch twins of the streaming operators over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildtrail.streaming import operators as st


def events(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def hours(c):
    return F.unix_seconds(c)


def jobs(s, d):
    return events(s, d).filter("event_type = 'signup'").select("node", F.lit(1).alias("gen"), F.col("ts").alias("enqueued"))


def results(s, d):
    return events(s, d).filter("event_type = 'purchase'").select("node", F.lit(1).alias("gen"), F.col("ts").alias("reported"))


QUERIES = {
    "stream_snapshots": lambda s, d: st.stream_snapshots(events(s, d), "node", "ts", ["seq"], "event_type", width="1 hour").select(hours("until").alias("until"), "node", "event_type"),
    "stream_usage": lambda s, d: st.stream_usage(events(s, d), "node", "ts", "value", "2 hours", "1 hour").select(hours("since").alias("since"), "node", F.round("grown", 6).alias("grown"), "beats"),
    "debounce": lambda s, d: st.debounce(events(s, d), "node", "ts", ["seq"], "1 day").select("node", "seq"),
    "stream_fleet": lambda s, d: st.stream_fleet(events(s, d), "node", "ts", "6 hours").select("node", F.unix_micros("since").alias("since"), F.unix_micros("until").alias("until"), "beats"),
    "unanswered_jobs": lambda s, d: st.unanswered_jobs(jobs(s, d), results(s, d), "12 hours").select("node", F.unix_micros("enqueued").alias("enqueued")),
}

SQL = {
    "stream_snapshots": "SELECT (floor(epoch(ts) / 3600)::BIGINT + 1) * 3600 AS until, user_id AS node, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1, 2",
    "stream_usage": "WITH w AS (SELECT user_id AS node, value, unnest([floor(epoch(ts) / 3600)::BIGINT * 3600, floor(epoch(ts) / 3600)::BIGINT * 3600 - 3600]) AS since FROM events) SELECT since, node, round(max(value) - min(value), 6) AS grown, count(*) AS beats FROM w GROUP BY since, node",
    "debounce": "SELECT user_id AS node, arg_min(event_id, (ts, event_id)) AS seq FROM events GROUP BY user_id, floor(epoch(ts) / 86400)",
    "stream_fleet": "WITH o AS (SELECT user_id AS node, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY node ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT node, min(us) AS since, max(us) + 21600000000 AS until, count(*) AS beats FROM g GROUP BY node, g",
    "unanswered_jobs": "SELECT user_id AS node, epoch_us(ts) AS enqueued FROM events a WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 43200000000)",
}
