"""Queries that run the timer streams over the driver's tables, and their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildtrail.operators import logs
from buildtrail.plans.sources import fresh
from buildtrail.plans.stateful import as_stream
from buildtrail.plans.store import chunks
from buildtrail.streaming import operators as st
from buildtrail.streaming import timers

LIVE_S, WIDTH_MS = 21_600, 21_600_000


def events(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("value"))


def with_closing(s, rows):
    """rows (node, seq, ts, ...) as a stream, with a closing row of node -1 ahead of all so that the watermark passes what is due."""
    path = fresh(s)
    rows.write.parquet(path)
    ahead = rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 30 days")).alias("ts"))
    own = {"node": F.lit(-1), "seq": F.lit(-1), "ts": F.col("ts"), "value": F.lit("end"), "gen": F.lit(0), "stream": F.lit(""), "data": F.lit(b"")}
    ahead.select(*[own[f.name].cast(f.dataType).alias(f.name) for f in rows.schema.fields]).write.mode("append").parquet(path)
    return s.readStream.schema(rows.schema).parquet(path)


def read_back(s, stream):
    out = fresh(s)
    st.run_available(stream, out, f"{out}-state")
    return s.read.parquet(out).filter("node <> -1")


def transitions(s, rows):
    return rows.select("node", F.unix_micros("at").alias("at_us"), "state")


def snapshots(rows):
    return rows.select("node", F.unix_micros("until").alias("until_us"), "value")


def outcomes(s, d):
    """Results of each event; a fifth of the users are unknown, and their current gen is the user's id modulo 3."""
    results = events(s, d).select("node", (F.col("seq") % 3).cast("long").alias("gen"), F.col("ts").alias("reported"), "seq")
    nodes = s.read.parquet(f"{d}/events.parquet").filter("user_id % 5 <> 0").select(F.col("user_id").alias("node"), (F.col("user_id") % 3).alias("gen")).distinct()
    out = fresh(s)
    timers.late_results(as_stream(s, results), nodes, out, f"{out}-state")
    return s.read.parquet(f"{out}/results").select("node", "gen", "seq", "outcome")


def timed_chunks(s, d):
    return chunks(s, d).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))


def bytes_of(rows):
    return rows.select("node", "gen", "stream", "offset", F.hex("data").alias("data"))


QUERIES = {
    "stream_transitions": lambda s, d: transitions(s, read_back(s, timers.stream_transitions(with_closing(s, events(s, d)), "node", "ts", LIVE_S))),
    "fleet_transitions": lambda s, d: transitions(s, timers.fleet_transitions(events(s, d), "node", "ts", LIVE_S)),
    "stream_latest": lambda s, d: snapshots(read_back(s, timers.stream_latest(with_closing(s, events(s, d)), "node", "ts", "seq", "value", WIDTH_MS, final=("error",)))),
    "latest_snapshots": lambda s, d: snapshots(timers.latest_snapshots(events(s, d), "node", "ts", "seq", "value", WIDTH_MS, final=("error",))),
    "late_results": outcomes,
    "stream_rechunk": lambda s, d: bytes_of(read_back(s, timers.stream_rechunk(with_closing(s, timed_chunks(s, d)), 1000, 2000))),
    "rechunk_bytes": lambda s, d: bytes_of(logs.rechunk_bytes(chunks(s, d), 1000)),
}

MOVES = f"""
WITH b AS (SELECT DISTINCT user_id AS node, epoch_us(ts) AS us FROM events), n AS (SELECT node, us, coalesce(us - lag(us) OVER w, {LIVE_S}000001) > {LIVE_S}000000 AS first, coalesce(lead(us) OVER w - us, {LIVE_S}000001) > {LIVE_S}000000 AS last FROM b WINDOW w AS (PARTITION BY node ORDER BY us))
SELECT node, us AS at_us, 'live' AS state FROM n WHERE first UNION ALL SELECT node, us + {LIVE_S}000000, 'lost' FROM n WHERE last
"""
LATEST = f"""
WITH e AS (SELECT user_id AS node, epoch_us(ts) AS us, event_id AS seq, event_type AS value FROM events), f AS (SELECT node, min((us, seq)) AS stop FROM e WHERE value = 'error' GROUP BY node)
SELECT e.node, (us // {WIDTH_MS}000 + 1) * {WIDTH_MS}000 AS until_us, arg_max(value, (us, seq)) AS value FROM e LEFT JOIN f ON e.node = f.node WHERE f.stop IS NULL OR (us, seq) <= f.stop GROUP BY e.node, until_us
"""
BYTES = """
WITH c AS (SELECT conv_id AS node, floor(turn / 4)::BIGINT AS gen, role AS stream, string_agg(hex(encode(coalesce(text, ''))), '' ORDER BY turn) AS h FROM conversations GROUP BY ALL)
SELECT node, gen, stream, i * 1000 AS "offset", substring(h, i * 2000 + 1, 2000) AS data FROM (SELECT *, unnest(range(0, (length(h) + 1999) // 2000)) AS i FROM c)
"""

SQL = {
    "stream_transitions": MOVES,
    "fleet_transitions": MOVES,
    "stream_latest": LATEST,
    "latest_snapshots": LATEST,
    "late_results": "SELECT user_id AS node, event_id % 3 AS gen, event_id AS seq, CASE WHEN user_id % 5 = 0 THEN 'unknown' WHEN event_id % 3 <> user_id % 3 THEN 'stale' ELSE 'applied' END AS outcome FROM events",
    "stream_rechunk": BYTES,
    "rechunk_bytes": BYTES,
}
