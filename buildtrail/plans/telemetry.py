"""Queries of ``operators.telemetry``: lineitem rows are attempts, events rows are events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildtrail.operators import telemetry as t

EVENTS_SQL = """ev AS (SELECT user_id % 10 AS emitter, user_id AS boot, event_id AS seq, user_id AS node, ts, value, props,
  CASE event_type WHEN 'signup' THEN 'exec.started' WHEN 'view' THEN 'exec.phase' WHEN 'click' THEN 'exec.heartbeat' WHEN 'purchase' THEN 'exec.finished' ELSE 'node.failed' END AS type FROM events)"""
CLASS_SQL = "CASE WHEN l_returnflag = 'N' THEN 'ok' WHEN l_returnflag = 'R' THEN 'retryable' WHEN l_linestatus = 'O' THEN 'control' WHEN l_tax < 0.03 THEN 'cancelled' ELSE 'hard' END"
ATTEMPTS_SQL = f"""al AS (SELECT l_orderkey AS node, l_linenumber AS gen, l_suppkey AS runner, l_partkey AS part, {CLASS_SQL} AS class, l_extendedprice AS wall, l_quantity AS cpu, l_shipdate AS arrival, l_returnflag AS kind FROM lineitem),
att AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY node, gen ORDER BY arrival, part, runner, wall) = 1)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "exec.started").when(F.col("event_type") == "view", "exec.phase").when(F.col("event_type") == "click", "exec.heartbeat").when(F.col("event_type") == "purchase", "exec.finished").otherwise("node.failed")
    return spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 10).alias("emitter"), F.col("user_id").alias("boot"), F.col("event_id").alias("seq"), F.col("user_id").alias("node"), "ts", "value", "props", kind.alias("type"))


def beats(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    data = F.to_json(F.struct(F.concat(F.lit("p"), F.col("node") % 4).alias("phase"), F.floor("value").cast("long").alias("cpu_ms"), F.when(k % 3 > 0, k).alias("mem_bytes"), F.when(k % 2 > 0, k * 2).alias("mem_peak_bytes")))
    return events(spark, sf).select("node", "seq", "type", F.when(F.col("seq") % 11 > 0, data).alias("data"))


def all_attempts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "ok").when(F.col("l_returnflag") == "R", "retryable").when(F.col("l_linestatus") == "O", "control").when(F.col("l_tax") < 0.03, "cancelled").otherwise("hard")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("gen"), F.col("l_suppkey").alias("runner"), F.col("l_partkey").alias("part"), kind.alias("class"), F.col("l_extendedprice").alias("wall"), F.col("l_quantity").alias("cpu"), F.col("l_shipdate").alias("arrival"), F.col("l_returnflag").alias("kind"))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return t.dedup_attempts(all_attempts(spark, sf), ["part", "runner", "wall"])


def trail(spark, sf):
    return t.retry_trail(attempts(spark, sf))


def newest(spark, sf):
    return t.newest_attempts(trail(spark, sf)).select("node", "gen", "nth", "class", "consec_retry", "consec_control", "disposition", "backoff_ms")


def region_attempts(spark, sf):
    s, n, r = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("supplier", "nation", "region"))
    places = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").alias("runner"), F.col("r_name").alias("platform"))
    return attempts(spark, sf).join(places, "runner")


def job_table(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 7 + 1).cast("int").alias("gen"), F.col("o_orderdate").alias("enqueued"))


def running(spark, sf):
    """Attempts of which a third still run and a quarter haven't begun."""
    n = F.col("node") + F.col("gen")
    return spans(spark, sf).withColumn("finished", F.when(n % 3 > 0, F.col("finished"))).withColumn("started", F.when(n % 4 > 0, F.col("started")))


def spans(spark, sf):
    j = job_table(spark, sf)
    a = attempts(spark, sf).select("node", "gen", "arrival", (F.col("arrival") + F.expr("make_dt_interval(0, 0, 0, cpu)")).alias("finished"))
    return j.join(a, ["node", "gen"]).withColumnRenamed("arrival", "started")


def on_runner(spark, sf):
    return events(spark, sf).withColumn("runner", F.col("seq") % 3)


def runs(spark, sf):
    return t.events_to_attempts(on_runner(spark, sf), ("node", "runner")).filter("attempt is not null")


QUERIES = {
    "newest_attempts": newest,
    "retry_trail": lambda s, d: trail(s, d).select("node", "gen", "class", "consec_retry", "consec_control", "disposition", "backoff_ms"),
    "dedup_events": lambda s, d: t.dedup_first(events(s, d), ["emitter", "boot", "seq"], [F.col("ts")]).select("emitter", "boot", "seq", "type"),
    "dedup_attempts": lambda s, d: attempts(s, d).select("node", "gen", "runner", "class", "wall"),
    "dedup_in_window": lambda s, d: t.dedup_in_window(all_attempts(s, d), 900 * 86400, ["part", "runner", "wall"]).select("node", "gen", "part", "runner"),
    "event_families": lambda s, d: events(s, d).groupBy("node", t.family(F.col("type")).alias("family")).agg(F.count("*").alias("n"), F.max("seq").alias("last")),
    "typed_heartbeats": lambda s, d: t.typed_events(beats(s, d), "exec.heartbeat").select("node", "seq", "phase", "cpu_ms", "mem_bytes", "mem_peak_bytes"),
    "events_of_family": lambda s, d: t.events_of(events(s, d), ["exec.started", "exec.finished"]).select("node", "seq", "type", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "latest_status": lambda s, d: t.latest_status(events(s, d), "node", ["ts", "seq"], ["type", "seq"]),
    "sequence_gaps": lambda s, d: t.sequence_gaps(events(s, d)),
    "progress_deltas": lambda s, d: t.progress_deltas(events(s, d), "value").select("node", "seq", F.round("delta", 6).alias("delta")),
    "phase_durations": lambda s, d: t.phase_durations(events(s, d)),
    "events_to_attempts": lambda s, d: t.events_to_attempts(events(s, d)).select("node", "seq", "type", "attempt"),
    "attempt_usage": lambda s, d: t.attempt_usage(events(s, d).withColumn("mem", F.get_json_object("props", "$.k").cast("long")), "value", "mem"),
    "recordable_failures": lambda s, d: t.recordable_failures(trail(s, d)).select("node", "gen", "class", "disposition"),
    "failure_breakdown": lambda s, d: t.failure_breakdown(trail(s, d), ["class", "disposition"]),
    "usage_rollup": lambda s, d: t.usage_rollup(region_attempts(s, d), ["platform", "kind", "class"], ["wall", "cpu"]),
    "fence_stale": lambda s, d: t.fence_stale(all_attempts(s, d).select("node", "gen", F.struct("arrival", "part", "runner", "wall").alias("arrival")), job_table(s, d).withColumn("phase", F.when(F.col("node") % 3 == 0, "running").when(F.col("node") % 3 == 1, "queued").otherwise("done")).withColumn("last_gen", F.col("node") % 5)).select("node", "gen", "reason"),
    "attempts_join": lambda s, d: t.attempts_join(job_table(s, d), attempts(s, d).withColumnRenamed("arrival", "reported")).select("node", "gen", "class", "state"),
    "attempts": lambda s, d: t.attempts_join(job_table(s, d), attempts(s, d).withColumnRenamed("arrival", "reported"), t.recordable_failures(trail(s, d))).select("node", "gen", "class", "state", "disposition", "backoff_ms", "recorded"),
    "progress_deltas_by_phase": lambda s, d: t.progress_deltas(events(s, d), "value", ("node", "type")).select("node", "type", "seq", F.round("delta", 6).alias("delta")),
    "phase_durations_by_attempt": lambda s, d: t.phase_durations(runs(s, d), ("node", "runner", "attempt")),
    "events_to_attempts_by_runner": lambda s, d: t.events_to_attempts(on_runner(s, d), ("node", "runner")).select("node", "runner", "seq", "type", "attempt"),
    "retention_by_bytes": lambda s, d: t.apply_retention(attempts(s, d).withColumn("size", F.col("part")), F.lit("1998-12-01 00:00:00").cast("timestamp"), 2600, 3, 1_000_000).select("node", "gen"),
    "attempt_timing_now": lambda s, d: t.attempt_timing(running(s, d), F.lit("1995-06-01 12:00:00").cast("timestamp")).select("node", "gen", "queued_us", "ran_us", "elapsed_us"),
    "attempt_timing": lambda s, d: t.attempt_timing(spans(s, d)).select("node", "gen", "queued_us", "ran_us", "elapsed_us"),
    "apply_retention": lambda s, d: t.apply_retention(attempts(s, d).crossJoin(F.broadcast(attempts(s, d).agg(F.max("arrival").alias("top")))), F.col("top"), 400, 2).select("node", "gen"),
    "reported_drops": lambda s, d: events(s, d).filter("type = 'node.failed'").groupBy("emitter", "boot").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("lost")),
}

# DuckDB takes the trail row by row, as a fold over each node's sorted classes.
TRAIL_SQL = ATTEMPTS_SQL + """,
folded AS (SELECT node, list(gen ORDER BY gen) AS gens, list(class ORDER BY gen) AS classes FROM att GROUP BY node),
walk AS (
  WITH RECURSIVE w AS (
    SELECT node, gens, classes, 0 AS i, 0 AS r, 0 AS c, 0 AS rr, 0 AS cc, '' AS disp FROM folded
    UNION ALL
    SELECT node, gens, classes, i + 1,
      CASE WHEN cls = 'retryable' AND r < 3 THEN r + 1 WHEN cls IN ('control', 'cancelled') AND c < 20 THEN r ELSE 0 END,
      CASE WHEN cls IN ('control', 'cancelled') AND c < 20 THEN c + 1 ELSE 0 END,
      CASE WHEN cls = 'retryable' THEN r + 1 WHEN cls IN ('control', 'cancelled') THEN r ELSE 0 END,
      CASE WHEN cls IN ('control', 'cancelled') THEN c + 1 ELSE 0 END,
      CASE WHEN cls = 'ok' THEN 'done' WHEN cls = 'hard' OR (cls = 'retryable' AND r >= 3) OR (cls IN ('control', 'cancelled') AND c >= 20) THEN 'failed' ELSE 'retry' END
    FROM (SELECT *, classes[i + 1] AS cls FROM w WHERE i < len(classes))
  ) SELECT node, gens[i] AS gen, classes[i] AS class, rr AS consec_retry, cc AS consec_control, disp AS disposition,
      CASE WHEN classes[i] = 'retryable' AND disp = 'retry' THEN least(30000, 1000 * (1 << (rr - 1))) ELSE 0 END AS backoff_ms,
      row_number() OVER (PARTITION BY node ORDER BY gens[i] DESC) AS nth FROM w WHERE i > 0)"""
RUNS_SQL = EVENTS_SQL + """, onr AS (SELECT *, seq % 3 AS runner FROM ev), asf AS (SELECT a.*, s.seq AS attempt, EXISTS (SELECT 1 FROM onr f WHERE f.node = a.node AND f.runner = a.runner AND f.type = 'exec.finished' AND (f.ts, f.seq) > (s.ts, s.seq) AND (f.ts, f.seq) < (a.ts, a.seq)) AS over
  FROM onr a LEFT JOIN onr s ON s.node = a.node AND s.runner = a.runner AND s.type = 'exec.started' AND (s.ts, s.seq) <= (a.ts, a.seq)
  QUALIFY row_number() OVER (PARTITION BY a.seq ORDER BY s.ts DESC NULLS LAST, s.seq DESC) = 1),
rn AS (SELECT node, runner, seq, ts, type, CASE WHEN NOT over THEN attempt END AS attempt FROM asf)"""
JOBS_SQL = "job AS (SELECT o_orderkey AS node, o_custkey % 7 + 1 AS gen, o_orderdate AS enqueued FROM orders)"

SQL = {
    "newest_attempts": f"WITH {TRAIL_SQL} SELECT node, gen, nth, class, consec_retry, consec_control, disposition, backoff_ms FROM walk WHERE nth <= 4",
    "retry_trail": f"WITH {TRAIL_SQL} SELECT node, gen, class, consec_retry, consec_control, disposition, backoff_ms FROM walk",
    "dedup_events": f"WITH {EVENTS_SQL} SELECT DISTINCT emitter, boot, seq, type FROM ev",
    "dedup_attempts": f"WITH {ATTEMPTS_SQL} SELECT node, gen, runner, class, wall FROM att",
    "dedup_in_window": f"""WITH {ATTEMPTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY node, gen ORDER BY arrival, part, runner, wall) AS i FROM al),
      nx AS (SELECT a.node, a.gen, a.i, min(b.i) AS nxt FROM o a JOIN o b ON a.node = b.node AND a.gen = b.gen AND epoch(b.arrival) - epoch(a.arrival) > 900 * 86400 GROUP BY ALL),
      kp AS (WITH RECURSIVE k AS (SELECT node, gen, i FROM o WHERE i = 1 UNION ALL SELECT k.node, k.gen, nx.nxt FROM k JOIN nx ON k.node = nx.node AND k.gen = nx.gen AND k.i = nx.i) SELECT * FROM k)
      SELECT o.node, o.gen, o.part, o.runner FROM o JOIN kp ON o.node = kp.node AND o.gen = kp.gen AND o.i = kp.i""",
    "event_families": f"WITH {EVENTS_SQL} SELECT node, CASE WHEN type LIKE 'exec.%' THEN 'exec' WHEN type LIKE 'node.%' OR type LIKE 'request.%' THEN 'server' WHEN type LIKE 'emitter.%' THEN 'meta' END AS family, count(*) AS n, max(seq) AS last FROM ev GROUP BY 1, 2",
    "typed_heartbeats": f"""WITH {EVENTS_SQL}, h AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, seq % 11 > 0 AS there FROM ev WHERE type = 'exec.heartbeat')
SELECT node, seq, CASE WHEN there THEN 'p' || (node % 4) END AS phase, CASE WHEN there THEN floor(value)::BIGINT END AS cpu_ms, CASE WHEN there AND k % 3 > 0 THEN k END AS mem_bytes, CASE WHEN there AND k % 2 > 0 THEN k * 2 END AS mem_peak_bytes FROM h""",
    "events_of_family": f"WITH {EVENTS_SQL} SELECT node, seq, type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM ev WHERE type IN ('exec.started', 'exec.finished')",
    "latest_status": f"WITH {EVENTS_SQL} SELECT node, type, seq FROM ev QUALIFY row_number() OVER (PARTITION BY node ORDER BY ts DESC, seq DESC) = 1",
    "sequence_gaps": f"WITH {EVENTS_SQL} SELECT emitter, boot, p + 1 AS gap_from, seq - 1 AS gap_to, seq - p - 1 AS missing FROM (SELECT *, lag(seq) OVER (PARTITION BY emitter, boot ORDER BY seq) AS p FROM ev) WHERE seq > p + 1",
    "progress_deltas": f"WITH {EVENTS_SQL} SELECT node, seq, round(CASE WHEN p IS NULL OR value < p THEN value ELSE value - p END, 6) AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY node ORDER BY seq) AS p FROM ev)",
    "phase_durations": f"WITH {EVENTS_SQL} SELECT node, type, sum(epoch_us(coalesce(u, ts)) - epoch_us(ts))::BIGINT AS micros, count(*) AS times FROM (SELECT *, lead(ts) OVER (PARTITION BY node ORDER BY ts, seq) AS u FROM ev) GROUP BY node, type",
    "events_to_attempts": f"""WITH {EVENTS_SQL}, x AS (SELECT node, seq, type, last_value(CASE WHEN type = 'exec.started' THEN seq END IGNORE NULLS) OVER (PARTITION BY node ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS a,
      last_value(CASE WHEN type = 'exec.finished' THEN seq END IGNORE NULLS) OVER (PARTITION BY node ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM ev)
      SELECT node, seq, type, CASE WHEN f IS NULL OR f < a THEN a END AS attempt FROM x""",
    "attempt_usage": f"WITH {EVENTS_SQL} SELECT node, arg_max(value, (ts, seq)) FILTER (WHERE value >= 0) AS cpu, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, seq)) AS memory FROM ev GROUP BY node",
    "recordable_failures": f"WITH {TRAIL_SQL} SELECT node, gen, class, disposition FROM walk WHERE class IN ('hard', 'retryable', 'control') OR class = 'cancelled' AND disposition = 'failed'",
    "failure_breakdown": f"WITH {TRAIL_SQL} SELECT class, disposition, count(*) AS attempts, count(DISTINCT node) AS nodes FROM walk GROUP BY class, disposition",
    "usage_rollup": f"""WITH {ATTEMPTS_SQL} SELECT r_name AS platform, kind, class, grouping(r_name, kind, class) AS level, count(*) AS attempts, round(sum(wall), 2) AS wall, round(sum(cpu), 2) AS cpu
      FROM att JOIN supplier ON runner = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, kind, class)""",
    "fence_stale": f"""WITH {ATTEMPTS_SQL}, {JOBS_SQL} SELECT a.node, a.gen, CASE WHEN j.gen IS NULL THEN 'unknown node' WHEN a.gen <> j.gen THEN 'stale' WHEN a.gen <= a.node % 5 THEN 'handled' WHEN a.node % 3 = 2 THEN 'not running'
      WHEN row_number() OVER (PARTITION BY a.node, a.gen ORDER BY arrival, part, runner, wall) > 1 THEN 'handled' END AS reason FROM al a LEFT JOIN job j ON a.node = j.node""",
    "attempts_join": f"WITH {ATTEMPTS_SQL}, {JOBS_SQL} SELECT coalesce(a.node, j.node) AS node, coalesce(a.gen, j.gen) AS gen, class, CASE WHEN class IS NULL THEN 'no result' WHEN enqueued IS NULL THEN 'no job' ELSE 'both' END AS state FROM job j FULL JOIN att a ON a.node = j.node AND a.gen = j.gen",
    "attempts": f"""WITH {TRAIL_SQL}, {JOBS_SQL}, b AS (SELECT coalesce(a.node, j.node) AS node, coalesce(a.gen, j.gen) AS gen, class, CASE WHEN class IS NULL THEN 'no result' WHEN enqueued IS NULL THEN 'no job' ELSE 'both' END AS state FROM job j FULL JOIN att a ON a.node = j.node AND a.gen = j.gen)
      SELECT b.node, b.gen, b.class, state, w.disposition, w.backoff_ms, w.node IS NOT NULL AS recorded FROM b LEFT JOIN walk w ON b.node = w.node AND b.gen = w.gen AND (w.class IN ('hard', 'retryable', 'control') OR w.class = 'cancelled' AND w.disposition = 'failed')""",
    "progress_deltas_by_phase": f"WITH {EVENTS_SQL} SELECT node, type, seq, round(CASE WHEN p IS NULL OR value < p THEN value ELSE value - p END, 6) AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY node, type ORDER BY seq) AS p FROM ev)",
    "events_to_attempts_by_runner": f"WITH {RUNS_SQL} SELECT node, runner, seq, type, attempt FROM rn",
    "phase_durations_by_attempt": f"WITH {RUNS_SQL} SELECT node, runner, attempt, type, sum(epoch_us(coalesce(u, ts)) - epoch_us(ts))::BIGINT AS micros, count(*) AS times FROM (SELECT *, lead(ts) OVER (PARTITION BY node, runner, attempt ORDER BY ts, seq) AS u FROM rn WHERE attempt IS NOT NULL) GROUP BY ALL",
    "retention_by_bytes": f"""WITH {ATTEMPTS_SQL}, k AS (SELECT * FROM att WHERE epoch(arrival) > epoch(TIMESTAMP '1998-12-01') - 2600 * 86400 QUALIFY row_number() OVER (PARTITION BY node ORDER BY arrival DESC, gen DESC) <= 3)
      SELECT node, gen FROM (SELECT *, sum(part) OVER (ORDER BY arrival DESC, node, gen DESC ROWS UNBOUNDED PRECEDING) AS upto FROM k) WHERE upto <= 1000000""",
    "attempt_timing_now": f"""WITH {ATTEMPTS_SQL}, {JOBS_SQL}, r AS (SELECT a.node, a.gen, epoch_us(enqueued) AS q, CASE WHEN (a.node + a.gen) % 4 > 0 THEN epoch_us(arrival) END AS b, CASE WHEN (a.node + a.gen) % 3 > 0 THEN epoch_us(arrival) + CAST(cpu * 1000000 AS BIGINT) END AS e FROM att a JOIN job j ON a.node = j.node AND a.gen = j.gen)
      SELECT node, gen, CASE WHEN b > q THEN b - q END AS queued_us, CASE WHEN e > b THEN e - b END AS ran_us, greatest(0, coalesce(e, epoch_us(TIMESTAMP '1995-06-01 12:00:00')) - coalesce(b, q)) AS elapsed_us FROM r""",
    "attempt_timing": f"""WITH {ATTEMPTS_SQL}, {JOBS_SQL} SELECT a.node, a.gen, CASE WHEN arrival > enqueued THEN epoch_us(arrival) - epoch_us(enqueued) END AS queued_us,
      CASE WHEN cpu > 0 THEN CAST(cpu * 1000000 AS BIGINT) END AS ran_us, greatest(0, CAST(cpu * 1000000 AS BIGINT)) AS elapsed_us FROM att a JOIN job j ON a.node = j.node AND a.gen = j.gen""",
    "apply_retention": f"WITH {ATTEMPTS_SQL} SELECT node, gen FROM att WHERE epoch(arrival) > (SELECT max(epoch(arrival)) FROM att) - 400 * 86400 QUALIFY row_number() OVER (PARTITION BY node ORDER BY arrival DESC, gen DESC) <= 2",
    "reported_drops": f"WITH {EVENTS_SQL} SELECT emitter, boot, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS lost FROM ev WHERE type = 'node.failed' GROUP BY emitter, boot",
}
