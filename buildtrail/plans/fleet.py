"""Queries of ``operators.fleet``: suppliers are runners, parts are jobs, lineitem rows hold capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildtrail.functions.scalars import MIB
from buildtrail.operators import fleet as f


def jobs(s, d):
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("node"), (F.col("p_size").cast("long") * 100).alias("cpu_milli"), (F.floor(F.col("p_retailprice") - 899) * 128 * MIB).cast("long").alias("mem_bytes"), (F.col("p_partkey") % 25).cast("int").alias("platform"))


def runners(s, d):
    b = F.abs("s_acctbal")
    return s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("platform"), F.floor(b).cast("long").alias("cpu_milli"), (F.floor(b) * 3 * MIB).cast("long").alias("mem_bytes"))


def holds(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("runner"), (F.col("l_quantity") * 10).cast("long").alias("cpu_milli"), F.col("l_shipdate").alias("since"), (F.col("l_shipdate") + F.expr("make_dt_interval(cast(l_quantity as int))")).alias("until"))


def named_holds(s, d):
    more = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("runner"), F.concat(F.when(F.col("l_returnflag") == "R", "lane/").otherwise("job/"), F.col("l_orderkey")).alias("name"), (F.col("l_quantity") * 10).cast("long").alias("cpu_milli"), (F.col("l_partkey") * MIB).cast("long").alias("mem_bytes"), F.col("l_shipdate").cast("timestamp_ntz").alias("since"))
    return more.withColumn("until", F.col("since") + F.expr("make_dt_interval(cast(cpu_milli / 10 as int))"))


def seen(s, d):
    return s.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 25).alias("platform"), F.col("user_id").alias("id"), F.col("ts").alias("seen"), "event_type", "value", "event_id")


QUERIES = {
    "round_to_class": lambda s, d: f.round_to_class(jobs(s, d)).select("node", "rung", "capped"),
    "classes_within": lambda s, d: f.classes_within(runners(s, d)).select("id", "rungs", "size"),
    "fit_runners": lambda s, d: f.fit_runners(jobs(s, d), runners(s, d).withColumn("free_cpu", F.col("cpu_milli")).withColumn("free_mem", F.col("mem_bytes"))),
    "fleet": lambda s, d: f.fleet(seen(s, d).filter("event_type = 'signup'").select("id", "platform", F.col("value").alias("cpu"), "seen"), seen(s, d).filter("event_type = 'click'").select("id", F.col("value").alias("free_cpu"), "seen")),
    "ledger": lambda s, d: f.ledger(holds(s, d), runners(s, d).withColumn("capacity", F.col("cpu_milli") * 30)),
    "peak_concurrency": lambda s, d: f.peak_concurrency(holds(s, d)),
    "ledger_of_jobs": lambda s, d: f.ledger_of_jobs(named_holds(s, d), runners(s, d).withColumn("cpu_milli", F.col("cpu_milli") * 30)),
    "peak_usage": lambda s, d: f.peak_usage(named_holds(s, d)),
    "runnerless_gaps": lambda s, d: f.runnerless_gaps(seen(s, d), 900, 3600),
    "liveness_gate": lambda s, d: f.liveness_gate(seen(s, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("request"), "platform", F.col("seen").alias("asked")), seen(s, d).filter("event_type <> 'purchase'").select("platform", "seen"), 3600).select("request", "platform"),
}

J = "jb AS (SELECT p_partkey AS node, p_size::BIGINT * 100 AS cpu_milli, floor(p_retailprice - 899)::BIGINT * 128 * 1048576 AS mem_bytes, p_partkey % 25 AS platform FROM part)"
R = "rn AS (SELECT s_suppkey AS id, s_nationkey AS platform, floor(abs(s_acctbal))::BIGINT AS cpu_milli, floor(abs(s_acctbal))::BIGINT * 3 * 1048576 AS mem_bytes FROM supplier)"
L = "ld(ord, rung, c, g) AS (VALUES (0, 'c0.2-m1', 200, 1), (1, 'c1-m1', 1000, 1), (2, 'c1-m2', 1000, 2), (3, 'c1-m4', 1000, 4), (4, 'c2-m4', 2000, 4), (5, 'c2-m8', 2000, 8), (6, 'c2-m16', 2000, 16), (7, 'c4-m8', 4000, 8), (8, 'c4-m16', 4000, 16))"
H = "hd AS (SELECT l_suppkey AS runner, (l_quantity * 10)::BIGINT AS cpu_milli, l_shipdate AS since, l_shipdate + to_days(l_quantity::INTEGER) AS until FROM lineitem)"
S = "sn AS (SELECT user_id % 25 AS platform, user_id AS id, ts AS seen, event_type, value, event_id FROM events)"

N = "nh AS (SELECT l_suppkey AS runner, CASE WHEN l_returnflag = 'R' THEN 'lane/' ELSE 'job/' END || l_orderkey AS name, (l_quantity * 10)::BIGINT AS cpu_milli, l_partkey::BIGINT * 1048576 AS mem_bytes, l_shipdate::TIMESTAMP AS since, l_shipdate::TIMESTAMP + to_days(l_quantity::INTEGER) AS until FROM lineitem)"

SQL = {
    "ledger_of_jobs": f"WITH {N}, {R}, u AS (SELECT runner, sum(cpu_milli) AS c, sum(mem_bytes) AS m, count(*) FILTER (WHERE name LIKE 'job/%') AS n, count(*) AS sl FROM nh GROUP BY runner) SELECT id, greatest(0, cpu_milli * 30 - coalesce(c, 0))::BIGINT AS free_cpu, greatest(0, mem_bytes - coalesce(m, 0))::BIGINT AS free_mem, coalesce(n, 0) AS in_flight, coalesce(sl, 0) AS slots FROM rn LEFT JOIN u ON id = runner",
    "peak_usage": f"""WITH {N}, x AS (SELECT runner, since AS tm, 1 AS n, cpu_milli AS c, mem_bytes AS m FROM nh UNION ALL SELECT runner, until, -1, -cpu_milli, -mem_bytes FROM nh), y AS (SELECT runner, tm, sum(n) AS n, sum(c) AS c, sum(m) AS m FROM x GROUP BY runner, tm),
z AS (SELECT runner, tm, sum(n) OVER w AS n, sum(c) OVER w AS c, sum(m) OVER w AS m FROM y WINDOW w AS (PARTITION BY runner ORDER BY tm)), t AS (SELECT runner, max(n) AS n, max(c) AS c, max(m) AS m FROM z GROUP BY runner)
SELECT t.runner, t.n::BIGINT AS slots, t.c::BIGINT AS cpu_milli, t.m::BIGINT AS mem_bytes, min(tm) FILTER (WHERE z.n = t.n) AS slots_at, min(tm) FILTER (WHERE z.c = t.c) AS cpu_milli_at, min(tm) FILTER (WHERE z.m = t.m) AS mem_bytes_at FROM t JOIN z ON z.runner = t.runner GROUP BY ALL""",
    "round_to_class": f"WITH {J}, {L} SELECT node, coalesce(arg_min(rung, ord) FILTER (WHERE rung IS NOT NULL), 'c4-m16') AS rung, count(rung) = 0 AS capped FROM jb LEFT JOIN ld ON cpu_milli <= c AND mem_bytes <= g::BIGINT * 1073741824 GROUP BY node",
    "classes_within": f"WITH {R}, {L} SELECT id, count(rung) AS rungs, arg_max(rung, ord) AS size FROM rn LEFT JOIN ld ON c <= cpu_milli AND g::BIGINT * 1073741824 <= mem_bytes GROUP BY id",
    "fit_runners": f"WITH {J}, {R}, x AS (SELECT DISTINCT j.platform, j.cpu_milli, j.mem_bytes, r.id AS runner, r.cpu_milli - j.cpu_milli AS a, r.mem_bytes - j.mem_bytes AS b FROM jb j JOIN rn r ON j.platform = r.platform AND j.cpu_milli <= r.cpu_milli AND j.mem_bytes <= r.mem_bytes) SELECT platform, cpu_milli, mem_bytes, arg_min(runner, (a, b, runner)) AS runner, count(*) AS fits FROM x GROUP BY platform, cpu_milli, mem_bytes",
    "fleet": f"WITH {S}, h AS (SELECT id, arg_max(platform, seen) AS platform, arg_max(value, seen) AS cpu, max(seen) AS hs FROM sn WHERE event_type = 'signup' GROUP BY id), b AS (SELECT id, arg_max(value, seen) AS free, max(seen) AS bs FROM sn WHERE event_type = 'click' GROUP BY id) SELECT coalesce(h.id, b.id) AS id, platform, coalesce(CASE WHEN hs IS NULL OR bs >= hs THEN free END, cpu) AS free_cpu, greatest(hs, bs) AS seen FROM h FULL JOIN b ON h.id = b.id",
    "ledger": f"WITH {H}, {R}, u AS (SELECT runner, sum(cpu_milli) AS c, count(*) AS n FROM hd GROUP BY runner) SELECT id, greatest(0, cpu_milli * 30 - coalesce(c, 0))::BIGINT AS free_cpu, coalesce(n, 0) AS in_flight FROM rn LEFT JOIN u ON id = runner",
    "peak_concurrency": f"WITH {H}, x AS (SELECT runner, since AS tm, 1 AS n, cpu_milli AS c FROM hd UNION ALL SELECT runner, until, -1, -cpu_milli FROM hd), y AS (SELECT runner, tm, sum(n) AS n, sum(c) AS c FROM x GROUP BY runner, tm), z AS (SELECT runner, sum(n) OVER (PARTITION BY runner ORDER BY tm) AS n, sum(c) OVER (PARTITION BY runner ORDER BY tm) AS c FROM y) SELECT runner, max(n)::BIGINT AS slots, max(c)::BIGINT AS cpu_milli FROM z GROUP BY runner",
    "runnerless_gaps": f"WITH {S}, x AS (SELECT platform, epoch_us(seen) AS us, lag(epoch_us(seen)) OVER (PARTITION BY platform ORDER BY seen) AS p FROM sn) SELECT platform, p + 900 * 1000000 AS gap_from_us, round((us - p) / 1e6 - 900, 3) AS gap_s FROM x WHERE (us - p) / 1e6 - 900 >= 3600",
    "liveness_gate": f"WITH {S} SELECT event_id AS request, platform FROM sn a WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM sn b WHERE b.event_type <> 'purchase' AND a.platform = b.platform AND epoch_us(a.seen) - epoch_us(b.seen) BETWEEN 0 AND 3600000000)",
}
