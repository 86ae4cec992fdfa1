"""Queries of ``operators.builds``."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildtrail.functions import scalars as x
from buildtrail.operators import builds as b
from buildtrail.operators import refs
from buildtrail.plans import graph as g
from buildtrail.plans import telemetry as t


def lines(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet")


def caches(s, d):
    path = F.concat(F.when(F.col("l_linenumber") == 7, F.lit("rel/")).otherwise(F.lit("/c/")), F.col("l_suppkey") % 10, F.when(F.col("l_linenumber") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.col("l_linenumber"))))
    return lines(s, d).select(F.col("l_orderkey").alias("build"), F.concat(F.when(F.col("l_linenumber") == 5, F.lit("-")).otherwise(F.lit("i")), F.col("l_partkey")).alias("id"), path.alias("path"))


def inputs(s, d):
    return lines(s, d).select(F.col("l_orderkey").alias("build"), F.col("l_partkey").alias("input")).distinct()


def diagnosed(s, d):
    raw = F.concat(F.encode("text", "utf-8"), F.when(F.col("turn") % 2 == 0, F.unhex(F.lit("FF"))).otherwise(F.lit(b"")))
    return s.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("node"), F.col("turn").alias("gen"), F.when(F.col("role") == "user", "").otherwise(F.col("role")).alias("class"), (F.col("turn").cast("long") * 1_500_000_000).alias("at"), F.when(F.col("turn") % 3 > 0, raw).otherwise(F.lit(b"")).alias("log"))


def reports(s, d):
    push = F.col("l_suppkey") % 3 > 0
    pushed = lambda c: F.when(push, F.col(c).cast("long"))
    return lines(s, d).select(
        F.col("l_suppkey").alias("node"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_partkey").cast("long").alias("stored_bytes"), F.col("l_linenumber").cast("long").alias("stored_objects"),
        F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("long")).otherwise(0).alias("stored_deduped"), (push & (F.col("l_linestatus") == "O")).alias("pushed"),
        pushed("l_partkey").alias("pushed_bytes"), pushed("l_linenumber").alias("pushed_objects"), pushed("l_quantity").alias("push_total_objects"),
    )


def stages(s, d):
    stage = F.when(F.col("l_linenumber") % 3 == 0, "seeded").when(F.col("l_linenumber") % 3 == 1, "finalized").otherwise("other")
    result = F.when(F.col("l_returnflag") == "A", "updated").when(F.col("l_returnflag") == "N", "unchanged").otherwise("empty")
    return lines(s, d).select(F.col("l_partkey").alias("cache"), stage.alias("stage"), F.col("l_quantity").cast("long").alias("ms"), F.col("l_orderkey").cast("long").alias("bytes"), F.col("l_suppkey").cast("long").alias("files"), (F.col("l_linestatus") == "O").alias("cold"), result.alias("result"))


QUERIES = {
    "validate_caches": lambda s, d: b.validate_caches(caches(s, d)).select("build", "id", "path", "reason"),
    "runtime_deps_not_in_inputs": lambda s, d: b.runtime_deps_not_in_inputs(lines(s, d).filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("build"), (F.col("l_suppkey") % 8).alias("name")).distinct(), lines(s, d).filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("build"), (F.col("l_suppkey") % 8).alias("name")).distinct()),
    "runtime_closure": lambda s, d: b.runtime_closure(inputs(s, d), g.nodes(s, d).select(F.col("node").alias("input"), F.concat(F.lit("a"), F.col("node") % 300).alias("artifact")), g.edges(s, d).select(F.col("node").alias("input"), F.concat(F.lit("a"), F.col("dep") % 300).alias("artifact"))),
    "requirement": lambda s, d: b.requirement(g.nodes(s, d).select("node", F.lit(1000).cast("long").alias("cpu"), F.lit(2048).cast("long").alias("mem")), s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("node"), (F.col("p_size") * 40).cast("long").alias("cpu"), (F.col("p_size") * 100).cast("long").alias("mem")), lines(s, d).select(F.col("l_partkey").alias("node"), (F.col("l_quantity") * 30).cast("long").alias("cpu"), (F.col("l_suppkey") * 20).cast("long").alias("mem"))),
    "cas_summary": lambda s, d: b.cas_summary(lines(s, d).select(F.col("l_suppkey").alias("node"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_partkey").alias("bytes"), (F.col("l_returnflag") == "N").alias("present"))),
    "transfer_stats": lambda s, d: b.transfer_stats(lines(s, d).select(F.col("l_orderkey").alias("ref"), (F.col("l_partkey") * 1000).alias("bytes"), (F.col("l_returnflag") != "N").alias("moved"), F.col("l_quantity").alias("seconds"))),
    "cache_stats": lambda s, d: b.cache_stats(lines(s, d).select(F.col("l_partkey").alias("cache"), (F.col("l_linestatus") == "O").alias("cold"), F.when(F.col("l_returnflag") == "A", "updated").when(F.col("l_returnflag") == "N", "unchanged").otherwise("empty").alias("result"))),
    "cas_reports": lambda s, d: b.cas_reports(reports(s, d)),
    "cache_stages": lambda s, d: b.cache_stages(stages(s, d)),
    "store_stats": lambda s, d: b.store_stats(s.read.parquet(f"{d}/customer.parquet"), s.read.parquet(f"{d}/orders.parquet"), g.nodes(s, d), s.read.parquet(f"{d}/documents.parquet").select(F.octet_length("text").cast("long").alias("size"))),
    "first_error": lambda s, d: b.first_error(g.membership(s, d), s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_name").alias("error")).join(g.nodes(s, d), F.col("p_partkey") == F.col("node")).select("node", "phase", "error"), s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("request"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("fail_reason"))),
    "memo_hits": lambda s, d: b.memo_hits(lines(s, d).select(F.col("l_orderkey").alias("f"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("kp"))),
    "flatten_tree": lambda s, d: b.flatten_tree(g.edges(s, d), g.nodes(s, d).filter("node < 3").select("node")).select("node", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path")),
    "deal_round_robin": lambda s, d: b.deal_round_robin(lines(s, d).select(F.col("l_suppkey").alias("round"), F.col("l_orderkey").alias("key")).distinct(), "key", 3),
    "split_undecodable": lambda s, d: b.split_undecodable(t.events(s, d).withColumn("raw", F.when(F.col("seq") % 5 == 0, F.concat(F.lit("x"), F.col("props"))).otherwise(F.col("props"))), "raw", "k long")[0].select("seq", "value.k"),
    "key_parts": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.hex(F.col("p_size") % 16), F.lit("3"), F.lpad(F.hex("p_partkey"), 6, "0"), F.lit("ff")).alias("k")).select("p_partkey", x.key_type(F.lower("k")).alias("kind"), x.key_length(F.lower("k")).alias("length")),
    "event_field": lambda s, d: t.events(s, d).select("seq", x.event_field("props", "k", "long").alias("k"), x.event_field("props", "none", "double").alias("none")),
    "definition_key": lambda s, d: lines(s, d).select("l_partkey", "l_suppkey", F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")).alias("opt")).withColumn("key", x.definition_key("l_suppkey", "l_partkey", "opt")).agg(F.countDistinct("key").alias("keys"), F.countDistinct("l_partkey", "l_suppkey", F.coalesce("opt", F.lit(0))).alias("definitions")),
    "attempt_verdict": lambda s, d: t.trail(s, d).select("node", "gen", x.attempt_verdict("class", "disposition", F.col("gen") - 1).alias("verdict")),
    "label_node": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", x.label_node(F.when(F.col("p_size") > 9, F.col("p_name")), F.concat(F.lit("build_"), F.sha2("p_name", 256))).alias("label")),
    "pullable_tags": lambda s, d: refs.pullable_tags(s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.when(F.col("o_orderstatus") == "O", "build-from:").otherwise("x:"), F.when(F.col("o_custkey") % 2 == 0, F.sha2(F.col("o_custkey").cast("string"), 256)).otherwise(F.col("o_custkey").cast("string"))).alias("name")), s.read.parquet(f"{d}/supplier.parquet").select(F.sha2(F.col("s_suppkey").cast("string"), 256).alias("k"))),
    "list_requests": lambda s, d: refs.list_requests(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("request"), F.col("o_orderdate").alias("created")), 50).select("request"),
    "diagnosis_report": lambda s, d: b.diagnosis_report(diagnosed(s, d), ["class"], ("at",), ("log",)).select("node", *[F.get_json_object("report", f"$.attempts[0].{c}").alias(c) for c in ("class", "at", "log")], F.get_json_object("report", "$.attempts[1].log").alias("second")),
    "lane_names": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", x.jobs_subject(F.col("p_type"), F.col("p_brand")).alias("subject"), x.lane_name(F.concat(F.lit("linux/"), "p_type"), F.concat(F.lit("c0."), F.col("p_size"))).alias("lane"), x.node_subject("failures", F.col("p_name")).alias("failures"), x.heartbeat_subject(F.col("p_partkey").cast("string")).alias("beats"), x.pin_cover_ref(F.col("p_name")).alias("ref"), x.parse_pin_cover_ref(x.pin_cover_ref(F.col("p_name"), 7))["version"].alias("version"), x.parse_pin_cover_ref(F.col("p_name"))["key"].alias("none")),
    "diagnosis_json": lambda s, d: b.diagnosis_json(t.newest(s, d).filter("disposition <> 'done'"), ["gen", "class", "disposition"]),
}

P = "pt AS (SELECT p_partkey AS node, p_size, p_name, CASE WHEN p_size BETWEEN 47 AND 48 THEN 'failed' END AS phase FROM part)"
SQL = {
    "validate_caches": """WITH c AS (SELECT l_orderkey AS build, CASE WHEN l_linenumber = 5 THEN '-' ELSE 'i' END || l_partkey AS id, CASE WHEN l_linenumber = 7 THEN 'rel/' ELSE '/c/' END || (l_suppkey % 10) || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE '/' || l_linenumber END AS path FROM lineitem),
      x AS (SELECT *, count(*) OVER (PARTITION BY build, id) > 1 AS i2, count(*) OVER (PARTITION BY build, path) > 1 AS p2, EXISTS (SELECT 1 FROM c o WHERE o.build = c.build AND starts_with(c.path, o.path || '/')) AS nested FROM c)
      SELECT build, id, path, CASE WHEN starts_with(id, '-') THEN 'bad id' WHEN NOT starts_with(path, '/') THEN 'bad path' WHEN i2 THEN 'duplicate id' WHEN p2 THEN 'duplicate path' WHEN nested THEN 'nested path' END AS reason FROM x""",
    "runtime_deps_not_in_inputs": "SELECT DISTINCT l_orderkey AS build, l_suppkey % 8 AS name FROM lineitem WHERE l_returnflag = 'R' AND (l_orderkey, l_suppkey % 8) NOT IN (SELECT (l_orderkey, l_suppkey % 8) FROM lineitem WHERE l_returnflag <> 'R')",
    "runtime_closure": "WITH n AS (SELECT count(*) AS n FROM part), i AS (SELECT DISTINCT l_orderkey AS build, l_partkey AS x FROM lineitem) SELECT build, 'a' || (x % 300) AS artifact FROM i JOIN part ON p_partkey = x UNION SELECT build, 'a' || ((2 * x + k) % 300) FROM i, n, (VALUES (1), (2)) v(k) WHERE 2 * x + k < n",
    "requirement": "WITH q AS (SELECT l_partkey AS node, max((l_quantity * 30)::BIGINT) AS c, max((l_suppkey * 20)::BIGINT) AS m FROM lineitem GROUP BY 1) SELECT p_partkey AS node, greatest(1000, p_size * 40, c)::BIGINT AS cpu, greatest(2048, p_size * 100, m)::BIGINT AS mem FROM part LEFT JOIN q ON node = p_partkey",
    "cas_summary": "SELECT l_suppkey AS node, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS objects, count(*) FILTER (WHERE l_returnflag = 'N') AS deduped, sum(l_partkey)::BIGINT AS bytes, coalesce(sum(l_partkey) FILTER (WHERE l_returnflag = 'N'), 0)::BIGINT AS deduped_bytes, CASE WHEN sum(l_partkey) > 0 THEN round(coalesce(sum(l_partkey) FILTER (WHERE l_returnflag = 'N'), 0) / sum(l_partkey)::DOUBLE, 6) END AS ratio FROM lineitem GROUP BY 1, 2",
    "transfer_stats": "SELECT l_orderkey AS ref, count(*) AS offered, count(*) FILTER (WHERE l_returnflag <> 'N') AS moved, coalesce(sum(l_partkey * 1000) FILTER (WHERE l_returnflag <> 'N'), 0)::BIGINT AS bytes, round(coalesce(sum(l_partkey * 1000) FILTER (WHERE l_returnflag <> 'N'), 0)::DOUBLE / 1e6 / sum(l_quantity), 6) AS mb_s FROM lineitem GROUP BY 1",
    "cache_stats": "SELECT l_partkey AS cache, count(*) AS n, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END), 6) AS cold_rate, count(*) FILTER (WHERE l_returnflag = 'A') AS updated, count(*) FILTER (WHERE l_returnflag = 'N') AS unchanged, count(*) FILTER (WHERE l_returnflag = 'R') AS empty FROM lineitem GROUP BY 1",
    "lane_names": "SELECT p_partkey, 'jobs.' || replace(p_type, '/', '-') || '.' || p_brand AS subject, 'wq-linux-' || replace(p_type, '/', '-') || '-c0_' || p_size AS lane, 'failures.' || p_name AS failures, 'runners.' || p_partkey || '.hb' AS beats, 'pin-cover/2:' || p_name AS ref, 7 AS version, NULL::VARCHAR AS none FROM part",
    "diagnosis_report": """WITH c AS (SELECT conv_id AS node, nullif(CASE WHEN role = 'user' THEN '' ELSE role END, '') AS class, CASE WHEN turn > 0 THEN '1970-01-01T00:00:' || lpad((turn * 3 // 2)::VARCHAR, 2, '0') || CASE WHEN turn % 2 = 1 THEN '.5Z' ELSE 'Z' END END AS tm,
CASE WHEN turn % 3 > 0 THEN nullif(text || CASE WHEN turn % 2 = 0 THEN chr(65533) ELSE '' END, '') END AS log, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT node, max(class) FILTER (WHERE n = 1) AS class, max(tm) FILTER (WHERE n = 1) AS at, max(log) FILTER (WHERE n = 1) AS log, max(log) FILTER (WHERE n = 2) AS second FROM c GROUP BY node""",
    "cas_reports": """WITH r AS (SELECT l_suppkey AS node, strftime(l_shipdate, '%Y-%m-%d') AS day, l_partkey, l_linenumber, l_quantity::BIGINT AS q, CASE WHEN l_returnflag = 'N' THEN l_quantity::BIGINT ELSE 0 END AS dd, l_suppkey % 3 > 0 AND l_linestatus = 'O' AS pushed FROM lineitem)
SELECT node, day, sum(l_partkey)::BIGINT AS stored_bytes, sum(l_linenumber)::BIGINT AS stored_objects, sum(dd)::BIGINT AS stored_deduped, count(*) FILTER (WHERE pushed) AS pushes, sum(l_partkey) FILTER (WHERE pushed)::BIGINT AS pushed_bytes, sum(l_linenumber) FILTER (WHERE pushed)::BIGINT AS pushed_objects, sum(q) FILTER (WHERE pushed)::BIGINT AS push_total_objects,
sum(l_linenumber + dd)::BIGINT AS total_objects, round(sum(dd) / sum(l_linenumber + dd)::DOUBLE, 6) AS dedup_ratio FROM r GROUP BY node, day""",
    "cache_stages": """WITH r AS (SELECT *, l_linenumber % 3 = 0 AS se, l_linenumber % 3 = 1 AS fi, l_quantity::BIGINT AS q FROM lineitem)
SELECT l_partkey AS cache, count(*) FILTER (WHERE se) AS seeds, count(*) FILTER (WHERE fi) AS finals, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) FILTER (WHERE se), 6) AS cold_rate,
coalesce(sum(q) FILTER (WHERE se), 0)::BIGINT AS seeded_ms, coalesce(sum(l_orderkey) FILTER (WHERE se), 0)::BIGINT AS seeded_bytes, coalesce(sum(l_suppkey) FILTER (WHERE se), 0)::BIGINT AS seeded_files, coalesce(sum(q) FILTER (WHERE fi), 0)::BIGINT AS finalized_ms, coalesce(sum(l_orderkey) FILTER (WHERE fi), 0)::BIGINT AS finalized_bytes, coalesce(sum(l_suppkey) FILTER (WHERE fi), 0)::BIGINT AS finalized_files,
count(*) FILTER (WHERE fi AND l_returnflag = 'A') AS updated, count(*) FILTER (WHERE fi AND l_returnflag = 'N') AS unchanged, count(*) FILTER (WHERE fi AND l_returnflag = 'R') AS empty FROM r GROUP BY l_partkey""",
    "store_stats": "SELECT (SELECT count(*) FROM customer) AS refs, (SELECT count(*) FROM orders) AS requests, (SELECT count(*) FROM part) AS nodes, (SELECT sum(strlen(text))::BIGINT FROM documents) AS bytes",
    "first_error": f"WITH {g.BASE}, {P}, e AS (SELECT request, arg_min(p_name, mem.node) AS e FROM mem JOIN pt ON mem.node = pt.node WHERE pt.phase = 'failed' GROUP BY request) SELECT o_orderkey AS request, coalesce(e, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS error FROM orders LEFT JOIN e ON request = o_orderkey",
    "memo_hits": "SELECT l_partkey || '-' || l_suppkey AS kp, count(DISTINCT l_orderkey) AS fs, min(l_orderkey) AS first_f, count(DISTINCT l_orderkey) - 1 AS saved FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1",
    "flatten_tree": f"WITH {g.BASE}, f AS (WITH RECURSIVE c AS (SELECT node, 0 AS depth, node::VARCHAR AS path FROM nd WHERE node < 3 UNION ALL SELECT ed.dep, depth + 1, path || '/' || ed.dep FROM c JOIN ed ON c.node = ed.node) SELECT * FROM c) SELECT node, depth, path FROM f",
    "deal_round_robin": "WITH w AS (SELECT DISTINCT l_suppkey AS round, l_orderkey AS key FROM lineitem) SELECT round, key, (row_number() OVER (PARTITION BY round ORDER BY key) - 1) % 3 AS channel FROM w",
    "split_undecodable": "SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 5 <> 0",
    "key_parts": "SELECT p_partkey, p_size % 16 AS kind, p_partkey AS length FROM part",
    "event_field": "SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL::DOUBLE AS none FROM events",
    "definition_key": "SELECT count(DISTINCT (l_partkey, l_suppkey, CASE WHEN l_linenumber > 3 THEN l_linenumber ELSE 0 END)) AS keys, keys AS definitions FROM lineitem",
    "attempt_verdict": f"WITH {t.TRAIL_SQL} SELECT node, gen, class || CASE WHEN disposition <> 'done' THEN ' (' || disposition || ')' ELSE '' END || CASE WHEN gen <> 1 THEN ' exit ' || (gen - 1) ELSE '' END AS verdict FROM walk",
    "label_node": "SELECT p_partkey, CASE WHEN p_size > 9 THEN p_name || ' ' ELSE '' END || '[build:' || left(sha256(p_name), 8) || ']' AS label FROM part",
    "pullable_tags": "SELECT sha256(o_custkey::VARCHAR) AS k FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0 UNION SELECT sha256(s_suppkey::VARCHAR) FROM supplier",
    "list_requests": "SELECT o_orderkey AS request FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
}
