"""Queries of ``operators.graph``: parts are nodes of a tree of deps, orders are requests for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildtrail.operators import graph as g


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    phase = F.when(s <= 10, "waiting").when(s <= 14, "queued").when(s <= 18, "running").when(s <= 20, "publishing").when(s <= 46, "done").when(s <= 48, "failed").otherwise("cancelled")
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("node"), phase.alias("phase"), (F.col("p_partkey") % 5).alias("consec_retry"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("node"))
    deps = n.select("node", F.explode(F.array(2 * F.col("node") + 1, 2 * F.col("node") + 2)).alias("dep"))
    return deps.join(n.select(F.col("node").alias("dep")).hint("merge"), "dep", "left_semi").select("node", "dep")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    top = spark.read.parquet(f"{sf}/part.parquet").agg(F.count("*").alias("n"))
    o = spark.read.parquet(f"{sf}/orders.parquet").crossJoin(F.broadcast(top))
    return o.select(F.col("o_orderkey").alias("request"), (F.col("o_orderkey") % F.col("n")).alias("target"), (F.col("o_orderstatus") == "P").alias("cancelled"))


def priced_requests(spark, sf):
    """All requests; those for a target of a size above 3 are cancelled."""
    target = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("target"), (F.col("p_size") > 3).alias("cancelled"))
    return requests(spark, sf).select("request", "target").join(target, "target")


def membership(spark, sf):
    return g.request_nodes(requests(spark, sf), edges(spark, sf))


def looped(spark, sf):
    e = edges(spark, sf)
    return e.unionByName(e.filter("dep % 97 = 0").select(F.col("dep").alias("node"), F.col("node").alias("dep")))


def by_target(spark, sf, f):
    """f of the targets' nodes, worked out once a target and joined to its requests."""
    r = requests(spark, sf)
    return g.for_requests(r, f(g.target_nodes(r, edges(spark, sf))))


def counts(spark, sf):
    return by_target(spark, sf, lambda m: g.request_counts(m, nodes(spark, sf)))


def children(spark, sf):
    return edges(spark, sf).select(F.col("node").alias("parent"), F.col("dep").alias("child"))


def keys(spark, sf, keep):
    return nodes(spark, sf).filter(keep).select(F.col("node").alias("key"))


QUERIES = {
    "closure": lambda s, d: g.closure(edges(s, d), nodes(s, d).select(F.col("node").alias("root"), "node")),
    "failed_upstream": lambda s, d: g.failed_upstream(edges(s, d), nodes(s, d)).select("node", "phase"),
    "request_nodes": membership,
    "ready_nodes": lambda s, d: g.ready_nodes(nodes(s, d), edges(s, d)).select("node"),
    "find_cycles": lambda s, d: g.find_cycles(looped(s, d)),
    "graph_roots": lambda s, d: g.graph_roots(edges(s, d), nodes(s, d)),
    "orphaned_by_cancel": lambda s, d: g.orphaned_by_cancel(priced_requests(s, d), edges(s, d)),
    "request_counts": counts,
    "request_phase": lambda s, d: g.request_phase(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("request"), F.when(F.col("o_orderpriority") == "1-URGENT", "no runner").alias("fail_reason")).join(requests(s, d), "request"), counts(s, d), nodes(s, d)),
    "ready_wanted_nodes": lambda s, d: g.ready_nodes(nodes(s, d).withColumn("kind", F.when(F.col("consec_retry") == 1, "buildvalue").otherwise("pin")), edges(s, d), g.request_nodes(requests(s, d).filter("not cancelled"), edges(s, d))).select("node"),
    "interest_tags": lambda s, d: g.interest_tags(membership(s, d), requests(s, d)),
    "waiting_fs": lambda s, d: g.waiting_fs(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("f"), F.col("l_partkey").alias("kp"))),
    "interest_runs": lambda s, d: g.interest_runs(membership(s, d), requests(s, d), 10),
    "waiting_runs": lambda s, d: g.waiting_runs(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("f"), F.col("l_partkey").alias("kp")), 7),
    "root_failures": lambda s, d: by_target(s, d, lambda m: g.root_failures(m, nodes(s, d))).select("request", "node", "phase"),
    "first_failing": lambda s, d: by_target(s, d, lambda m: g.first_failing(m, nodes(s, d))).select("request", "node", "nth", "truncated"),
    "problem_first": lambda s, d: g.problem_first(nodes(s, d)).select("node", "phase", "place", "nth", "in_phase"),
    "board_rows": lambda s, d: by_target(s, d, lambda m: g.board_rows(m, nodes(s, d))).select("request", "node", "kind", "nth", "more"),
    "status_changes": lambda s, d: g.status_changes(s.read.parquet(f"{d}/orders.parquet"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).select("o_custkey", "o_orderkey", "o_orderstatus"),
    "incomplete_roots": lambda s, d: g.incomplete_roots(children(s, d), keys(s, d, "phase <> 'failed'"), keys(s, d, "true")),
    "plan_transfer": lambda s, d: g.plan_transfer(children(s, d), keys(s, d, "phase <> 'cancelled'"), keys(s, d, "phase in ('done', 'running')"), keys(s, d, "true")),
    "transfer_totals": lambda s, d: g.transfer_totals(g.plan_transfer(children(s, d), keys(s, d, "true"), keys(s, d, "phase = 'done'"), keys(s, d, "phase = 'waiting'")), s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("size"))),
    "complete_keys": lambda s, d: g.complete_keys(children(s, d), keys(s, d, "phase <> 'failed'")),
    # the same operators over all rows
    "graph_roots_whole": lambda s, d: g.graph_roots(edges(s, d)),
    "orphaned_by_cancel_whole": lambda s, d: g.orphaned_by_cancel(requests(s, d), edges(s, d)),
    "incomplete_roots_whole": lambda s, d: g.incomplete_roots(children(s, d), keys(s, d, "phase <> 'cancelled'"), keys(s, d, "true")),
    "plan_transfer_whole": lambda s, d: g.plan_transfer(children(s, d), keys(s, d, "true"), keys(s, d, "phase = 'done'"), keys(s, d, "phase = 'waiting'")),
}

BASE = """nd AS (SELECT p_partkey AS node, CASE WHEN p_size <= 10 THEN 'waiting' WHEN p_size <= 14 THEN 'queued' WHEN p_size <= 18 THEN 'running' WHEN p_size <= 20 THEN 'publishing' WHEN p_size <= 46 THEN 'done' WHEN p_size <= 48 THEN 'failed' ELSE 'cancelled' END AS phase, p_partkey % 5 AS consec_retry FROM part),
ed AS (SELECT a.node, b.node AS dep FROM nd a JOIN nd b ON b.node = 2 * a.node + 1 OR b.node = 2 * a.node + 2),
rq AS (SELECT o_orderkey AS request, o_orderkey % (SELECT count(*) FROM part) AS target, o_orderstatus = 'P' AS cancelled FROM orders),
cl AS (WITH RECURSIVE c AS (SELECT node AS root, node FROM nd UNION SELECT c.root, ed.dep FROM c JOIN ed ON c.node = ed.node) SELECT * FROM c),
mem AS (SELECT request, node FROM rq JOIN cl ON target = root),
cnt AS (SELECT request, count(*) AS total, count(*) FILTER (WHERE phase = 'done') AS done, count(*) FILTER (WHERE phase IN ('queued', 'running', 'publishing')) AS running,
  count(*) FILTER (WHERE phase IN ('failed', 'failed-upstream')) AS failed, count(*) FILTER (WHERE phase NOT IN ('done', 'queued', 'running', 'publishing', 'failed', 'failed-upstream')) AS waiting FROM mem JOIN nd USING (node) GROUP BY request)"""

SQL = {
    "closure": f"WITH {BASE} SELECT root, node FROM cl",
    "failed_upstream": f"WITH {BASE} SELECT DISTINCT n.node, n.phase FROM nd n JOIN cl ON cl.root = n.node JOIN nd f ON f.node = cl.node WHERE f.phase = 'failed' AND n.phase NOT IN ('done', 'failed')",
    "request_nodes": f"WITH {BASE} SELECT request, node FROM mem",
    "ready_nodes": f"WITH {BASE} SELECT node FROM nd WHERE phase = 'waiting' AND NOT EXISTS (SELECT 1 FROM ed JOIN nd x ON ed.dep = x.node WHERE ed.node = nd.node AND x.phase <> 'done')",
    "find_cycles": f"""WITH {BASE}, lp AS (SELECT * FROM ed UNION ALL SELECT dep, node FROM ed WHERE dep % 97 = 0), rc AS (WITH RECURSIVE c AS (SELECT node AS root, dep AS node FROM lp UNION SELECT c.root, lp.dep FROM c JOIN lp ON c.node = lp.node) SELECT * FROM c), scc AS (SELECT a.root AS node, min(a.node) AS component FROM rc a JOIN rc b ON a.root = b.node AND a.node = b.root GROUP BY a.root),
      bk AS (WITH RECURSIVE b AS (SELECT component AS c, node, 0 AS far FROM scc WHERE node = component UNION SELECT b.c, e.node, far + 1 FROM b JOIN lp e ON e.dep = b.node JOIN scc s ON s.node = e.node AND s.component = b.c WHERE far < 12) SELECT c, node, min(far) AS far FROM b GROUP BY ALL)
      SELECT s.node, s.component, arg_min(e.dep, (far, e.dep)) AS next FROM scc s JOIN lp e ON e.node = s.node JOIN bk ON bk.c = s.component AND bk.node = e.dep GROUP BY ALL""",
    "graph_roots": f"WITH {BASE} SELECT node FROM nd WHERE node NOT IN (SELECT dep FROM ed)",
    "orphaned_by_cancel": f"WITH {BASE} SELECT node FROM mem JOIN rq USING (request) JOIN part ON p_partkey = target GROUP BY node HAVING bool_and(p_size > 3)",
    "request_counts": f"WITH {BASE} SELECT * FROM cnt",
    "request_phase": f"WITH {BASE}, p AS (SELECT request, CASE WHEN cancelled THEN 'cancelled' WHEN o_orderpriority = '1-URGENT' THEN 'failed' WHEN nd.phase = 'done' THEN 'done' WHEN failed > 0 THEN 'failed' ELSE 'running' END AS phase FROM rq JOIN orders ON o_orderkey = request LEFT JOIN cnt USING (request) LEFT JOIN nd ON nd.node = target) SELECT request, phase, phase <> 'running' AS terminal FROM p",
    "interest_tags": f"WITH {BASE} SELECT node, list_sort(list(DISTINCT request)) AS requests FROM mem JOIN rq USING (request) WHERE NOT cancelled GROUP BY node",
    "waiting_fs": "SELECT l_partkey AS kp, list_sort(list(DISTINCT l_orderkey)) AS fs FROM lineitem GROUP BY 1",
    "interest_runs": f"WITH {BASE}, x AS (SELECT node, request, (row_number() OVER (PARTITION BY node ORDER BY request) - 1) // 10 AS run FROM mem JOIN rq USING (request) WHERE NOT cancelled) SELECT node, run, list(request ORDER BY request) AS requests FROM x GROUP BY node, run",
    "waiting_runs": "WITH u AS (SELECT DISTINCT l_partkey AS kp, l_orderkey AS f FROM lineitem), x AS (SELECT *, (row_number() OVER (PARTITION BY kp ORDER BY f) - 1) // 7 AS run FROM u) SELECT kp, run, list(f ORDER BY f) AS fs FROM x GROUP BY kp, run",
    "ready_wanted_nodes": f"WITH {BASE} SELECT node FROM nd WHERE phase = 'waiting' AND consec_retry <> 1 AND node IN (SELECT node FROM mem JOIN rq USING (request) WHERE NOT cancelled) AND NOT EXISTS (SELECT 1 FROM ed JOIN nd x ON ed.dep = x.node WHERE ed.node = nd.node AND x.phase <> 'done')",
    "root_failures": f"WITH {BASE}, x AS (SELECT request, node, phase, max(CASE WHEN phase = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY request) AS f FROM mem JOIN nd USING (node)) SELECT x.request, x.node, x.phase FROM x JOIN nd USING (node) WHERE (f = 1 AND x.phase = 'failed') OR (f = 0 AND consec_retry > 0)",
    "first_failing": f"WITH {BASE} SELECT request, node, row_number() OVER (PARTITION BY request ORDER BY node) AS nth, count(*) OVER (PARTITION BY request) > 4 AS truncated FROM mem JOIN nd USING (node) WHERE phase = 'failed' QUALIFY nth <= 4",
    "problem_first": f"WITH {BASE} SELECT node, phase, list_position(['failed', 'failed-upstream', 'running', 'publishing', 'queued', 'waiting', 'cancelled', 'done'], phase) - 1 AS place, row_number() OVER (PARTITION BY phase ORDER BY node) AS nth, count(*) OVER (PARTITION BY phase) AS in_phase FROM nd",
    "board_rows": f"WITH {BASE}, x AS (SELECT request, node, CASE WHEN phase IN ('queued', 'running', 'publishing') THEN 'run' WHEN phase = 'failed' THEN 'fail' END AS kind FROM mem JOIN nd USING (node)) SELECT request, node, kind, row_number() OVER (PARTITION BY request, kind ORDER BY node) AS nth, greatest(0, count(*) OVER (PARTITION BY request, kind) - CASE WHEN kind = 'run' THEN 8 ELSE 4 END) AS more FROM x WHERE kind IS NOT NULL QUALIFY nth <= CASE WHEN kind = 'run' THEN 8 ELSE 4 END",
    "status_changes": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p IS NULL OR p <> o_orderstatus",
    "incomplete_roots": f"WITH {BASE} SELECT root, count(*) AS missing, min(cl.node) AS example FROM cl JOIN nd ON nd.node = cl.node WHERE phase = 'failed' GROUP BY root",
    "plan_transfer": f"""WITH {BASE}, has AS (SELECT node FROM nd WHERE phase IN ('done', 'running')), whole AS (SELECT root AS key FROM cl GROUP BY root HAVING bool_and(node IN (SELECT node FROM has))),
      ask AS (SELECT node FROM nd WHERE phase <> 'cancelled' AND node NOT IN (SELECT key FROM whole)),
      m AS (WITH RECURSIVE c AS (SELECT node AS key, 1 AS round FROM ask UNION SELECT ed.dep, c.round + 1 FROM c JOIN ed ON c.key = ed.node JOIN ask ON ask.node = ed.dep) SELECT * FROM c)
      SELECT key, min(round) AS round, key IN (SELECT node FROM has) AS present FROM m GROUP BY key""",
    "complete_keys": f"WITH {BASE} SELECT root AS key FROM cl JOIN nd ON nd.node = cl.node GROUP BY root HAVING bool_and(phase <> 'failed')",
    "transfer_totals": f"""WITH {BASE}, whole AS (SELECT root AS key FROM cl JOIN nd ON nd.node = cl.node GROUP BY root HAVING bool_and(phase = 'done')),
      m AS (WITH RECURSIVE c AS (SELECT node AS key, 1 AS round FROM nd WHERE phase = 'waiting' UNION SELECT ed.dep, c.round + 1 FROM c JOIN ed ON c.key = ed.node WHERE ed.dep NOT IN (SELECT key FROM whole)) SELECT * FROM c),
      q AS (SELECT key, min(round) AS round FROM m GROUP BY key) SELECT max(round) AS rounds, count(*) FILTER (WHERE phase <> 'done') AS objects, coalesce(sum(p_size) FILTER (WHERE phase <> 'done'), 0)::BIGINT AS bytes FROM q JOIN nd ON node = key JOIN part ON p_partkey = key""",
    "graph_roots_whole": f"WITH {BASE} SELECT DISTINCT node FROM (SELECT node FROM ed UNION SELECT dep FROM ed) WHERE node NOT IN (SELECT dep FROM ed)",
    "orphaned_by_cancel_whole": f"WITH {BASE} SELECT node FROM mem JOIN rq USING (request) GROUP BY node HAVING bool_and(cancelled)",
    "incomplete_roots_whole": f"WITH {BASE} SELECT root, count(*) AS missing, min(cl.node) AS example FROM cl JOIN nd ON nd.node = cl.node WHERE phase = 'cancelled' GROUP BY root",
    "plan_transfer_whole": f"""WITH {BASE}, whole AS (SELECT root AS key FROM cl JOIN nd ON nd.node = cl.node GROUP BY root HAVING bool_and(phase = 'done')),
      m AS (WITH RECURSIVE c AS (SELECT node AS key, 1 AS round FROM nd WHERE phase = 'waiting' UNION SELECT ed.dep, c.round + 1 FROM c JOIN ed ON c.key = ed.node WHERE ed.dep NOT IN (SELECT key FROM whole)) SELECT * FROM c)
      SELECT key, min(round) AS round, phase = 'done' AS present FROM m JOIN nd ON node = key GROUP BY key, phase""",
}
