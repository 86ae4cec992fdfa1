"""Queries of nodes by kind and stage: parts make builds and imports, each build with a chain of stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildtrail.functions.scalars import CHAIN
from buildtrail.operators import builds as b
from buildtrail.operators import graph
from buildtrail.operators import refs as r
from buildtrail.plans import graph as g

PHASES = ("waiting", "queued", "running", "publishing", "done", "done", "failed", "failed-upstream", "cancelled", "done")


def parts(s, d):
    return s.read.parquet(f"{d}/part.parquet")


def key(n):
    """A key's form from a number."""
    return F.sha2(F.concat(F.lit("k"), n.cast("string")), 256)


def stage_nodes(s, d) -> DataFrame:
    """(n, node, kind, key, platform, label, phase, elapsed_ms, runner, cached, error): every fourth part is an import, others are builds with their stages."""
    n = F.col("p_partkey")
    own = F.when(n % 4 == 3, F.array(F.lit("import"))).otherwise(F.filter(F.array(F.lit("buildvalue"), *map(F.lit, CHAIN)), lambda k: (k == "buildvalue") | ((n + F.length(k)) % 5 != 0)))
    rows = parts(s, d).select(n.alias("n"), "p_size", "p_name", "p_type", F.explode(own).alias("kind"))
    phase = F.element_at(F.array(*map(F.lit, PHASES)), ((F.col("p_size") * 3 + F.col("n") + F.length("kind") * 7) % len(PHASES) + 1).cast("int"))
    return rows.select("n", F.concat("kind", F.lit("_"), key(F.col("n"))).alias("node"), "kind", key(F.col("n")).alias("key"), (F.col("p_type")).alias("platform"), F.when(F.col("n") % 3 > 0, F.col("p_name")).alias("label"), phase.alias("phase"), (F.col("n") * 10 + F.length("kind")).alias("elapsed_ms"), F.concat(F.lit("r"), F.col("n") % 7).alias("runner"), (F.col("n") % 6 == 1).alias("cached"), F.when(phase == "failed", F.concat(F.lit("e"), F.col("n"))).alias("error"))


def stage_edges(s, d) -> DataFrame:
    """Builds depend on their stages; a buildfrom on the build or import of 2n + 1, a buildrun on that of 2n + 2, a buildvalue on that of n + 5."""
    n = stage_nodes(s, d).select("n", "node", "kind")
    chain = n.filter("kind = 'buildvalue'").join(n.filter(F.col("kind").isin(*CHAIN)).select("n", F.col("node").alias("dep")).hint("merge"), "n").select("node", "dep")
    top = n.filter(F.col("kind").isin("buildvalue", "import")).select(F.col("n").alias("m"), F.col("node").alias("dep"))
    hop = lambda kind, m: n.filter(F.col("kind") == kind).withColumn("m", m).join(top.hint("merge"), "m").select("node", "dep")
    x = F.col("n")
    return reduce(DataFrame.unionByName, [chain, hop("buildfrom", 2 * x + 1), hop("buildrun", 2 * x + 2), hop("buildvalue", x + 5)])


def stage_refs(s, d) -> DataFrame:
    """Current refs (name, key): outputs of nodes, by the sizes of their parts."""
    n = parts(s, d).select(F.col("p_partkey").alias("n"), "p_size", "p_type")
    k = key(F.col("n"))
    ref = lambda rows, name, value: rows.select(F.concat(F.lit(name + ":"), k).alias("name"), value.alias("key"))
    size = F.col("p_size")
    rows = [
        ref(n.filter(size > 10), "build-from", key(F.col("n") + 1)),
        ref(n.filter(size > 20), "build-output", key(F.col("n") * 2)),
        ref(n.filter(size > 25), "build-output-deps", key(F.col("n") * 3)),
        ref(n.filter(size < 15), "import-output", key(F.col("n") * 5)),
        ref(n.filter((size > 5) & (size < 30)), "build-pinned", key(F.col("n") * 7)),
        ref(n.filter(size % 2 == 0), "build-plugin-resolved", key(F.col("n") * 11)),
        n.filter(size > 40).select(F.concat(F.lit("shell:"), "p_type").alias("name"), F.lit("sh").alias("key")).distinct(),
        n.filter(size > 45).select(F.concat(F.lit("fetcher:f"), size % 3, F.lit(":"), F.col("p_type")).alias("name"), F.lit("fe").alias("key")).distinct(),
        n.filter(size > 35).select(F.concat(F.lit("build-cache:c"), F.col("n") % 9, F.lit(":"), F.col("p_type")).alias("name"), F.lit("ca").alias("key")).distinct(),
    ]
    return reduce(DataFrame.unionByName, rows)


def stage_inputs(s, d):
    """(node, ord, kind, key): what buildfrom, pin and buildrun nodes read: lines of the part."""
    line = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("n"), (F.col("l_suppkey") * 13 % 197).alias("m"), F.when(F.col("l_returnflag") == "A", "import").when(F.col("l_returnflag") == "N", "build").otherwise("tree").alias("what")).distinct()
    line = line.groupBy("n", "m").agg(F.min("what").alias("what"))
    reading = stage_nodes(s, d).filter(F.col("kind").isin("buildfrom", "pin", "buildrun")).select("n", "node")
    return line.join(reading.hint("shuffle_hash"), "n").select("node", F.col("m").alias("ord"), F.col("what").alias("kind"), key(F.col("m")).alias("key"))


def pulled(s, d):
    nodes = stage_nodes(s, d).withColumn("fetcher", F.concat(F.lit("f"), F.col("n") % 3)).select("n", "node", "kind", "key", "platform", "fetcher")
    caches = nodes.select("node", F.concat(F.lit("c"), F.col("n") % 9).alias("id"))
    out = r.pull_refs(nodes, stage_inputs(s, d), caches, stage_refs(s, d))
    return out.select("node", F.array_join("names", " ").alias("names"), F.array_join("missing", " ").alias("missing"))


def proposals(s, d):
    line = s.read.parquet(f"{d}/lineitem.parquet")
    n, m = F.col("l_orderkey"), F.col("l_linenumber")
    kind = F.element_at(F.array(*map(F.lit, ("import", *CHAIN, "buildvalue"))), (n % 6 + 1).cast("int"))
    own = r.by_kind(kind, r.OUTPUTS)
    i = F.col("l_partkey") % 12
    name = F.when(i == 0, F.concat(F.lit("build-cache:c"), F.col("l_suppkey") % 3, F.lit(":"), F.when(m > 5, "arm").otherwise("amd"))).when(i == 1, F.concat(F.lit("build-from-tree:"), key(n + 1))).when(i == 2, F.concat(F.lit("build-from-tree:XY"), n)).when(i == 3, F.concat(F.lit("build-output-deps:"), key(n)))
    name = name.when(i == 4, F.concat(F.lit("build-cache:-"), m)).otherwise(F.concat(F.coalesce(own, F.lit("build-value")), F.lit(":"), key(n)))
    return line.select(n.alias("batch"), "l_partkey", "l_suppkey", m.alias("ord"), kind.alias("kind"), key(n).alias("node_key"), F.lit("amd").alias("platform"), name.alias("name"), key(n + F.when(m > 6, 2).otherwise(1)).alias("key"))


def declared(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select(key(F.col("o_orderkey")).alias("build"), F.lit("c1").alias("id"))


def images(s, d):
    ks = parts(s, d).select(key(F.col("p_partkey")).alias("k"))
    n = F.col("p_partkey")
    trees = parts(s, d).filter("p_size % 3 > 0").select(key(n * 2).alias("root"), F.lit("c").alias("path"), key(n + 9).alias("content_key"))
    trees = trees.unionByName(parts(s, d).filter("p_size % 5 = 0").select(key(n + 9).alias("root"), F.lit("JOBS.entrypoint").alias("path"), F.lit("ep").alias("content_key")))
    deps = parts(s, d).select(key(n * 3).alias("root"), F.explode(F.array(key(n + 1), key(n + 2), key(n + 1))).alias("key"))
    defs = parts(s, d).filter("p_size > 8").select(key(n).alias("k"), F.col("p_type").alias("platform"))
    return r.resolve_images(ks, stage_refs(s, d), trees, deps, defs, "linux/amd64")


def labelled(s, d):
    p = stage_nodes(s, d).filter("kind = 'pin'").select("node", F.lit(1).alias("ord"), F.concat(F.lit("build-pinned:"), "key").alias("name"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("recipe "), "n")).alias("label"))
    other = stage_nodes(s, d).filter("kind = 'pin'").select("node", F.lit(0).alias("ord"), F.concat(F.lit("build-from-tree:"), "key").alias("name"), F.lit("no").alias("label"))
    return r.apply_labels(stage_nodes(s, d).select("node", "kind", "label"), stage_edges(s, d), p.unionByName(other))


def tree_rows(s, d):
    names = parts(s, d).select(F.col("p_partkey").alias("node"), F.col("p_name").alias("label"), (F.col("p_size") > 44).alias("closed"))
    out = b.flatten_tree(g.edges(s, d), r_roots(s, d), labels=names)
    return out.select("node", "depth", F.array_join("place", "/").alias("place"))


def r_roots(s, d):
    return graph.graph_roots(g.edges(s, d), g.nodes(s, d))


QUERIES = {
    "done_nodes": lambda s, d: r.done_nodes(stage_nodes(s, d), stage_refs(s, d)).select("node", "kind"),
    "resolve_output_deps": lambda s, d: r.resolve_outputs(parts(s, d).select(key(F.col("p_partkey")).alias("k")), stage_refs(s, d), deps=True),
    "pull_refs": pulled,
    "gate_refs": lambda s, d: r.gate_refs(proposals(s, d), declared(s, d)).select("batch", "ord", "l_partkey", "l_suppkey", "reason", "accepted"),
    "resolve_images": images,
    "apply_labels": labelled,
    "fold_builds": lambda s, d: b.fold_builds(stage_nodes(s, d), stage_edges(s, d)),
    "flatten_labelled_tree": tree_rows,
    "seed_missing": lambda s, d: r.seed_missing(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("name"), F.substring("text", 1, 9).alias("key"), F.col("text").alias("content")), s.read.parquet(f"{d}/documents.parquet").filter("n_chars % 2 = 0").select(F.concat(F.lit("seeded:"), "doc_id", F.lit(":"), F.substring(F.sha2("text", 256), 1, 16)).alias("name"))),
    "broken_aliases": lambda s, d: b.broken_aliases(parts(s, d).select(key(F.col("p_partkey")).alias("f"), key(F.col("p_partkey") + 1).alias("kp")), stage_refs(s, d).withColumn("name", F.regexp_replace("name", "^build-output-deps:", "build-deps:"))),
    "missing_aliases": lambda s, d: b.missing_aliases(parts(s, d).select(key(F.col("p_partkey")).alias("f"), key(F.col("p_partkey") + 1).alias("kp")), stage_refs(s, d).withColumn("name", F.regexp_replace("name", "^build-output-deps:", "build-deps:"))),
    "oversized_generated": lambda s, d: b.oversized_generated(s.read.parquet(f"{d}/conversations.parquet").groupBy(F.col("conv_id").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), F.encode("text", "utf-8")))).alias("generated")), 2000),
    "deal_weighted": lambda s, d: b.deal_weighted(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("round"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"), F.col("l_partkey").alias("size")), [3, 1]).groupBy("round").agg(F.sum(F.when(F.col("channel") == 0, F.col("size"))).alias("first"), F.sum(F.when(F.col("channel") == 1, F.col("size"))).alias("second")),
}

BASE = """st AS (SELECT p_partkey AS n, p_size, p_name, p_type, unnest(CASE WHEN p_partkey % 4 = 3 THEN ['import'] ELSE list_filter(['buildvalue', 'buildfrom', 'pluginresolve', 'pin', 'buildrun'], lambda k: k = 'buildvalue' OR (p_partkey + length(k)) % 5 <> 0) END) AS kind FROM part),
sn AS (SELECT n, kind || '_' || sha256('k' || n) AS node, kind, sha256('k' || n) AS key, p_type AS platform, CASE WHEN n % 3 > 0 THEN p_name END AS label,
  ['waiting', 'queued', 'running', 'publishing', 'done', 'done', 'failed', 'failed-upstream', 'cancelled', 'done'][(p_size * 3 + n + length(kind) * 7) % 10 + 1] AS phase, n * 10 + length(kind) AS elapsed_ms, 'r' || (n % 7) AS runner, n % 6 = 1 AS cached FROM st),
se AS (SELECT a.node, b.node AS dep FROM sn a JOIN sn b ON a.n = b.n AND a.kind = 'buildvalue' AND b.kind NOT IN ('buildvalue', 'import')
  UNION ALL SELECT a.node, b.node FROM sn a JOIN sn b ON b.kind IN ('buildvalue', 'import') AND b.n = CASE a.kind WHEN 'buildfrom' THEN 2 * a.n + 1 WHEN 'buildrun' THEN 2 * a.n + 2 WHEN 'buildvalue' THEN a.n + 5 END),
sr AS MATERIALIZED (SELECT 'build-from:' || sha256('k' || p_partkey) AS name, sha256('k' || (p_partkey + 1)) AS key FROM part WHERE p_size > 10
  UNION ALL SELECT 'build-output:' || sha256('k' || p_partkey), sha256('k' || (p_partkey * 2)) FROM part WHERE p_size > 20
  UNION ALL SELECT 'build-output-deps:' || sha256('k' || p_partkey), sha256('k' || (p_partkey * 3)) FROM part WHERE p_size > 25
  UNION ALL SELECT 'import-output:' || sha256('k' || p_partkey), sha256('k' || (p_partkey * 5)) FROM part WHERE p_size < 15
  UNION ALL SELECT 'build-pinned:' || sha256('k' || p_partkey), sha256('k' || (p_partkey * 7)) FROM part WHERE p_size > 5 AND p_size < 30
  UNION ALL SELECT 'build-plugin-resolved:' || sha256('k' || p_partkey), sha256('k' || (p_partkey * 11)) FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT DISTINCT 'shell:' || p_type, 'sh' FROM part WHERE p_size > 40
  UNION ALL SELECT DISTINCT 'fetcher:f' || (p_size % 3) || ':' || p_type, 'fe' FROM part WHERE p_size > 45
  UNION ALL SELECT DISTINCT 'build-cache:c' || (p_partkey % 9) || ':' || p_type, 'ca' FROM part WHERE p_size > 35)"""

SQL = {
    "done_nodes": f"""WITH {BASE} SELECT node, kind FROM sn WHERE CASE kind WHEN 'import' THEN 'import-output' WHEN 'buildfrom' THEN 'build-from' WHEN 'pluginresolve' THEN 'build-plugin-resolved' WHEN 'pin' THEN 'build-pinned' WHEN 'buildrun' THEN 'build-output' END || ':' || key IN (SELECT name FROM sr)
      UNION ALL SELECT node, kind FROM sn JOIN sr v ON kind = 'buildvalue' AND v.name = 'build-from:' || sn.key WHERE 'build-output:' || v.key IN (SELECT name FROM sr)""",
    "resolve_output_deps": f"WITH {BASE}, x AS (SELECT sha256('k' || p_partkey) AS k, v.key AS f FROM part LEFT JOIN sr v ON v.name = 'build-from:' || sha256('k' || p_partkey)) SELECT k, f, coalesce(a.key, o.key) AS output FROM x LEFT JOIN sr a ON a.name = 'build-output-deps:' || f LEFT JOIN sr o ON o.name = 'build-output-deps:' || k",
    "pull_refs": f"""WITH {BASE}, li AS (SELECT l_partkey AS n, l_suppkey * 13 % 197 AS m, min(CASE l_returnflag WHEN 'A' THEN 'import' WHEN 'N' THEN 'build' ELSE 'tree' END) AS what FROM lineitem GROUP BY 1, 2),
      ip AS (SELECT node, kind, m, what, sha256('k' || m) AS k, v.key AS f FROM sn JOIN li USING (n) LEFT JOIN sr v ON v.name = 'build-from:' || sha256('k' || m) WHERE kind IN ('buildfrom', 'pin', 'buildrun')),
      al AS (SELECT node, 0::BIGINT AS o, 'shell:' || platform AS name, true AS opt, false AS lost FROM sn WHERE kind = 'import'
        UNION ALL SELECT node, 1, 'fetcher:f' || (n % 3) || ':' || platform, true, false FROM sn WHERE kind = 'import'
        UNION ALL SELECT node, 0, 'f-tree/' || key, false, false FROM sn WHERE kind IN ('pluginresolve', 'pin')
        UNION ALL SELECT node, 1, 'build-plugin-resolved:' || key, false, false FROM sn WHERE kind = 'pin'
        UNION ALL SELECT node, 0, 'kp-tree/' || key, false, false FROM sn WHERE kind = 'buildrun'
        UNION ALL SELECT node, 1, 'build-pinned:' || key, false, false FROM sn WHERE kind = 'buildrun'
        UNION ALL SELECT node, 2, 'shell:' || platform, true, false FROM sn WHERE kind IN ('pin', 'buildrun')
        UNION ALL SELECT node, 1099511627776, 'build-cache:c' || (n % 9) || ':' || platform, true, false FROM sn WHERE kind = 'buildrun'
        UNION ALL SELECT node, m * 3 + 3, CASE what WHEN 'import' THEN 'import-output:' WHEN 'tree' THEN 'build-from-tree:' ELSE 'build-from:' END || k, false, what = 'build' AND f IS NULL FROM ip
        UNION ALL SELECT node, m * 3 + 4, 'build-output:' || f, false, false FROM ip WHERE what = 'build' AND f IS NOT NULL
        UNION ALL SELECT node, m * 3 + 5, 'build-output-deps:' || f, false, false FROM ip WHERE what = 'build' AND f IS NOT NULL AND kind <> 'pin'),
      fi AS (SELECT node, name, min(o) AS o, bool_or(lost) AS lost FROM al WHERE NOT opt OR name IN (SELECT name FROM sr) GROUP BY node, name)
      SELECT node, coalesce(string_agg(name, ' ' ORDER BY o, name) FILTER (WHERE NOT lost), '') AS names, coalesce(string_agg(name, ' ' ORDER BY o, name) FILTER (WHERE lost), '') AS missing FROM fi GROUP BY node""",
    "gate_refs": """WITH p AS (SELECT l_orderkey AS batch, l_linenumber AS ord, l_partkey, l_suppkey, l_partkey % 12 AS i, ['import', 'buildfrom', 'pluginresolve', 'pin', 'buildrun', 'buildvalue'][l_orderkey % 6 + 1] AS kind FROM lineitem),
      f AS (SELECT batch, max(sha256('k' || (batch + CASE WHEN ord > 6 THEN 2 ELSE 1 END))) AS f FROM p WHERE kind = 'buildfrom' AND i > 4 GROUP BY batch),
      x AS (SELECT p.*, CASE WHEN i = 0 THEN CASE WHEN kind <> 'buildrun' THEN 'not permitted' WHEN ord > 5 THEN 'other platform' WHEN l_suppkey % 3 <> 1 THEN 'cache not declared' END
        WHEN i = 1 THEN CASE WHEN kind NOT IN ('buildfrom', 'pluginresolve', 'pin') THEN 'not permitted' WHEN ord > 6 THEN 'value is not the name''s key' WHEN kind = 'buildfrom' AND f.f IS DISTINCT FROM sha256('k' || (p.batch + 1)) THEN 'not this batch''s build-from' END
        WHEN i = 2 THEN CASE WHEN kind NOT IN ('buildfrom', 'pluginresolve', 'pin') THEN 'not permitted' ELSE 'no canonical key' END
        WHEN i = 3 THEN CASE WHEN kind <> 'buildrun' THEN 'not permitted' END
        WHEN i = 4 THEN CASE WHEN kind <> 'buildrun' THEN 'not permitted' ELSE 'malformed cache name' END
        WHEN kind = 'buildvalue' THEN 'not permitted' END AS reason FROM p LEFT JOIN f ON p.batch = f.batch)
      SELECT batch, ord, l_partkey, l_suppkey, reason, bool_and(reason IS NULL) OVER (PARTITION BY batch) AS accepted FROM x""",
    "resolve_images": f"""WITH {BASE}, h AS (SELECT sha256('k' || p_partkey) AS k, coalesce(v.key, sha256('k' || p_partkey)) AS f, CASE WHEN p_size > 8 THEN p_type ELSE 'linux/amd64' END AS platform FROM part LEFT JOIN sr v ON v.name = 'build-from:' || sha256('k' || p_partkey)),
      t AS (SELECT sha256('k' || (p_partkey * 2)) AS root, sha256('k' || (p_partkey + 9)) AS artifact FROM part WHERE p_size % 3 > 0), e AS (SELECT sha256('k' || (p_partkey + 9)) AS artifact FROM part WHERE p_size % 5 = 0),
      d AS (SELECT sha256('k' || (p_partkey * 3)) AS root, list_sort([sha256('k' || (p_partkey + 1)), sha256('k' || (p_partkey + 2))]) AS deps FROM part)
      SELECT k, f, t.artifact, coalesce(d.deps, []) AS deps, platform, s.key AS shell, CASE WHEN e.artifact IS NOT NULL THEN 'ep' END AS entrypoint, CASE WHEN o.key IS NULL THEN 'no output' WHEN t.artifact IS NULL THEN 'no artifact' END AS error
      FROM h LEFT JOIN sr o ON o.name = 'build-output:' || f LEFT JOIN sr q ON q.name = 'build-output-deps:' || f LEFT JOIN t ON t.root = o.key LEFT JOIN e ON e.artifact = t.artifact LEFT JOIN d ON d.root = q.key LEFT JOIN sr s ON s.name = 'shell:' || platform""",
    "apply_labels": f"WITH {BASE}, rl AS (SELECT node, 'recipe ' || n AS own FROM sn WHERE kind = 'pin' AND n % 2 = 0), ab AS (SELECT se.node, arg_min(own, dep) AS below FROM se JOIN rl ON dep = rl.node GROUP BY se.node) SELECT sn.node, kind, coalesce(CASE WHEN kind = 'buildvalue' THEN below END, own, label) AS label FROM sn LEFT JOIN rl ON rl.node = sn.node LEFT JOIN ab ON ab.node = sn.node",
    "fold_builds": f"""WITH {BASE}, c AS (SELECT se.node, x.*, list_position(['buildfrom', 'pluginresolve', 'pin', 'buildrun'], x.kind) AS pl, CASE x.kind WHEN 'buildfrom' THEN 'eval' WHEN 'pluginresolve' THEN 'resolve' WHEN 'pin' THEN 'pin' WHEN 'buildrun' THEN 'build' END AS stage FROM se JOIN sn x ON x.node = se.dep WHERE se.node LIKE 'buildvalue%' AND x.kind NOT IN ('buildvalue', 'import')),
      g AS (SELECT node, arg_min(struct_pack(s := stage, e := elapsed_ms, r := runner, l := node_1, x := 'e' || n), pl) FILTER (WHERE phase = 'failed') AS bad, arg_min(struct_pack(s := stage, e := elapsed_ms, r := runner, l := node_1, p := phase), pl) FILTER (WHERE phase IN ('running', 'publishing')) AS run, arg_min(stage, pl) FILTER (WHERE phase = 'queued') AS wait, arg_min(struct_pack(e := elapsed_ms, l := node_1, c := cached), pl) FILTER (WHERE stage = 'build') AS br FROM c GROUP BY node),
      kd AS (SELECT node, dep FROM se WHERE node LIKE 'buildvalue%' OR node LIKE 'import%' UNION SELECT c.node, se.dep FROM c JOIN se ON se.node = c.node_1),
      ch AS (SELECT kd.node, list(kd.dep ORDER BY coalesce(label, ''), kd.dep) AS children FROM kd JOIN sn ON sn.node = kd.dep WHERE sn.kind IN ('buildvalue', 'import') GROUP BY kd.node),
      z AS (SELECT sn.*, g.bad, g.run, g.wait, g.br, children, CASE WHEN kind = 'import' THEN 0 WHEN bad IS NOT NULL THEN 1 WHEN phase IN ('failed', 'cancelled', 'failed-upstream') THEN 2 WHEN run IS NOT NULL THEN 3 WHEN wait IS NOT NULL THEN 4 WHEN phase = 'done' THEN 5 ELSE 6 END AS i FROM sn LEFT JOIN g ON g.node = sn.node LEFT JOIN ch ON ch.node = sn.node WHERE kind IN ('buildvalue', 'import'))
      SELECT node, kind, label, CASE i WHEN 1 THEN 'failed' WHEN 3 THEN run.p WHEN 4 THEN 'queued' WHEN 5 THEN 'done' WHEN 6 THEN 'waiting' ELSE phase END AS phase, CASE i WHEN 0 THEN 'fetch' WHEN 1 THEN bad.s WHEN 3 THEN run.s WHEN 4 THEN wait END AS stage,
        CASE i WHEN 0 THEN elapsed_ms WHEN 1 THEN bad.e WHEN 3 THEN run.e WHEN 5 THEN br.e END AS elapsed_ms, CASE i WHEN 0 THEN runner WHEN 1 THEN bad.r WHEN 3 THEN run.r END AS runner, CASE i WHEN 0 THEN cached WHEN 5 THEN cached OR coalesce(br.c, false) ELSE false END AS cached,
        CASE i WHEN 0 THEN node WHEN 1 THEN bad.l WHEN 3 THEN run.l ELSE br.l END AS log_node, CASE WHEN i IN (0, 2) AND phase = 'failed' THEN 'e' || n WHEN i = 1 THEN bad.x END AS error, coalesce(children, []) AS children FROM z""",
    "flatten_labelled_tree": f"WITH {g.BASE}, f AS (WITH RECURSIVE c AS (SELECT node, 0 AS depth, p_name || chr(1) || node AS place, p_size FROM nd JOIN part ON p_partkey = node WHERE node NOT IN (SELECT dep FROM ed) UNION ALL SELECT ed.dep, depth + 1, place || '/' || p_name || chr(1) || ed.dep, part.p_size FROM c JOIN ed ON c.node = ed.node JOIN part ON p_partkey = ed.dep WHERE c.p_size <= 44) SELECT * FROM c) SELECT node, depth, place FROM f",
    "seed_missing": "WITH n AS (SELECT doc_id::VARCHAR AS name, left(text, 9) AS key, 'seeded:' || doc_id || ':' || left(sha256(text), 16) AS m FROM documents WHERE n_chars % 2 <> 0) SELECT name, key FROM n UNION ALL SELECT m, key FROM n",
    "broken_aliases": f"""WITH {BASE}, nm AS MATERIALIZED (SELECT DISTINCT name FROM sr), m AS (SELECT sha256('k' || p_partkey) AS f, sha256('k' || (p_partkey + 1)) AS kp FROM part)
SELECT f, kp, o.name IS NULL AS no_output, d.name IS NULL AS no_deps FROM m LEFT JOIN nm o ON o.name = 'build-output:' || kp LEFT JOIN nm d ON d.name = 'build-output-deps:' || kp WHERE 'build-output:' || f NOT IN (SELECT name FROM nm) AND (o.name IS NULL OR d.name IS NULL)""",
    "missing_aliases": f"""WITH {BASE}, m AS (SELECT sha256('k' || p_partkey) AS f, o.key AS o, d.key AS d FROM part JOIN sr o ON o.name = 'build-output:' || sha256('k' || (p_partkey + 1)) JOIN sr d ON d.name = 'build-output-deps:' || sha256('k' || (p_partkey + 1)) WHERE 'build-output:' || sha256('k' || p_partkey) NOT IN (SELECT name FROM sr))
      SELECT 1 AS ord, 'build-deps:' || f AS name, d AS key FROM m UNION ALL SELECT 2, 'build-output:' || f, o FROM m""",
    "oversized_generated": "SELECT conv_id AS key, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes FROM conversations GROUP BY conv_id HAVING sum(strlen(text)) > 2000",
}
