"""Queries that write the driver's tables as the library's own and read them back, and scalar functions over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildtrail.functions import scalars as x
from buildtrail.lineage import shared_folder
from buildtrail.operators import logs, refs
from buildtrail.plans import graph as g
from buildtrail.plans import store as st
from buildtrail.plans import telemetry as t
from buildtrail.sources import stores, tables


def fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def event_rows(s, d) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    return t.events(s, d).select(text("emitter"), text("boot"), F.col("seq").cast("long"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), "type", text("node"), F.col("props").alias("data"))


def events_back(s, d):
    path = fresh(s)
    event_rows(s, d).write.parquet(path)
    return tables.read_events(s, path).select("emitter", "seq", "ts_ns", "type", "node", "data", F.col("runner").isNull().alias("no_runner"))


def batches_back(s, d):
    path = fresh(s)
    event_rows(s, d).groupBy("emitter", F.floor(F.col("seq") / 64)).agg(F.to_json(F.collect_list(F.struct("emitter", "boot", "seq", "ts_ns", "type", "node", "data"))).alias("value")).select("value").write.text(path)
    return tables.read_events(s, path, "batches").select("emitter", "seq", "ts_ns", "type", "data")


def bad_batches(s, d):
    """Batches in which every seventh event has a text for a number, and every fifth line is cut off: what doesn't decode."""
    path = fresh(s)
    seq = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("x"), F.col("seq"))).otherwise(F.col("seq").cast("string"))
    item = F.concat(F.lit('{"emitter":"'), "emitter", F.lit('","seq":'), F.when(F.col("seq") % 7 == 0, F.concat(F.lit('"'), seq, F.lit('"'))).otherwise(seq), F.lit("}"))
    lines = event_rows(s, d).groupBy("emitter", F.floor(F.col("seq") / 64).alias("b")).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("v"), F.count("*").alias("n"))
    lines.select(F.concat(F.lit("["), "v", F.when((F.col("b") + F.length("emitter")) % 5 == 0, "").otherwise("]")).alias("value")).write.text(path)
    events, bad = tables.read_event_batches(s, path)
    return events.agg(F.count("*").alias("events"), F.sum("seq").alias("seqs")).crossJoin(bad.agg(F.count("*").alias("bad"), F.count_if(F.startswith("value", F.lit("["))).alias("lines")))


def object_rows(s, d, keep):
    return st.docs(s, d).filter(keep).groupBy("key").agg(F.max("size").alias("size"))


def bucketed(s, d):
    """A store of the even documents in a table of buckets; returns its name."""
    name = f"store_{uuid.uuid4().hex}"
    stores.create_store(object_rows(s, d, "doc_id % 2 = 0"), name, 8, fresh(s))
    return name


def store_grown(s, d):
    name = bucketed(s, d)
    for _ in range(2):  # the second time adds nothing
        stores.append_to_store(s, name, st.docs(s, d).filter("doc_id % 3 = 0"))
    return s.table(name)


def store_missing(s, d):
    return stores.missing_in_store(s, bucketed(s, d), st.docs(s, d))


def snapshots(s, d):
    """Refs through two versions on disk, with the names that the second doesn't delete for want of them."""
    path = fresh(s)
    current = st.now_refs(s, d)
    stores.write_snapshot(current, path)
    updates = st.expected(s, d).select(F.when(F.length("key") % 3 == 0, F.concat("name", F.lit("-new"))).otherwise(F.col("name")).alias("name"), "key", F.lit("1998-01-01").cast("timestamp").alias("created"), F.expr("length(key) % 2 = 0").alias("deleted"))
    stores.write_snapshot(refs.upsert_refs(stores.read_snapshot(s, path), updates), path, 1)
    kept = stores.read_snapshot(s, path).select("name", "key", F.lit("ref").alias("what"))
    return kept.unionByName(refs.missing_deletes(stores.read_snapshot(s, path, 1), updates).select("name", "key", F.lit("missing").alias("what")))


def results_back(s, d):
    path = fresh(s)
    a = t.attempts(s, d)
    use = F.struct((F.col("wall") * 100).cast("long").alias("wall_ns"), F.col("cpu").cast("long").alias("cpu_ns"))
    a.select(F.col("node").cast("string"), F.col("gen").cast("long"), F.col("runner").cast("string"), "class", use.alias("rusage")).write.json(path)
    return tables.read_results(s, path, "json").select("node", "gen", "runner", "class", "rusage.cpu_ns", F.col("rusage.max_rss").isNull().alias("no_rss"))


def failures_back(s, d):
    path = fresh(s)
    t.trail(s, d).filter("class <> 'ok'").select(F.col("node").cast("string"), F.col("gen").cast("long"), "disposition", "backoff_ms", "class").write.parquet(path)
    return tables.read_failures(s, path).select("node", "gen", "class", "disposition", "backoff_ms")


def chunks_back(s, d):
    path = fresh(s)
    st.chunks(s, d).select(F.col("node").cast("string"), F.col("gen").cast("long"), "stream", F.col("seq").cast("long"), "data").write.parquet(path)
    return tables.read_log_chunks(s, path).select("node", "gen", "stream", "seq", F.octet_length("data").alias("bytes"))


def logs_back(s, d):
    path = fresh(s)
    tables.write_attempt_logs(logs.log_view(st.chunks(s, d), 40, 60).select("node", "gen", "head", "tail"), path)
    return s.read.parquet(path).select(F.col("node").cast("long").alias("node"), F.col("gen").cast("long").alias("gen"), "part", F.octet_length("data").alias("bytes"))


def tree_back(s, d):
    path = fresh(s)
    s.read.parquet(f"{d}/pages.parquet").select(F.col("html").alias("value"), F.concat(F.lit("p"), F.col("page_id") % 7).alias("dir")).write.partitionBy("dir").option("lineSep", "\n").text(path)
    found = tables.read_tree(s, path).filter("path like '%/part-%'")
    return found.select(F.substring_index("path", "/", 1).alias("dir"), "size").groupBy("dir").agg(F.sum("size").alias("bytes"))


def orders(s, d):
    return s.read.parquet(f"{d}/orders.parquet")


def scalar_texts(s, d):
    n = F.col("o_orderkey").cast("long")
    ns = n.cast("decimal(20,0)") * F.lit(1_234_567_891_000).cast("decimal(14,0)") + F.col("o_custkey")  # beyond a long from 7.5 million orders on
    path = F.element_at(F.array(F.lit("//top/a"), F.lit("../b"), F.lit("/abs"), F.lit("../../.."), F.lit("c/./d")), (n % 5 + 1).cast("int"))
    named = F.array(F.struct(F.concat(F.lit("n"), n % 3).alias("name"), n.alias("v")), F.struct(F.lit("n1").alias("name"), (n + 1).alias("v")), F.struct(F.lit("a").alias("name"), (n + 2).alias("v")))
    id_ = x.message_id("job", F.col("o_custkey").cast("string"), n)
    return orders(s, d).select(
        "o_orderkey",
        x.format_bytes(n * n * 1000, "T").alias("decimal"),
        x.ns_to_rfc3339(ns).alias("time"),
        x.normalize_source_path(path, F.lit("d/e")).alias("path"),
        F.array_join(F.transform(x.canonical_by_name(named), lambda a: F.concat(a["name"], F.lit("="), a["v"])), ",").alias("named"),
        x.attempt_timing_text(n % 100, F.when(n % 2 == 0, n)).alias("timing"),
        x.rusage_text(n % 50, (n % 3) * 1048576).alias("usage"),
        x.finish_outcome(F.when(n % 3 == 0, "ok").when(n % 3 == 1, "cancelled").otherwise("hard")).alias("outcome"),
        x.parse_message_id(id_)["gen"].alias("gen"),
        F.concat(x.kp_tree_ref(F.col("o_custkey").cast("string")), x.f_tree_ref(n.cast("string"))).alias("refs"),
        F.size(x.requests_of(F.concat(F.lit('{"requests":["a","'), n, F.lit('"]}')))).alias("requests"),
    )


def trimmed(s, d):
    half = F.floor(F.col("n_chars") / 2).cast("int")
    docs = s.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    whole = docs.select("doc_id", F.encode(F.substring("text", F.lit(1), half), "utf-8").alias("h"), F.encode(F.substring(F.col("text"), half + 1, F.col("n_chars").cast("int")), "utf-8").alias("t"))
    cut = whole.select("doc_id", x.trim_snapshot("h", F.lit(3), "t", 50, 70).alias("s"))
    return cut.select("doc_id", F.octet_length("s.head").alias("head"), "s.gap", F.octet_length("s.tail").alias("tail"), F.length(x.assemble_log(F.lit(b"").cast("binary"), "s.gap", F.lit(b"").cast("binary"))).alias("line"))


QUERIES = {
    "read_events": events_back,
    "read_event_batches": batches_back,
    "undecodable_batches": bad_batches,
    "append_to_store": store_grown,
    "missing_in_store": store_missing,
    "ref_snapshots": snapshots,
    "read_results": results_back,
    "read_failures": failures_back,
    "read_log_chunks": chunks_back,
    "write_attempt_logs": logs_back,
    "read_tree": tree_back,
    "scalar_texts": scalar_texts,
    "trim_snapshot": trimmed,
    "phases": lambda s, d: g.nodes(s, d).select("node", x.is_active("phase").alias("active"), x.is_terminal("phase").alias("terminal")),
}

EV = f"WITH {t.EVENTS_SQL}"
AGE = "CASE WHEN {0} < 60 THEN {0} || 's' WHEN {0} < 3600 THEN ({0} // 60) || 'm' || lpad(({0} % 60)::VARCHAR, 2, '0') || 's' WHEN {0} < 86400 THEN ({0} // 3600) || 'h' || lpad(({0} // 60 % 60)::VARCHAR, 2, '0') || 'm' ELSE ({0} // 86400) || 'd' || lpad(({0} // 3600 % 24)::VARCHAR, 2, '0') || 'h' END"
OBJECTS = "ob AS (SELECT doc_id, sha256(text) AS key, strlen(text) AS size FROM documents)"
SQL = {
    "undecodable_batches": f"{EV}, ln AS (SELECT emitter, seq // 64 AS b, count(*) AS n, count(*) FILTER (WHERE seq % 7 = 0) AS wrong, coalesce(sum(seq) FILTER (WHERE seq % 7 <> 0), 0) AS s, (seq // 64 + length(emitter::VARCHAR)) % 5 = 0 AS cut FROM ev GROUP BY ALL) SELECT sum(CASE WHEN cut THEN 0 ELSE n - wrong END)::BIGINT AS events, sum(CASE WHEN cut THEN 0 ELSE s END)::BIGINT AS seqs, sum(CASE WHEN cut THEN 1 ELSE wrong END)::BIGINT AS bad, count(*) FILTER (WHERE cut) AS lines FROM ln",
    "append_to_store": f"WITH {OBJECTS} SELECT key, max(size) AS size FROM ob WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 GROUP BY key",
    "missing_in_store": f"WITH {OBJECTS} SELECT DISTINCT key FROM ob WHERE key NOT IN (SELECT key FROM ob WHERE doc_id % 2 = 0)",
    "ref_snapshots": f"WITH {st.REF}, up AS (SELECT CASE WHEN length(key) % 3 = 0 THEN name || '-new' ELSE name END AS name, key, TIMESTAMP '1998-01-01' AS created, length(key) % 2 = 0 AS deleted FROM ex), u AS (SELECT name, key, created, false AS deleted FROM cr UNION ALL SELECT * FROM up) SELECT name, key, 'ref' AS what FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY name ORDER BY created DESC, key DESC) = 1) WHERE NOT deleted UNION ALL SELECT name, key, 'missing' FROM up WHERE deleted AND name NOT IN (SELECT name FROM cr)",
    "read_events": f"{EV} SELECT emitter::VARCHAR AS emitter, seq, epoch_us(ts) * 1000 AS ts_ns, type, node::VARCHAR AS node, props AS data, true AS no_runner FROM ev",
    "read_event_batches": f"{EV} SELECT emitter::VARCHAR AS emitter, seq, epoch_us(ts) * 1000 AS ts_ns, type, props AS data FROM ev",
    "read_results": f"WITH {t.ATTEMPTS_SQL} SELECT node::VARCHAR AS node, gen, runner::VARCHAR AS runner, class, trunc(cpu)::BIGINT AS cpu_ns, true AS no_rss FROM att",
    "read_failures": f"WITH {t.TRAIL_SQL} SELECT node::VARCHAR AS node, gen, class, disposition, backoff_ms FROM walk WHERE class <> 'ok'",
    "read_log_chunks": "SELECT conv_id::VARCHAR AS node, turn // 4 AS gen, role AS stream, turn AS seq, strlen(text) AS bytes FROM conversations",
    "write_attempt_logs": """WITH c AS (SELECT conv_id AS node, turn // 4 AS gen, strlen(text) AS n, max(turn // 4) OVER (PARTITION BY conv_id) AS top FROM conversations), v AS (SELECT node, gen, sum(n)::BIGINT AS n FROM c WHERE gen = top GROUP BY node, gen)
      SELECT node, gen, 'head' AS part, least(n, 40) AS bytes FROM v WHERE n > 0 UNION ALL SELECT node, gen, 'tail', least(n - 40, 60) FROM v WHERE n > 40""",
    "read_tree": "SELECT 'dir=p' || (page_id % 7) AS dir, sum(strlen(html) + 1)::BIGINT AS bytes FROM pages GROUP BY 1",
    "scalar_texts": f"""WITH o AS (SELECT o_orderkey, o_orderkey::BIGINT AS n, o_custkey, o_orderkey::BIGINT * o_orderkey * 1000 AS b, o_orderkey::HUGEINT * 1234567891000 + o_custkey AS ns FROM orders)
      SELECT o_orderkey, CASE WHEN b >= 1000000000000 THEN printf('%.1f TB', round_even(b / 1e12, 1)) WHEN b >= 1000000000 THEN printf('%.1f GB', round_even(b / 1e9, 1)) WHEN b >= 1000000 THEN printf('%.1f MB', round_even(b / 1e6, 1)) WHEN b >= 1000 THEN printf('%.1f kB', round_even(b / 1e3, 1)) ELSE b || ' B' END AS decimal,
        strftime(make_timestamp((ns // 1000)::BIGINT), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ns % 1000000000 = 0 THEN '' ELSE '.' || rtrim(lpad((ns % 1000000000)::VARCHAR, 9, '0'), '0') END || 'Z' AS time,
        ['top/a', 'd/b', NULL, NULL, 'd/e/c/d'][n % 5 + 1] AS path, CASE n % 3 WHEN 0 THEN 'a=' || (n + 2) || ',n0=' || n || ',n1=' || (n + 1) WHEN 1 THEN 'a=' || (n + 2) || ',n1=' || n ELSE 'a=' || (n + 2) || ',n1=' || (n + 1) || ',n2=' || n END AS named,
        'queued ' || {AGE.format('(n % 100)')} || CASE WHEN n % 2 = 0 THEN ', ran ' || {AGE.format('n')} ELSE '' END AS timing,
        concat_ws(', ', CASE WHEN n % 50 > 0 THEN 'cpu ' || {AGE.format('(n % 50)')} END, CASE WHEN n % 3 > 0 THEN 'rss ' || (n % 3) || '.0 MiB' END) AS usage, CASE n % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'cancelled' ELSE 'failed' END AS outcome, n AS gen, 'kp-tree/' || o_custkey || 'f-tree/' || n AS refs, 2 AS requests FROM o""",
    "trim_snapshot": """WITH x AS (SELECT doc_id, strlen(left(text, (n_chars // 2)::INT)) AS h, strlen(text) - strlen(left(text, (n_chars // 2)::INT)) AS t FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, least(h, 50) AS head, 3 + h - least(h, 50) + t - least(t, 70) AS gap, least(t, 70) AS tail FROM x)
      SELECT doc_id, head, gap, tail, length(gap::VARCHAR) + 26 AS line FROM y""",
    "phases": f"WITH {g.BASE} SELECT node, phase IN ('queued', 'running', 'publishing') AS active, phase IN ('done', 'failed', 'failed-upstream', 'cancelled') AS terminal FROM nd",
}
