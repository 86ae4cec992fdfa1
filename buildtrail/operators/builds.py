"""Pinned builds and their parts: caches, runtime deps, aliases, requirements, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildtrail.functions.scalars import CHAIN, KINDS, STAGES, ns_to_rfc3339, valid_utf8
from buildtrail.lineage import checkpointed
from buildtrail.operators.refs import by_kind


def validate_caches(caches: DataFrame, reserved: tuple[str, ...] = ("/proc", "/sys", "/dev")) -> DataFrame:
    """caches (build, id, path) with reason (NULL: fine): id and path forms, ids or paths twice in a build, a path inside another.

    Nesting is found by joining each path's ancestors with the paths of its build.
    """
    path = F.col("path")
    form = F.when(~F.col("id").rlike("^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), "bad id").when(~path.startswith("/") | path.rlike("//|/[.]{1,2}(/|$)|.+/$"), "bad path").when(path.isin(*reserved), "reserved path")
    same = lambda c: F.count("*").over(Window.partitionBy("build", c)) > 1
    out = caches.withColumn("__id2", same("id")).withColumn("__path2", same("path"))
    ups = caches.select("build", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("up")).filter("up <> path and up <> ''")
    held = caches.select("build", F.col("path").alias("up")).distinct()
    nested = ups.join(held, ["build", "up"], "left_semi").select("build", "path").distinct().withColumn("__in", F.lit(True))
    out = out.join(nested, ["build", "path"], "left")
    reason = F.coalesce(form, F.when(F.col("__id2"), "duplicate id").when(F.col("__path2"), "duplicate path").when(F.col("__in"), "nested path"))
    return out.withColumn("reason", reason).drop("__id2", "__path2", "__in")


def runtime_deps_not_in_inputs(runtime: DataFrame, inputs: DataFrame) -> DataFrame:
    """Declared runtime deps (build, name) that aren't inputs (build, name)."""
    return runtime.join(inputs.select("build", "name"), ["build", "name"], "left_anti")


def runtime_closure(inputs: DataFrame, outputs: DataFrame, deps: DataFrame) -> DataFrame:
    """(build, artifact): the artifact of each input (build, input) and what its flat deps (input, artifact) name, each once."""
    own = inputs.join(outputs, "input").select("build", "artifact")
    return own.unionByName(inputs.join(deps, "input").select("build", "artifact")).distinct()


def missing_aliases(shares: DataFrame, refs: DataFrame) -> DataFrame:
    """shares (f, kp) -> alias rows (ord, name, key) to write for each f without an output whose kp has output and deps: deps first."""
    ref = lambda prefix, c, v: refs.filter(F.col("name").startswith(prefix)).select(F.substring("name", len(prefix) + 1, 1 << 20).alias(c), F.col("key").alias(v))
    lost = shares.join(ref("build-output:", "f", "__o"), "f", "left_anti")
    whole = lost.join(ref("build-output:", "kp", "out"), "kp").join(ref("build-deps:", "kp", "dep"), "kp")
    pair = F.array(F.struct(F.lit(1).alias("ord"), F.concat(F.lit("build-deps:"), "f").alias("name"), F.col("dep").alias("key")), F.struct(F.lit(2).alias("ord"), F.concat(F.lit("build-output:"), "f").alias("name"), F.col("out").alias("key")))
    return whole.select(F.explode(pair).alias("a")).select("a.*")


def broken_aliases(shares: DataFrame, refs: DataFrame) -> DataFrame:
    """(f, kp, no_output, no_deps): shares without an output of their own whose kp lacks its output, its deps or both, so that no alias can be written."""
    has = lambda prefix, c: refs.filter(F.col("name").startswith(prefix)).select(F.substring("name", len(prefix) + 1, 1 << 20).alias(c)).distinct()
    lost = shares.join(has("build-output:", "f"), "f", "left_anti")
    out = lost.join(has("build-output:", "kp").withColumn("__o", F.lit(True)), "kp", "left").join(has("build-deps:", "kp").withColumn("__d", F.lit(True)), "kp", "left")
    return out.select("f", "kp", F.col("__o").isNull().alias("no_output"), F.col("__d").isNull().alias("no_deps")).filter("no_output or no_deps")


def requirement(defaults: DataFrame, pinned: DataFrame, asked: DataFrame) -> DataFrame:
    """Element-wise greatest of a node's default, pinned and asked capacity: each (node, cpu, mem), asked any number of rows."""
    top = asked.groupBy("node").agg(F.max("cpu").alias("c2"), F.max("mem").alias("m2"))
    out = defaults.join(pinned.select("node", F.col("cpu").alias("c1"), F.col("mem").alias("m1")), "node", "left").join(top, "node", "left")
    return out.select("node", F.greatest("cpu", "c1", "c2").alias("cpu"), F.greatest("mem", "m1", "m2").alias("mem"))


def cas_summary(events: DataFrame) -> DataFrame:
    """Per node and day: objects and bytes, those found present, and their share; events (node, day, bytes, present)."""
    have = F.col("present")
    out = events.groupBy("node", "day").agg(F.count("*").alias("objects"), F.count_if(have).alias("deduped"), F.sum("bytes").alias("bytes"), F.sum(F.when(have, F.col("bytes")).otherwise(0)).alias("deduped_bytes"))
    return out.withColumn("ratio", F.round(F.try_divide("deduped_bytes", "bytes"), 6))


def cas_reports(reports: DataFrame) -> DataFrame:
    """Reports of attempts by node and day: what was stored, found present and pushed, and the share of objects that were present.

    reports (node, day, stored_bytes, stored_objects, stored_deduped, pushed, pushed_bytes, pushed_objects, push_total_objects); the push
    columns are NULL where no attempt pushed, and reports without a push add nothing to them. total_objects are those stored and those present.
    """
    pushed = [F.sum(F.when(F.col("pushed"), F.col(c))).alias(c) for c in ("pushed_bytes", "pushed_objects", "push_total_objects")]
    out = reports.groupBy("node", "day").agg(*[F.sum(c).alias(c) for c in ("stored_bytes", "stored_objects", "stored_deduped")], F.count_if("pushed").alias("pushes"), *pushed)
    total = F.col("stored_objects") + F.col("stored_deduped")
    return out.withColumn("total_objects", total).withColumn("dedup_ratio", F.round(F.try_divide("stored_deduped", total), 6))


def transfer_stats(pushes: DataFrame) -> DataFrame:
    """Offered and moved objects and bytes of each ref and MB (10^6) a second; pushes (ref, bytes, moved, seconds)."""
    moved = F.col("moved")
    out = pushes.groupBy("ref").agg(F.count("*").alias("offered"), F.count_if(moved).alias("moved"), F.sum(F.when(moved, F.col("bytes")).otherwise(0)).alias("bytes"), F.sum("seconds").alias("seconds"))
    return out.select("ref", "offered", "moved", "bytes", F.round(F.try_divide(F.col("bytes") / 1e6, "seconds"), 6).alias("mb_s"))


def cache_stats(events: DataFrame) -> DataFrame:
    """Per cache: events, share of cold ones, counts by result; events (cache, cold, result)."""
    counts = [F.count_if(F.col("result") == r).alias(r) for r in ("updated", "unchanged", "empty")]
    return events.groupBy("cache").agg(F.count("*").alias("n"), F.round(F.avg(F.col("cold").cast("double")), 6).alias("cold_rate"), *counts)


def cache_stages(events: DataFrame) -> DataFrame:
    """Per cache, its seeds and its finalisations apart: number, ms, bytes and files; the share of cold seeds, finalisations by result.

    events (cache, stage, ms, bytes, files, cold, result); cold belongs to ``seeded``, result to ``finalized``; other stages count nowhere.
    """
    of = lambda stage: F.col("stage") == stage
    sums = [F.sum(F.when(of(stage), F.col(c)).otherwise(0)).alias(f"{stage}_{c}") for stage in ("seeded", "finalized") for c in ("ms", "bytes", "files")]
    results = [F.count_if(of("finalized") & (F.col("result") == r)).alias(r) for r in ("updated", "unchanged", "empty")]
    cold = F.round(F.avg(F.when(of("seeded"), F.col("cold").cast("double"))), 6).alias("cold_rate")
    return events.groupBy("cache").agg(F.count_if(of("seeded")).alias("seeds"), F.count_if(of("finalized")).alias("finals"), cold, *sums, *results)


def store_stats(refs: DataFrame, requests: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """One row: counts of refs, requests, nodes and the bytes of files."""
    count = lambda d, c: d.agg(F.count("*").alias(c))
    return count(refs, "refs").crossJoin(count(requests, "requests")).crossJoin(count(nodes, "nodes")).crossJoin(files.agg(F.sum("size").alias("bytes")))


def first_error(membership: DataFrame, nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """The first failed node's text of each request by name, else the request's own reason; nodes (node, phase, error)."""
    bad = membership.join(nodes.filter("phase = 'failed' and error is not null"), "node").groupBy("request").agg(F.min_by("error", "node").alias("__e"))
    return requests.join(bad, "request", "left").select("request", F.coalesce("__e", "fail_reason").alias("error"))


def memo_hits(builds: DataFrame) -> DataFrame:
    """builds (f, kp): cover identities that several f share, and the runs they save."""
    return builds.groupBy("kp").agg(F.countDistinct("f").alias("fs"), F.min("f").alias("first_f")).filter("fs > 1").withColumn("saved", F.col("fs") - 1)


def flatten_tree(edges: DataFrame, roots: DataFrame, most_depth: int = 64, labels: DataFrame | None = None) -> DataFrame:
    """(path array, node, depth, place): a row for each path from a root; shared subtrees repeat, nodes already on the path are cut.

    labels (node, label, closed) gives siblings their order (by label, then name; place holds the keys, so that ordering by place is the
    order of reading) and keeps closed nodes, those done from a cache, from being expanded. Joins are merged: none passes through the driver.
    """
    names = roots.select("node").union(edges.select("dep")).distinct() if labels is None else labels
    has = set(names.columns)
    label = F.coalesce("label", F.lit("")) if "label" in has else F.lit("")
    closed = F.coalesce("closed", F.lit(False)) if "closed" in has else F.lit(False)
    facts = names.select(F.col("node"), F.concat(label, F.lit(chr(1)), F.col("node").cast("string")).alias("rank"), closed.alias("closed")).hint("merge")
    level = roots.join(facts, "node").select(F.array("node").alias("path"), "node", F.lit(0).alias("depth"), F.array("rank").alias("place"), "closed")
    level = checkpointed(level)
    out = level
    for depth in range(1, most_depth + 1):
        grown = level.filter("not closed").drop("closed").join(edges.hint("merge"), "node").filter(~F.array_contains("path", F.col("dep")))
        level = grown.select(F.concat("path", F.array("dep")).alias("path"), F.col("dep").alias("node"), F.lit(depth).alias("depth"), "place").join(facts, "node")
        level = checkpointed(level.select("path", "node", "depth", F.concat("place", F.array("rank")).alias("place"), "closed"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("closed")


def deal_round_robin(wants: DataFrame, key: str, channels: int) -> DataFrame:
    """wants (round, key): each key's channel by its place in its round."""
    w = Window.partitionBy("round").orderBy(key)
    return wants.withColumn("channel", (F.row_number().over(w) - 1) % channels)


def split_undecodable(raw: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON texts that decode (as column ``value``) and those that don't; none is fatal."""
    read = F.from_json(column, f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    parsed = raw.withColumn("value", read)
    bad = F.col("value").isNull() | F.col("value.__bad").isNotNull()
    return parsed.filter(~bad).withColumn("value", F.col("value").dropFields("__bad")), parsed.filter(bad).drop("value")


def diagnosis_json(attempts: DataFrame, fields: list[str]) -> DataFrame:
    """(node, report): each node's attempts, newest first, as JSON without empty fields."""
    row = F.struct((-F.col("gen")).alias("__o"), F.struct(*fields).alias("a"))
    listed = F.transform(F.sort_array(F.collect_list(row)), lambda x: x["a"])
    return attempts.groupBy("node").agg(listed.alias("attempts")).select("node", F.to_json(F.struct("node", "attempts")).alias("report"))


def diagnosis_report(attempts: DataFrame, fields: list[str], times: tuple[str, ...] = (), logs: tuple[str, ...] = ()) -> DataFrame:
    """As ``diagnosis_json``, with times (ns) as RFC3339 text and logs (binary) as valid UTF-8; empty texts, empty logs and times of 0 are left out."""
    rows = attempts
    for c in times:
        rows = rows.withColumn(c, F.when(F.col(c) != 0, ns_to_rfc3339(c)))
    for c in logs:
        rows = rows.withColumn(c, valid_utf8(c))
    for c in [*fields, *logs]:
        if dict(rows.dtypes)[c] == "string":
            rows = rows.withColumn(c, F.nullif(F.col(c), F.lit("")))
    return diagnosis_json(rows, [*fields, *times, *logs])


def node_kind(c: Column) -> Column:
    return F.when(F.substring_index(c, "_", 1).isin(*KINDS), F.substring_index(c, "_", 1))


def oversized_generated(pinned: DataFrame, cap: int = 1 << 20) -> DataFrame:
    """pinned (key, generated map<string,binary>) whose inline files have more than cap bytes, with their sum."""
    size = F.aggregate(F.map_values("generated"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)))
    return pinned.select("key", F.coalesce(size, F.lit(0).cast("long")).alias("bytes")).filter(F.col("bytes") > cap)


def fold_builds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each buildvalue and import: (node, kind, label, phase, stage, elapsed_ms, runner, cached, log_node, error, children).

    A buildvalue's stages are the nodes it depends on. The first stage that failed speaks for it; else its own failure or
    cancellation; else the first running or publishing stage, then the first queued one; else it is done or waiting. Children are the
    builds and imports that it or its stages depend on, by label, then name. nodes (node, kind, label, phase, elapsed_ms, runner, cached, error).
    Joins are merged: none passes through the driver.
    """
    logical = F.col("kind").isin("buildvalue", "import")
    place = F.coalesce(by_kind(F.col("kind"), {k: str(i) for i, k in enumerate(CHAIN)}).cast("int"), F.lit(len(CHAIN)))
    facts = F.struct(place.alias("place"), by_kind(F.col("kind"), STAGES).alias("stage"), "phase", "elapsed_ms", "runner", "error", F.col("node").alias("log_node"), "cached")
    pairs = edges.join(nodes.filter(logical).select("node").hint("merge"), "node", "left_semi")
    stages = pairs.join(nodes.filter(~logical).select(F.col("node").alias("dep"), facts.alias("f")).hint("merge"), "dep")
    first = lambda *phases: F.min(F.when(F.col("f.phase").isin(*phases), F.col("f")))
    chain = stages.groupBy("node").agg(first("failed").alias("bad"), first("running", "publishing").alias("run"), first("queued").alias("wait"), F.max(F.when(F.col("f.stage") == "build", F.col("f"))).alias("br"))
    kids = nodes.filter(logical).select(F.col("node").alias("dep"), F.struct(F.coalesce("label", F.lit("")).alias("label"), F.col("node").alias("name")).alias("kid")).hint("merge")
    below = stages.select("node", F.col("dep").alias("via")).join(edges.select(F.col("node").alias("via"), "dep").hint("merge"), "via").select("node", "dep")
    children = pairs.unionByName(below).join(kids, "dep").groupBy("node").agg(F.transform(F.sort_array(F.collect_set("kid")), lambda k: k["name"]).alias("children"))
    out = nodes.filter(logical).join(chain.hint("merge"), "node", "left").join(children.hint("merge"), "node", "left")
    is_import, own_end = F.col("kind") == "import", F.col("phase").isin("failed", "cancelled", "failed-upstream")
    bad, run, wait = F.col("bad").isNotNull(), F.col("run").isNotNull(), F.col("wait").isNotNull()
    done = F.col("phase") == "done"

    def pick(own: Column, failed: Column, ended: Column, running: Column, queued: Column, finished: Column, waiting: Column) -> Column:
        return F.when(is_import, own).when(bad, failed).when(own_end, ended).when(run, running).when(wait, queued).when(done, finished).otherwise(waiting)

    no = F.lit(None)
    return out.select(
        "node",
        "kind",
        "label",
        pick(F.col("phase"), F.lit("failed"), F.col("phase"), F.col("run.phase"), F.lit("queued"), F.lit("done"), F.lit("waiting")).alias("phase"),
        pick(F.lit(STAGES["import"]), F.col("bad.stage"), no, F.col("run.stage"), F.col("wait.stage"), no, no).alias("stage"),
        pick(F.col("elapsed_ms"), F.col("bad.elapsed_ms"), no, F.col("run.elapsed_ms"), no, F.col("br.elapsed_ms"), no).alias("elapsed_ms"),
        pick(F.col("runner"), F.col("bad.runner"), no, F.col("run.runner"), no, no, no).alias("runner"),
        pick(F.col("cached"), F.lit(False), F.lit(False), F.lit(False), F.lit(False), F.col("cached") | F.coalesce("br.cached", F.lit(False)), F.lit(False)).alias("cached"),
        pick(F.col("node"), F.col("bad.log_node"), F.col("br.log_node"), F.col("run.log_node"), F.col("br.log_node"), F.col("br.log_node"), F.col("br.log_node")).alias("log_node"),
        pick(F.col("error"), F.col("bad.error"), F.col("error"), no, no, no, no).alias("error"),
        F.coalesce("children", F.array().cast("array<string>")).alias("children"),
    )


def deal_weighted(wants: DataFrame, weights: list[int]) -> DataFrame:
    """wants (round, key, size) with channel: in key order, each key goes where assigned bytes over weight are least, ties to the lower channel.

    Weights under 1 count as 1. A round (of bounded size) is dealt as its rows stream by; only the channels' sums are kept.
    """
    weights = [max(1, w) for w in weights]
    rows = wants.select("round", "key", F.col("size").cast("long").alias("size")).withColumn("channel", F.lit(0))
    rows = rows.repartition(F.col("round")).sortWithinPartitions("round", "key")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, [0] * len(weights)
        for batch in batches:
            channels = []
            for r, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if r != now:
                    now, sums = r, [0] * len(weights)
                i = min(range(len(weights)), key=lambda c: (sums[c] / weights[c], c))  # noqa: B023
                sums[i] += size or 0
                channels.append(i)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(channels, pa.int32())], names=batch.schema.names)

    return rows.mapInArrow(deal, rows.schema)
