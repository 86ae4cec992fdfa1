"""The dependency graph: closures, derived failures, progress of requests. edges: (node, dep)."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildtrail.functions.scalars import ACTIVE, phase_rank
from buildtrail.lineage import checkpointed
from buildtrail.operators.ranks import ranked, runs_of


FRONTS, HOPS = 16, 3


def closure(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """roots (root, node) -> (root, node): all that each root reaches, its own nodes included, each once. Ends on cycles too.

    A round takes ``HOPS`` steps and writes only what it found; found rows are written together once in ``FRONTS`` rounds. With
    ``most``, a closure that takes as many steps and isn't done is an error. Joins are merged, here and in transfers: rows of one short
    column are taken for less than they are, and would pass whole through the driver.
    """
    front = checkpointed(roots.select("root", "node").distinct())
    seen = [front]
    for i in count():
        steps = [front]
        for _ in range(HOPS):
            steps.append(steps[-1].join(edges.hint("merge"), "node").select("root", F.col("dep").alias("node")).distinct())
        found = reduce(DataFrame.unionByName, [x.withColumn("step", F.lit(n)) for n, x in enumerate(steps) if n])
        found = found.groupBy("root", "node").agg(F.min("step").alias("step"))
        found = checkpointed(found.join(reduce(DataFrame.unionByName, seen).hint("merge"), ["root", "node"], "left_anti"))
        far = found.agg(F.max("step")).first()[0]
        if far is None:
            break
        if most is not None and i * HOPS + far >= most:
            raise RuntimeError(f"the closure isn't done after {most} steps")
        new = found.select("root", "node")
        seen = [checkpointed(reduce(DataFrame.unionByName, [*seen, new]))] if len(seen) == FRONTS else [*seen, new]
        if far < HOPS:
            break
        front = found.filter(F.col("step") == HOPS).select("root", "node")  # what was found earlier has been gone on from
    return reduce(DataFrame.unionByName, seen)


def failed_upstream(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes neither done nor failed that some failed node is reachable from: one reverse walk for the whole graph."""
    back = edges.select(F.col("dep").alias("node"), F.col("node").alias("dep"))
    failed = nodes.filter("phase = 'failed'").select(F.lit(0).alias("root"), "node")
    hit = closure(back, failed).select("node").distinct()
    return nodes.filter(~F.col("phase").isin("done", "failed")).join(hit, "node", "left_semi")


def request_nodes(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """(request, node): each request's target and all it needs. Closures are walked once for each target, not for each request."""
    targets = requests.select(F.col("target").alias("root"), F.col("target").alias("node")).distinct()
    return requests.select("request", F.col("target").alias("root")).join(closure(edges, targets), "root").select("request", "node")


def target_nodes(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """(request, node) as ``request_nodes``, with the target in place of the request: each target once, however many requests share it."""
    targets = requests.select(F.col("target").alias("root"), F.col("target").alias("node")).distinct()
    return closure(edges, targets).select(F.col("root").alias("request"), "node")


def for_requests(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """What was worked out for each target (rows, request: the target) as rows of each request of that target."""
    return requests.select("request", F.col("target").alias("_target")).join(rows.withColumnRenamed("request", "_target"), "_target").select(*rows.columns)


def ready_nodes(nodes: DataFrame, edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Waiting nodes all of whose deps are done (or that have none).

    A kind column of nodes leaves out buildvalue nodes, which are never placed; ``wanted`` (node) keeps those that a live request wants.
    """
    done = nodes.select(F.col("node").alias("dep"), (F.col("phase") == "done").alias("ok"))
    state = edges.join(done, "dep", "left").groupBy("node").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    waiting = nodes.filter("phase = 'waiting'")
    waiting = waiting.filter("kind <> 'buildvalue'") if "kind" in nodes.columns else waiting
    waiting = waiting if wanted is None else waiting.join(wanted.select("node").distinct(), "node", "left_semi")
    return waiting.join(state, "node", "left").filter(F.coalesce("ok", F.lit(True))).drop("ok")


def _core(edges: DataFrame) -> DataFrame:
    """edges less the nodes without a way in or out, peeled off until none is left."""
    left = checkpointed(edges.select("node", "dep").distinct())
    size = left.count()
    while True:
        outs, ins = left.select(F.col("node").alias("dep")).distinct(), left.select(F.col("dep").alias("node")).distinct()
        left = checkpointed(left.join(outs, "dep", "left_semi").join(ins, "node", "left_semi").select("node", "dep"))
        now = left.count()
        if now == size:
            return left
        size = now


def find_cycles(edges: DataFrame) -> DataFrame:
    """(node, component, next): the nodes on cycles; component is the least node that each can reach and be reached from.

    Following next from any node leads by a shortest way to the component's least node, and from there round a cycle
    back to it, so it is a chain that shows the cycle. Forward-backward colouring: the least label flows down the edges; a
    label's own node and what reaches it within its colour form one component; these leave, and the rest is coloured anew.
    """
    left, out = _core(edges), None
    while not left.isEmpty():
        colour = checkpointed(left.select("node", F.col("node").alias("label")).distinct())
        while True:
            flow = left.join(colour, "node").groupBy(F.col("dep").alias("node")).agg(F.min("label").alias("new"))
            step = checkpointed(colour.join(flow, "node", "left").select("node", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("moved")))
            colour = step.select("node", "label")
            if step.filter("moved").isEmpty():
                break
        inside = left.join(colour, "node").join(colour.select(F.col("node").alias("dep"), F.col("label").alias("other")), "dep").filter("label = other").select("label", "node", "dep")
        inside = checkpointed(inside)
        front = colour.filter("node = label").select("label", "node").withColumn("far", F.lit(0)).withColumn("next", F.col("node"))
        seen = front
        while True:  # backwards from each label's node, within its colour
            near = inside.join(front.select("label", F.col("node").alias("dep"), "far"), ["label", "dep"]).groupBy("label", "node").agg((F.min("far") + 1).alias("far"), F.min("dep").alias("next"))
            front = checkpointed(near.join(seen, ["label", "node"], "left_anti"))
            if front.isEmpty():
                break
            seen = checkpointed(seen.unionByName(front))
        home = inside.join(seen.select("label", F.col("node").alias("dep"), "far"), ["label", "dep"]).filter("node = label").groupBy("label").agg(F.min_by("dep", F.struct("far", "dep")).alias("home"))
        found = seen.join(home, "label").select("node", F.col("label").alias("component"), F.when(F.col("node") == F.col("label"), F.col("home")).otherwise(F.col("next")).alias("next"))
        found = checkpointed(found)
        out = found if out is None else out.unionByName(found)
        done = colour.filter("node = label").select("node").unionByName(found.select("node")).distinct()
        left = _core(left.join(done, "node", "left_anti").join(done.select(F.col("node").alias("dep")), "dep", "left_anti"))
    return out if out is not None else edges.select("node", F.col("node").alias("component"), F.col("dep").alias("next")).limit(0)


def graph_roots(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Nodes that no node depends on; where there are none at all, as on a pure cycle, the first by name. names (node) adds nodes without edges."""
    nodes = edges.select("node").union(edges.select("dep"))
    nodes = (nodes if names is None else nodes.union(names.select("node"))).distinct()
    roots = nodes.join(edges.select(F.col("dep").alias("node")).hint("merge"), "node", "left_anti")
    first = nodes.agg(F.min("node").alias("node")).join(roots.limit(1).agg(F.count("*").alias("n")), F.col("n") == 0).select("node")
    return roots.unionByName(first.filter("node is not null"))


def orphaned_by_cancel(requests: DataFrame, edges: DataFrame, cancelled: str = "cancelled") -> DataFrame:
    """Nodes that only cancelled requests want: two walks of the graph, whatever the number of requests. A null is a request that lives."""
    wanted = requests.groupBy("target").agg(F.bool_and(cancelled).alias("gone"))
    walk = lambda which: closure(edges, wanted.filter(which).select(F.lit(0).alias("root"), F.col("target").alias("node"))).select("node")
    return walk("gone").join(walk("not gone or gone is null"), "node", "left_anti")


def request_counts(membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """total, done, running, failed, waiting nodes of each request."""
    p = F.col("phase")
    done, run, bad = p == "done", p.isin(*ACTIVE), p.isin("failed", "failed-upstream")
    return membership.join(nodes.select("node", "phase"), "node").groupBy("request").agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(run).alias("running"), F.count_if(bad).alias("failed"), F.count_if(~(done | run | bad)).alias("waiting"))


def request_phase(requests: DataFrame, counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request, phase, terminal): cancelled, then the request's own failure (fail_reason), target done, any failed node, running."""
    target = nodes.select(F.col("node").alias("target"), F.col("phase").alias("__t"))
    joined = requests.join(counts, "request", "left").join(target, "target", "left")
    own = F.coalesce(F.col("fail_reason"), F.lit("")) != "" if "fail_reason" in requests.columns else F.lit(False)
    phase = F.when(F.col("cancelled"), "cancelled").when(own, "failed").when(F.col("__t") == "done", "done").when(F.coalesce("failed", F.lit(0)) > 0, "failed").otherwise("running")
    return joined.select("request", phase.alias("phase")).withColumn("terminal", F.col("phase") != "running")


def interest_tags(membership: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(node, requests): the sorted ids of the live requests that want each node; requests (request, cancelled) tells which are live.

    The ids of a node are its result; a caller for whom they may be too many counts ``membership`` instead.
    """
    live = membership if requests is None else membership.join(requests.filter(~F.col("cancelled")).select("request"), "request", "left_semi")
    return live.groupBy("node").agg(F.sort_array(F.collect_set("request")).alias("requests"))


def interest_runs(membership: DataFrame, requests: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """(node, run, requests): as ``interest_tags``, with at most ``most`` ids a row: a root's ids are dealt over rows and tasks."""
    live = membership if requests is None else membership.join(requests.filter(~F.col("cancelled")).select("request"), "request", "left_semi")
    return runs_of(live, "node", "request", "requests", most)


def waiting_fs(shares: DataFrame) -> DataFrame:
    """shares (f, kp) -> (kp, fs): the sorted f keys that wait on each shared run."""
    return shares.groupBy("kp").agg(F.sort_array(F.collect_set("f")).alias("fs"))


def waiting_runs(shares: DataFrame, most: int = 1000) -> DataFrame:
    """shares (f, kp) -> (kp, run, fs): as ``waiting_fs``, with at most ``most`` keys a row."""
    return runs_of(shares, "kp", "f", "fs", most)


def root_failures(membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per request its failed nodes; if none, those with a retry counter above 0."""
    rows = membership.join(nodes.select("node", "phase", "consec_retry"), "node").filter((F.col("phase") == "failed") | ((F.col("consec_retry") > 0) & (F.col("phase") != "failed-upstream")))
    any_failed = F.max(F.col("phase") == "failed").over(Window.partitionBy("request"))
    return rows.withColumn("__any", any_failed).filter(~F.col("__any") | (F.col("phase") == "failed")).drop("__any")


def first_failing(membership: DataFrame, nodes: DataFrame, cap: int = 4) -> DataFrame:
    """The first failed nodes of each request by name, and whether there are more."""
    rows = membership.join(nodes.filter("phase = 'failed'").select("node"), "node")
    w = Window.partitionBy("request")
    out = rows.withColumn("nth", F.row_number().over(w.orderBy("node"))).withColumn("truncated", F.count("*").over(w) > cap)
    return out.filter(F.col("nth") <= cap)


def problem_first(nodes: DataFrame) -> DataFrame:
    """nodes with place (their phase's rank), nth (within the phase, by name) and in_phase (the group header's count), problems first.

    Unknown phases come last, by name.
    """
    return ranked(nodes.withColumn("place", phase_rank("phase")), ["place", "phase"], ["node"], "nth", "in_phase").orderBy("place", "phase", "node")


def board_rows(membership: DataFrame, nodes: DataFrame, run_cap: int = 8, fail_cap: int = 4) -> DataFrame:
    """Capped active and failed rows of each request with how many more there are."""
    kind = F.when(F.col("phase").isin(*ACTIVE), "run").when(F.col("phase") == "failed", "fail")
    rows = membership.join(nodes.select("node", "phase"), "node").withColumn("kind", kind).filter("kind is not null")
    w = Window.partitionBy("request", "kind")
    cap = F.when(F.col("kind") == "run", run_cap).otherwise(fail_cap)
    out = rows.withColumn("nth", F.row_number().over(w.orderBy("node"))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(w) - cap))
    return out.filter(F.col("nth") <= cap)


def status_changes(snapshots: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Rows whose values differ from the row before of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    now, prev = F.struct(*values), F.lag(F.struct(*values)).over(w)
    return snapshots.withColumn("__p", prev).filter(F.col("__p").isNull() | ~F.col("__p").eqNullSafe(now)).drop("__p")


def incomplete_roots(children: DataFrame, objects: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, missing, example): roots whose closure over children (parent, child) lacks objects (key).

    Walks up from what is lacking: a complete subtree costs nothing, and pairs are of a lost key and what is above it.
    """
    roots = roots.select(F.col("key").alias("node")).distinct()
    asked = children.select(F.col("child").alias("node")).unionByName(roots).distinct()
    lost = checkpointed(asked.join(objects.select(F.col("key").alias("node")), "node", "left_anti"))
    up = children.select(F.col("child").alias("node"), F.col("parent").alias("dep"))
    above = closure(up, lost.select(F.col("node").alias("root"), "node")).join(roots, "node", "left_semi")
    return above.groupBy(F.col("node").alias("root")).agg(F.count("*").alias("missing"), F.min("root").alias("example"))


def complete_keys(children: DataFrame, store: DataFrame) -> DataFrame:
    """The keys of store whose whole closure over children (parent, child) is in store: presence alone proves nothing about children."""
    inner = children.join(store.select(F.col("key").alias("parent")).hint("merge"), "parent", "left_semi")
    lacking = inner.join(store.select(F.col("key").alias("child")).hint("merge"), "child", "left_anti").select(F.col("parent").alias("node")).distinct()
    up = inner.select(F.col("child").alias("node"), F.col("parent").alias("dep"))
    broken = closure(up, lacking.select(F.lit(0).alias("root"), "node")).select(F.col("node").alias("key"))
    return store.select("key").distinct().join(broken.hint("merge"), "key", "left_anti")


def plan_transfer(children: DataFrame, src: DataFrame, dst: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(round, key, present): what is asked for in each round: keys of src that dst lacks, or has but not completely, from the roots down.

    Complete subtrees of dst are cut off; the next round's keys are the children of this round's. present: dst has the key already.
    """
    whole = checkpointed(complete_keys(children, dst))
    front = roots.select("key").distinct()
    seen: DataFrame | None = None
    for i in count(1):
        front = front.join(whole.hint("merge"), "key", "left_anti").join(src.select("key").hint("merge"), "key", "left_semi")
        front = checkpointed(front if seen is None else front.join(seen.select("key").hint("merge"), "key", "left_anti"))
        if front.isEmpty():
            break
        if i - 1 == most:
            raise RuntimeError(f"the transfer isn't done after {most} rounds")
        now = front.withColumn("round", F.lit(i))
        seen = now if seen is None else checkpointed(seen.unionByName(now))
        front = front.join(children.select(F.col("parent").alias("key"), "child").hint("merge"), "key").select(F.col("child").alias("key")).distinct()
    if seen is None:
        seen = front.withColumn("round", F.lit(0))
    have = dst.select("key").distinct().withColumn("present", F.lit(True))
    return seen.join(have.hint("merge"), "key", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def transfer_totals(plan: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: rounds, objects and bytes that a plan moves; objects (key, size)."""
    new = plan.join(objects.hint("merge"), "key", "left")
    moved = ~F.col("present")
    return new.agg(F.max("round").alias("rounds"), F.count_if(moved).alias("objects"), F.coalesce(F.sum(F.when(moved, F.col("size"))), F.lit(0)).alias("bytes"))
