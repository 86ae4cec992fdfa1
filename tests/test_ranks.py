"""Ranks and runs of hot groups, walks from what is lost, repeats within a window: against plain versions."""

import datetime as dt
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from buildtrail.operators import graph, ranks, refs, telemetry
from buildtrail.streaming import operators as st

from test_stateful import T0, parts


def test_ranks_of_a_hot_group(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, *range(400)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, total2 int")
    got = ranks.ranked(df, ["g"], ["v", "total2"]).collect()
    want = {}
    for g in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want |= {x: (i + 1, len(mine)) for i, x in enumerate(mine)}
    assert {(x.g, x.v, x.total2): (x.nth, x.total) for x in got} == want
    assert ranks.ranked(df.limit(0), ["g"], ["v"]).count() == 0


def test_a_hot_group_takes_many_tasks(spark):
    df = spark.range(20000).select(F.lit("hot").alias("g"), F.col("id").alias("v"))
    ranges = max(8, 4)
    counts = [x["count"] for x in df.repartitionByRange(ranges, "g", "v").groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) == ranges and max(counts) < 20000 / ranges * 2
    out = ranks.ranked(df, ["g"], ["v"])
    assert out.filter("nth <> v + 1 or total <> 20000").count() == 0


def test_runs_hold_each_value_once_in_order(spark):
    rows = [("n", i % 25) for i in range(60)] + [("m", 4), ("m", None), (None, 7)]
    got = graph.waiting_runs(spark.createDataFrame(rows, "kp string, f int"), 10).collect()
    assert {(x.kp, x.run): list(x.fs) for x in got} == {("n", 0): list(range(10)), ("n", 1): list(range(10, 20)), ("n", 2): list(range(20, 25)), ("m", 0): [4], (None, 0): [7]}


def test_walks_on_graphs_with_shared_nodes_and_cycles(spark):
    r = random.Random(5)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(70)}
    have, roots = set(r.sample(range(40), 30)), r.sample(range(45), 20)

    def reach(start):
        seen, todo = {start}, [start]
        while todo:
            n = todo.pop()
            new = {b for a, b in edges if a == n} - seen
            seen |= new
            todo += new
        return seen

    want = {x: sorted(reach(x) - have) for x in roots}
    found = graph.incomplete_roots(spark.createDataFrame(sorted(edges), "parent int, child int"), spark.createDataFrame([(x,) for x in have], "key int"), spark.createDataFrame([(x,) for x in roots], "key int"))
    assert {x.root: (x.missing, x.example) for x in found.collect()} == {x: (len(v), v[0]) for x, v in want.items() if v}
    requests = [(i, r.randrange(40), r.choice([True, True, True, False])) for i in range(25)] + [(99, 3, None)]
    live, gone = set(), set()
    for _, t, c in requests:
        (gone if c else live).update(reach(t))
    orphans = graph.orphaned_by_cancel(spark.createDataFrame(requests, "request int, target int, cancelled boolean"), spark.createDataFrame(sorted(edges), "node int, dep int"))
    assert sorted(x.node for x in orphans.collect()) == sorted(gone - live)


@settings(max_examples=300, deadline=None)
@given(st_.lists(st_.tuples(st_.integers(0, 2), st_.integers(0, 60)), max_size=40), st_.integers(0, 15), st_.integers(1, 12))
def test_repeats_in_a_window_across_batches(rows, width, size):
    rows = sorted(rows)
    want, key, last = [], None, 0
    for k, at in rows:
        stays = k != key or at - last > width
        key, last = k, at if stays else last
        want.append(stays)
    got, held = [], None
    for i in range(0, len(rows), size):
        stay, held = telemetry.kept_in_window(np.array([k for k, _ in rows[i : i + size]]), np.array([a for _, a in rows[i : i + size]]), width, held)
        got += stay.tolist()
    assert got == want


def test_repeats_without_an_arrival(spark):
    rows = [("n", 1, None, 1), ("n", 1, None, 2), ("n", 1, T0, 3), ("n", 1, T0 + dt.timedelta(seconds=5), 4), ("n", 1, T0 + dt.timedelta(seconds=20), 5)]
    df = spark.createDataFrame(rows, "node string, gen int, arrival timestamp, part int")
    assert sorted(x.part for x in telemetry.dedup_in_window(df, 10, ["part"]).collect()) == [1, 3, 5]


def test_a_bad_build_from_value_rejects_its_batch(spark):
    k, f = "a" * 64, "b" * 64
    rows = [(1, "buildfrom", k, "amd", f"build-from:{k}", f), (1, "buildfrom", k, "amd", f"build-from-tree:{f}", f), (2, "buildfrom", k, "amd", f"build-from:{k}", "xyz"), (3, "buildfrom", k, "amd", f"build-from:{k}", None), (4, "pin", k, "amd", f"build-pinned:{k}", "xyz")]
    out = refs.gate_refs(spark.createDataFrame(rows, "batch int, kind string, node_key string, platform string, name string, key string"), spark.createDataFrame([], "build string, id string"))
    assert sorted((x.batch, x.reason, x.accepted) for x in out.filter("name not like 'build-from-tree%'").collect()) == [(1, None, True), (2, "bad key value", False), (3, "bad key value", False), (4, None, True)]


def test_usage_as_a_stream(spark, tmp_path):
    r = random.Random(7)
    rows = sorted([(r.choice("ab"), T0 + dt.timedelta(seconds=r.randrange(4000)), float(r.randrange(100))) for _ in range(60)], key=lambda x: x[1])
    batches = [rows[i : i + 12] for i in range(0, len(rows), 12)] + [[("z", T0 + dt.timedelta(days=1), 0.0)]]
    schema = "node string, ts timestamp, cpu double"
    stream = st.stream_usage(parts(spark, tmp_path / "in", batches, schema), "node", "ts", "cpu", "20 minutes", "10 minutes")
    st.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("node <> 'z'")
    want = st.stream_usage(spark.createDataFrame(rows, schema), "node", "ts", "cpu", "20 minutes", "10 minutes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_unanswered_jobs_as_a_stream(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    jobs = [[("a", 1, at(0)), ("b", 1, at(10))], [("a", 2, at(100)), ("c", 1, at(150))], [("z", 1, at(90000))], [("z", 2, at(180000))]]
    results = [[("b", 1, at(100)), ("a", 1, at(91))], [("a", 2, at(190)), ("c", 2, at(160))], [("z", 1, at(90001))], [("z", 2, at(180001))]]
    schemas = "node string, gen int, enqueued timestamp", "node string, gen int, reported timestamp"
    stream = st.unanswered_jobs(parts(spark, tmp_path / "j", jobs, schemas[0]), parts(spark, tmp_path / "r", results, schemas[1]))
    st.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).filter("node <> 'z'").collect()))
    want = st.unanswered_jobs(spark.createDataFrame(sum(jobs, []), schemas[0]), spark.createDataFrame(sum(results, []), schemas[1]))
    assert got == sorted(map(tuple, want.filter("node <> 'z'").collect())) == [("a", 1, at(0)), ("c", 1, at(150))]
