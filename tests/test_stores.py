"""Stores on disk, and readers of trees and batches."""

import json

import pytest

from buildtrail.operators import store
from buildtrail.sources import stores, tables


@pytest.fixture
def table(spark, tmp_path):
    name = f"t_{tmp_path.name}".replace("-", "_")
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def objects(spark, keys):
    return spark.createDataFrame([(k, len(k)) for k in keys], "key string, size int")


def test_store_isn_t_shuffled(spark, table, tmp_path):
    stores.create_store(objects(spark, [f"k{i}" for i in range(100)]), table, 4, str(tmp_path / "s"))
    stores.append_to_store(spark, table, objects(spark, ["k1", "k1", "new", "new", "k500"]))
    stores.append_to_store(spark, table, objects(spark, ["new", "k500"]))
    rows = spark.table(table).collect()
    assert len(rows) == 102 and {r["key"] for r in rows} == {f"k{i}" for i in range(100)} | {"new", "k500"}
    missing = stores.missing_in_store(spark, table, objects(spark, ["k1", "k2", "x", "x", "y"]))
    plan = missing._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange" in line]
    assert "Bucketed: true" in plan and len(shuffles) == 1 and ":" in shuffles[0].partition("Exchange")[0]  # in the left branch, of what is wanted
    assert sorted(r["key"] for r in missing.collect()) == ["x", "y"]
    new = store.append_objects(spark.table(table).select("key").hint("merge"), objects(spark, ["z"]))
    assert "Bucketed: true" in new._jdf.queryExecution().executedPlan().toString()


def test_snapshots_are_written_once(spark, tmp_path):
    path = str(tmp_path / "refs")
    one = spark.createDataFrame([("a", "1")], "name string, key string")
    assert stores.latest_version(spark, path) == 0
    assert stores.write_snapshot(one, path) == 1
    assert stores.write_snapshot(one.limit(0), path, expected=1) == 2
    with pytest.raises(RuntimeError):
        stores.write_snapshot(one, path, expected=1)
    assert stores.read_snapshot(spark, path).count() == 0 and stores.read_snapshot(spark, path, 1).count() == 1


def test_read_tree_with_signs_in_names(spark, tmp_path):
    for name in ("tree+a(b", "plain.d"):
        folder = tmp_path / name
        (folder / "in").mkdir(parents=True)
        (folder / "in" / "f.txt").write_text("x")
        (folder / "g").write_text("yy")
        assert {(r["path"], r["size"]) for r in tables.read_tree(spark, str(folder)).collect()} == {("in/f.txt", 1), ("g", 2)}
        assert {r["path"] for r in tables.read_tree(spark, f"file://{folder}/").collect()} == {"in/f.txt", "g"}


def test_batches_tell_what_does_not_decode(spark, tmp_path):
    event = {"emitter": "e", "boot": "b", "seq": 1, "ts_ns": 5, "type": "t", "data": {"a": [1, {"b": 2}]}}
    lines = [json.dumps([event, {**event, "seq": "two"}, {**event, "seq": 3}]), "not json", json.dumps([event])[:-9], "", "[]", json.dumps({**event, "seq": 4}), "[null]"]
    (tmp_path / "b.jsonl").write_text("\n".join(lines))
    good, bad = tables.read_event_batches(spark, str(tmp_path / "b.jsonl"))
    assert sorted(r["seq"] for r in good.collect()) == [1, 3] and json.loads(good.first()["data"]) == event["data"]
    lost = [r["value"] for r in bad.collect()]
    assert len(lost) == 5 and any('"two"' in (x or "") for x in lost) and "not json" in lost and None in lost
    assert tables.read_events(spark, str(tmp_path / "b.jsonl"), "batches").count() == 2
