"""Queries whose results or plans change with the tables' size: large keys against the SQL, and joins that may not pass through the driver."""

import os

import pytest

from buildtrail import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def shifted(tmp_path, table, **by):
    """A folder with one table of the smallest size whose keys are shifted."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{SF}/{table}.parquet")
    for name, n in by.items():
        rows = rows.set_column(rows.column_names.index(name), name, pc.add(rows[name], n))
    pq.write_table(rows, tmp_path / f"{table}.parquet")
    return str(tmp_path)


def both(spark, name, folder):
    """The query's rows and its SQL's."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    df = catalog.queries()[name](spark, folder)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr), sorted(want, key=repr)


def no_broadcast(df):
    """That no join of df's plan is a broadcast, though its tables are small enough for one."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan, plan
    return df


def test_texts_of_large_keys(spark, tmp_path):
    got, want = both(spark, "scalar_texts", shifted(tmp_path, "orders", o_orderkey=8_999_000))
    assert got == want


def test_bytes_of_large_keys(spark, tmp_path):
    got, want = both(spark, "human_bytes", shifted(tmp_path, "part", p_partkey=1_199_000))
    assert got == want


def test_labels_are_not_broadcast(spark):
    no_broadcast(catalog.queries()["apply_labels"](spark, SF))


def test_builds_are_not_broadcast(spark):
    no_broadcast(catalog.queries()["fold_builds"](spark, SF))


def test_pulled_refs_are_not_broadcast(spark):
    no_broadcast(catalog.queries()["pull_refs"](spark, SF))


def test_images_are_not_broadcast(spark):
    no_broadcast(catalog.queries()["resolve_images"](spark, SF))


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that the iterative operators write, to the end of the test."""
    from buildtrail.operators import builds, graph

    seen = []
    for module in (builds, graph):
        monkeypatch.setattr(module, "checkpointed", lambda df, f=module.checkpointed: (seen.append(df._jdf.queryExecution().executedPlan().toString()), f(df))[1])
    return seen


def test_transfers_are_not_broadcast(spark, plans):
    catalog.queries()["plan_transfer_whole"](spark, SF)
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_totals_are_not_broadcast(spark):
    no_broadcast(catalog.queries()["transfer_totals"](spark, SF))


def test_tree_rows_are_not_broadcast(spark, plans):
    catalog.queries()["flatten_labelled_tree"](spark, SF)
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_paths_are_not_broadcast(spark, plans):
    catalog.queries()["flatten_tree"](spark, SF)
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
