"""Streams with timers in several micro-batches against their batch forms and plain versions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from buildtrail.operators import logs
from buildtrail.streaming import operators as st
from buildtrail.streaming import timers

from test_stateful import T0, parts


def at(s):
    return T0 + dt.timedelta(seconds=s)


def run(stream, folder):
    st.run_available(stream, str(folder / "out"), str(folder / "ck"))
    return stream.sparkSession.read.parquet(str(folder / "out"))


def test_transitions(spark, tmp_path):
    r = random.Random(1)
    beats = sorted((r.choice("abc"), r.random() * 600) for _ in range(60)) + [("d", 5.0), ("d", 20.0), ("d", 35.5), ("d", 35.5)]
    rows = [(k, at(round(s, 3))) for k, s in sorted(beats, key=lambda b: b[1] + r.random() * 8)]  # somewhat out of order
    batches = [rows[i : i + 9] for i in range(0, len(rows), 9)] + [[(None, at(600))], [("z", at(9000))]]
    schema = "runner string, ts timestamp"
    got = run(timers.stream_transitions(parts(spark, tmp_path / "in", batches, schema), "runner", "ts", 15, "10 seconds"), tmp_path)
    want = timers.fleet_transitions(spark.createDataFrame(rows, schema), "runner", "ts", 15)
    found = sorted(map(tuple, got.filter("runner <> 'z'").collect()))
    assert found == sorted(map(tuple, want.collect()))
    assert [(x[1], x[2]) for x in found if x[0] == "d"] == [(at(5), "live"), (at(35), "lost"), (at(35.5), "live"), (at(50.5), "lost")]


def test_snapshots_are_throttled_and_final_ones_delivered(spark, tmp_path):
    r = random.Random(2)
    rows = []
    for k in "abcd":
        n = r.randint(5, 30)
        rows += [(k, at(r.randint(0, 8000) / 1000), i, f"running {i}") for i in range(n)]
    rows += [("a", at(3.1), 900, "done"), ("b", at(2.0), 901, "failed"), ("b", at(2.01), 902, "running again"), ("e", at(0.3), 1, "running"), ("e", at(0.31), 2, "done")]
    rows.sort(key=lambda x: (x[1] - T0).total_seconds() + r.random() * 0.5)
    batches = [rows[i : i + 8] for i in range(0, len(rows), 8)]
    schema = "request string, ts timestamp, seq int, phase string"
    stream = timers.stream_latest(parts(spark, tmp_path / "in", [*batches, [("z", at(9000), 1, "x")]], schema), "request", "ts", "seq", "phase", 250, "2 seconds")
    got = run(stream, tmp_path).filter("request <> 'z'")
    want = timers.latest_snapshots(spark.createDataFrame(rows, schema), "request", "ts", "seq", "phase", 250)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_final_snapshot_does_not_wait_for_the_watermark(spark, tmp_path):
    schema = "request string, ts timestamp, seq int, phase string"
    stream = timers.stream_latest(parts(spark, tmp_path / "in", [[("a", at(0), 1, "running")], [("a", at(0.1), 2, "done"), ("b", at(0.1), 2, "running")]], schema), "request", "ts", "seq", "phase")
    assert [tuple(x) for x in run(stream, tmp_path).collect()] == [("a", at(0.25), "done")]


def test_results_are_dealt_by_outcome(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 2), ("b", 1)], "node string, gen int")
    batches = [[("a", 2, at(1000), "1"), ("a", 1, at(1001), "2"), ("c", 1, at(1002), "3"), (None, 1, at(5), "4")], [("b", 1, at(2000), "5"), ("b", 1, at(300), "6"), ("b", None, at(2000), "7")], [("a", 2, at(1300), "8"), ("a", 2, at(1500), "9"), ("a", 2, None, "10")]]
    stream = parts(spark, tmp_path / "in", batches, "node string, gen int, reported timestamp, id string")
    timers.late_results(stream, nodes, str(tmp_path / "out"), str(tmp_path / "ck"), 600)
    got = {r["id"]: (r["batch"], r["outcome"]) for r in spark.read.parquet(str(tmp_path / "out" / "results")).collect()}
    assert got == {"1": (0, "applied"), "2": (0, "stale"), "3": (0, "unknown"), "4": (0, "unknown"), "5": (1, "applied"), "6": (1, "late"), "7": (1, "unknown"), "8": (2, "late"), "9": (2, "applied"), "10": (2, "applied")}
    counts = spark.read.parquet(str(tmp_path / "out" / "counts")).orderBy("batch").select("applied", "late", "unknown", "stale").collect()
    assert [tuple(c) for c in counts] == [(1, 0, 2, 1), (1, 1, 1, 0), (2, 1, 0, 0)]


def test_rechunk_keeps_every_byte(spark, tmp_path):
    r = random.Random(3)
    rows, seconds = [], 0.0
    for i in range(80):
        seconds += r.choice([0.001, 0.02, 0.5])
        rows.append(("n", 1, "o", i, at(seconds), bytes([i]) * r.choice([0, 1, 7, 40, 300])))
    batches = [rows[i : i + 13] + rows[max(0, i - 4) : i] for i in range(0, 80, 13)] + [[("z", 1, None, 0, at(9000), b"")]]
    stream = timers.stream_rechunk(parts(spark, tmp_path / "in", batches, "node string, gen int, stream string, seq int, ts timestamp, data binary"), 100, 250, 100, "1 second")
    got = run(stream, tmp_path).filter("node = 'n'").orderBy("offset").collect()
    assert b"".join(bytes(x["data"]) for x in got) == b"".join(x[5] for x in rows)
    assert [x["offset"] for x in got] == [sum(len(y["data"]) for y in got[:i]) for i in range(len(got))]
    assert all(0 < len(x["data"]) <= 100 for x in got) and sum(len(x["data"]) == 100 for x in got) > 30


def test_streams_run_without_the_package_on_the_workers_path(spark, tmp_path):
    """Registered streams must not depend on the folder that the driver was started in."""
    import subprocess
    import sys

    from conftest import ROOT

    code = f"import sys, importlib; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()\nprint('ROWS', e.queries()['stream_status'](s, '/root/testdata/sf0.001').count())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=180, env={k: v for k, v in __import__("os").environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")})
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_batch_forms_take_empty_tables(spark):
    beats = spark.createDataFrame([], "runner string, ts timestamp")
    assert timers.fleet_transitions(beats, "runner", "ts").count() == 0
    rows = spark.createDataFrame([], "request string, ts timestamp, seq int, phase string")
    assert timers.latest_snapshots(rows, "request", "ts", "seq", "phase").count() == 0
    results = spark.createDataFrame([], "node string, gen int, reported timestamp")
    assert timers.result_outcomes(results, results.select("node", "gen")).filter(F.col("outcome") == "applied").count() == 0


def test_lines_across_chunk_borders(spark):
    schema = "node string, gen int, stream string, seq int, data binary"
    text = "eins\r\nzwei é\n\ndrei lang und länger\r\n\nlast".encode()
    cuts = [0, 3, 4, 5, 6, 12, 13, 14, 30, 31, 32, len(text)]  # within a line end, within a character, at a newline
    rows = [("n", 1, "o", i, text[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))] + [("n", 1, "e", 0, b"x\n"), ("n", 1, "e", 1, None), ("m", 1, "o", 0, b""), ("m", 2, "o", 0, b"\n\n"), ("m", 3, "o", 0, b"a\xff\n")]
    got = {}
    for r in logs.log_lines(spark.createDataFrame(rows, schema).repartition(3), "> ").orderBy("no").collect():
        got.setdefault((r["node"], r["gen"], r["stream"]), []).append((r["no"], r["line"]))
    want = [x.rstrip("\r") for x in text.decode().split("\n")]
    assert got.pop(("m", 3, "o"))[0][1].startswith("> a")
    assert got == {("n", 1, "o"): [(i, f"> {x}") for i, x in enumerate(want)], ("n", 1, "e"): [(0, "> x")], ("m", 2, "o"): [(0, "> "), (1, "> ")]}


def test_rechunked_bytes_are_the_input_s(spark):
    r = random.Random(4)
    data = {s: [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 3, 50, 500]))) for _ in range(40)] for s in "ab"}
    rows = [("n", 1, s, i, b) for s, bs in data.items() for i, b in enumerate(bs)] + [("n", 2, "a", 0, b""), ("n", 2, "a", 1, None)]
    got = {}
    for x in logs.rechunk_bytes(spark.createDataFrame(rows, "node string, gen int, stream string, seq int, data binary").repartition(3), 64).orderBy("offset").collect():
        got.setdefault((x["gen"], x["stream"]), []).append((x["offset"], bytes(x["data"])))
    assert got.keys() == {(1, "a"), (1, "b")}
    for s, bs in data.items():
        whole = b"".join(bs)
        assert got[1, s] == [(i, whole[i : i + 64]) for i in range(0, len(whole), 64)]
