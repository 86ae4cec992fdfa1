"""Stateful streams in several micro-batches against plain versions, and ignore patterns with known results."""

import datetime as dt

from pyspark.sql import functions as F

from buildtrail.operators import logs, trees
from buildtrail.streaming import operators as st
from buildtrail.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


def parts(spark, folder, batches, schema):
    """A stream that takes one file a micro-batch, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_status_changes_are_written_once(spark, tmp_path):
    batches = [[("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, None)], [("a", 3, "y"), ("a", 2, "x"), ("a", 4, "y"), ("a", 5, "x")], [("b", 7, "x"), (None, 9, "x")]]
    stream = parts(spark, tmp_path / "in", batches, "node string, seq int, status string")
    st.run_available(stateful.stream_status(stream, "node", "seq", "status"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 1, "x"), ("a", 3, "y"), ("a", 5, "x"), ("b", 7, "x")]


def test_log_view_over_micro_batches_equals_the_batch_view(spark, tmp_path):
    chunk = lambda node, gen, seq: (node, gen, "o", seq, f"{node}{gen}-{seq};".encode() * (seq % 4))
    batches = [[chunk("n", 1, i) for i in range(5)] + [chunk("m", 2, i) for i in range(3)], [chunk("n", 2, i) for i in range(6)] + [chunk("m", 2, 1), chunk("m", 1, 9)], [chunk("n", 2, i) for i in range(4, 12)] + [chunk("m", 2, 4)]]
    schema = "node string, gen int, stream string, seq int, data binary"
    seen = {}
    views = stateful.stream_log_view(parts(spark, tmp_path / "in", batches, schema), 12, 20)
    st.run_available(views, "", str(tmp_path / "ck"), "update", lambda df, n: seen.update({r[0]: (r[1], bytes(r[2]), r[3], bytes(r[4])) for r in df.collect()}))
    want = logs.log_view(spark.createDataFrame(sum(batches, []), schema), 12, 20)
    assert seen == {r[0]: (r[1], bytes(r[2]), r[3], bytes(r[4])) for r in want.collect()}


def test_runnerless_requests_in_micro_batches(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("p", None, "seen", 0), ("p", "r1", "asked", 5), ("p", "r2", "asked", 20), ("p", "r2", "ended", 100), ("p", None, "seen", 310), ("p", "r3", "asked", 320), ("p", "r1", "ended", 330), ("p", "r4", "asked", 700), ("q", "r5", "asked", 50), ("q", None, "seen", 350), ("q", "r6", "asked", 351), ("p", None, "seen", 2000)]
    rows = [(*r[:3], at(r[3])) for r in rows]
    batches = [[r] for r in rows[:4]] + [rows[4:8], rows[8:9] + rows[9:11], rows[11:], [("z", None, "seen", at(90000))]]
    schema = "platform string, request string, kind string, ts timestamp"
    stream = parts(spark, tmp_path / "in", batches, schema)
    st.run_available(stateful.stream_runnerless(stream, 15, 300, "30 minutes"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r[0], r[1], r[2]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("p", "r3", at(625)), ("p", "r4", at(1000)), ("q", "r5", at(665)), ("q", "r6", at(665))]  # r5 waits from 50 s, the sign at 350 s comes just in time
    table = spark.createDataFrame(rows, schema).withColumn("us", F.unix_micros("ts"))
    ended = table.filter("kind = 'ended'").select("request", F.col("us").alias("ended_us"))
    batch = trees.runnerless_requests(table.filter("kind = 'seen'"), table.filter("kind = 'asked'").join(ended, "request", "left"), 15, 300)
    us = lambda t: int((t - T0).total_seconds() * 1e6) + int(T0.replace(tzinfo=dt.UTC).timestamp() * 1e6)
    assert sorted(map(tuple, batch.select("platform", "request", "failed_us").collect())) == [(p, r, us(t)) for p, r, t in got]


def test_followed_logs_come_after_the_stored_ones(spark):
    schema = "node string, gen int, stream string, seq int"
    stored = spark.createDataFrame([("n", 1, "o", 3), ("n", 2, "o", 1)], schema)
    new = spark.createDataFrame([("n", 1, "o", 9), ("n", 2, "o", 1), ("n", 2, "o", 2), ("n", 2, "e", 0), ("n", 3, "o", 0), ("m", 1, "o", 0)], schema)
    assert sorted(map(tuple, stateful.follow_logs(stored, new).collect())) == [("m", 1, "o", 0), ("n", 2, "e", 0), ("n", 2, "o", 2), ("n", 3, "o", 0)]


def test_ignore_patterns(spark):
    control = [("", "# note\n*.o\n!keep.o\n/top\nbuild/\ndoc/**/x.txt\na/*.c\n**/deep\nlogs/**\nf[!0-9].txt\n\\!odd\nq?.md\n\n"), ("src", "!*.o\ngen.h\n/only"), ("build", "!in.txt")]
    out = {"z.o", "sub/z.o", "top", "build/in.txt", "sub/build/y", "doc/x.txt", "doc/p/q/x.txt", "a/m.c", "e/deep/file", "deep", "logs/l/m", "fa.txt", "!odd", "q1.md", "src/gen.h", "src/in/gen.h", "src/only", ".git/config", "sub/.git", ".ignore", "src/.ignore"}
    kept = {"keep.o", "sub/keep.o", "sub/top", "build", "doc/y.txt", "a/b/m.c", "b/a/m.c", "f1.txt", "src/z.o", "src/a/z.o", "gen.h", "src/in/only", "q12.md", ".gitx", "logs"}
    entries = spark.createDataFrame([(p, False, len(p)) for p in sorted(out | kept)], "path string, is_dir boolean, size int")
    rules = spark.createDataFrame(control, "dir string, content string")
    assert {r["path"] for r in trees.filter_source_tree(entries, rules).collect()} == kept
    assert trees.filter_source_tree(entries, rules.limit(0)).count() == len(out | kept) - 4
