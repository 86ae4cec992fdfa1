"""Streams that deliver by timers: live and lost runners, throttled snapshots, bounded chunks; and results dealt to sinks by outcome.

Timers follow event time: what is due is delivered once the watermark has passed it, whatever micro-batches rows come in.
State is kept in typed arrays and outlives lost executors in the query's checkpoint; a key's rows of one micro-batch meet in one
task, so cap micro-batches (``maxFilesPerTrigger``). Rows with a null key or time take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from buildtrail.ship import ship

# Phases after which a request has no more snapshots, and the sizes of output chunks.
FINAL = ("done", "failed", "cancelled")
CHUNK_BYTES, FLUSH_BYTES, DELAY_MS = 32 << 10, 64 << 10, 100


def _timed(us: list[int]) -> pd.Series:
    return pd.to_datetime(pd.Series(us, dtype="int64"), unit="us", utc=True)


def stream_transitions(beats: DataFrame, key: str, time: str, live_s: float = 15, late: str = "1 minute") -> DataFrame:
    """(key, at, state) of each change of a runner: "live" with its first beat, "lost" live_s after its last one, "live" again on its return.

    Beats wait for the watermark, so those that come out of order within ``late`` change nothing. The state of a key is its last beat and
    the beats that wait.
    """
    ship(beats.sparkSession)
    live = int(live_s * 1_000_000)
    kind = beats.schema[key].dataType.simpleString()

    def watch(at: tuple[Any], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, [])
        held = list(held)
        if not state.hasTimedOut:
            for part in parts:
                held += part["us"].tolist()
        held = sorted(set(held))
        mark = state.getCurrentWatermarkMs() * 1000
        found: list[tuple[int, str]] = []
        while held and held[0] <= mark:
            us = held.pop(0)
            if last is None or us > last + live:
                if last is not None:
                    found.append((last + live, "lost"))
                found.append((us, "live"))
            last = us if last is None else max(last, us)
        if last is not None and last + live < mark:
            found.append((last + live, "lost"))
            last = None
        if held or last is not None:
            state.update((last, held))
            due = min([*held[:1], *([last + live + 1] if last is not None else [])])
            state.setTimeoutTimestamp(max(mark // 1000 + 1, -(-due // 1000)))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame({key: [at[0]] * len(found), "at": _timed([us for us, _ in found]), "state": [s for _, s in found]})

    rows = beats.select(key, F.col(time).alias("ts")).dropna().withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy(key).applyInPandasWithState(watch, f"{key} {kind}, at timestamp, state string", "last long, held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def fleet_transitions(beats: DataFrame, key: str, time: str, live_s: float = 15) -> DataFrame:
    """Batch form of ``stream_transitions``: every runner is lost at last."""
    live = int(live_s * 1_000_000)
    us = beats.select(key, F.unix_micros(F.col(time)).alias("us")).dropna().distinct()
    near = Window.partitionBy(key).orderBy("us")
    ends = us.select(key, "us", (F.coalesce(F.col("us") - F.lag("us").over(near), F.lit(live + 1)) > live).alias("first"), (F.coalesce(F.lead("us").over(near) - F.col("us"), F.lit(live + 1)) > live).alias("last"))
    begun, gone = F.when(F.col("first"), F.struct(F.col("us").alias("at"), F.lit("live").alias("state"))), F.when(F.col("last"), F.struct((F.col("us") + live).alias("at"), F.lit("lost").alias("state")))
    rows = ends.select(key, F.explode(F.array(begun, gone)).alias("c")).filter("c is not null")
    return rows.select(key, F.timestamp_micros("c.at").alias("at"), "c.state")


def stream_latest(rows: DataFrame, key: str, time: str, order: str, value: str, width_ms: int = 250, late: str = "1 minute", final: tuple[str, ...] = FINAL) -> DataFrame:
    """(key, until, value): at most one snapshot a key and window of width_ms, the last one; a final value is delivered at once and ends its key.

    rows: (key, time, order, value), order a whole number that decides between equal times. A window is delivered when the watermark
    passes its end. Rows after a key's final one are ignored, as are its other rows of that window. The state of a key is a row for each
    window that is still open, and its end.
    """
    ship(rows.sparkSession)
    width = width_ms * 1000
    kind = rows.schema[key].dataType.simpleString()

    def latest(at: tuple[Any], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, end_nth, starts, us, nth, values = state.get if state.exists else (None, None, [], [], [], [])
        open_ = {w: (a, b, v) for w, a, b, v in zip(starts, us, nth, values, strict=True)}
        stop = None if end is None else (end, end_nth)
        found: list[tuple[int, str]] = []
        mark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            new = [(a, b, v) for part in parts for a, b, v in zip(part["us"].tolist(), part["nth"].tolist(), part["value"].tolist(), strict=True)]
            for a, b, v in sorted(new):
                w = a // width
                if stop is not None and (a, b) >= stop or (w + 1) * width <= mark:
                    continue
                if v in final:
                    stop = (a, b)
                    found.append(((w + 1) * width, v))
                    open_ = {k: x for k, x in open_.items() if k < w}
                elif (stop is None or w < stop[0] // width) and (w not in open_ or open_[w][:2] <= (a, b)):
                    open_[w] = (a, b, v)
        for w in sorted(k for k in open_ if (k + 1) * width <= mark):
            found.append(((w + 1) * width, open_.pop(w)[2]))
        held = sorted(open_.items())
        state.update((*(stop or (None, None)), [w for w, _ in held], [x[0] for _, x in held], [x[1] for _, x in held], [x[2] for _, x in held]))
        if held:
            state.setTimeoutTimestamp(max(mark // 1000 + 1, -(-(held[0][0] + 1) * width // 1000)))
        if found:
            yield pd.DataFrame({key: [at[0]] * len(found), "until": _timed([u for u, _ in found]), "value": [v for _, v in found]})

    own = rows.select(key, F.col(time).alias("ts"), F.col(order).cast("long").alias("nth"), F.col(value).cast("string").alias("value")).dropna()
    own = own.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("us"), "nth", "value")
    state = "ended long, ended_nth long, starts array<bigint>, us array<bigint>, nth array<bigint>, held array<string>"
    return own.groupBy(key).applyInPandasWithState(latest, f"{key} {kind}, until timestamp, value string", state, "append", GroupStateTimeout.EventTimeTimeout)


def latest_snapshots(rows: DataFrame, key: str, time: str, order: str, value: str, width_ms: int = 250, final: tuple[str, ...] = FINAL) -> DataFrame:
    """Batch form of ``stream_latest``."""
    width = width_ms * 1000
    own = rows.select(key, F.unix_micros(F.col(time)).alias("us"), F.col(order).cast("long").alias("nth"), F.col(value).cast("string").alias("value")).dropna()
    place = F.struct("us", "nth")
    ends = own.filter(F.col("value").isin(*final)).groupBy(key).agg(F.min(place).alias("end"))
    kept = own.join(ends, key, "left").filter(F.col("end").isNull() | (place <= F.col("end")))
    last = kept.groupBy(key, F.floor(F.col("us") / width).alias("w")).agg(F.max_by("value", place).alias("value"))
    return last.select(key, F.timestamp_micros(((F.col("w") + 1) * width).cast("long")).alias("until"), "value")


def result_outcomes(results: DataFrame, nodes: DataFrame, mark_us: int | None = None) -> DataFrame:
    """results (node, gen, reported, ...) with an outcome: "applied", "late" (reported before mark_us), "unknown" (no such node) or "stale" (another gen than the node's current one).

    nodes: (node, gen), a table with one row a node. A null node or gen is unknown.
    """
    now = nodes.select(F.col("node").alias("_node"), F.col("gen").alias("_gen"))
    joined = results.join(now, F.col("node") == F.col("_node"), "left")
    late = F.lit(False) if mark_us is None else F.coalesce(F.unix_micros("reported") < mark_us, F.lit(False))
    outcome = F.when(late, "late").when(F.col("_gen").isNull() | F.col("gen").isNull(), "unknown").when(F.col("gen") != F.col("_gen"), "stale").otherwise("applied")
    return joined.select(*results.columns, outcome.alias("outcome"))


def late_results(results: DataFrame, nodes: DataFrame, path: str, checkpoint: str, late_s: int = 600) -> None:
    """Deal a stream of results (node, gen, reported, ...) to sinks by outcome until there are no more: path/results/batch=N/outcome=..., each row once.

    Nothing is dropped: what isn't "applied" is set aside in its own folder. A result is "late" if it was reported late_s before the
    newest one of all earlier micro-batches. path/counts/batch=N has the counts and the newest time, observed while the rows are
    written; a micro-batch that is repeated after a failure overwrites its own folders and reads only those before it.
    """
    spark = results.sparkSession
    counts = "batch long, newest_us long, applied long, late long, unknown long, stale long"

    def each(df: DataFrame, n: int) -> None:
        mark = None
        if n:
            before = spark.read.schema(counts).parquet(f"{path}/counts").filter(F.col("batch") < n).agg(F.max("newest_us")).first()[0]
            mark = None if before is None else before - late_s * 1_000_000
        seen = Observation()
        named = [F.count_if(F.col("outcome") == o).alias(o) for o in ("applied", "late", "unknown", "stale")]
        dealt = result_outcomes(df, nodes, mark).observe(seen, F.max(F.unix_micros("reported")).alias("newest_us"), *named)
        dealt.write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/results/batch={n}")
        got = seen.get
        row = (n, got["newest_us"], *(got[o] for o in ("applied", "late", "unknown", "stale")))
        spark.createDataFrame([row], counts).write.mode("overwrite").parquet(f"{path}/counts/batch={n}")

    results.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_rechunk(chunks: DataFrame, chunk: int = CHUNK_BYTES, flush: int = FLUSH_BYTES, delay_ms: int = DELAY_MS, late: str = "1 minute") -> DataFrame:
    """(node, gen, stream, offset, data): small writes (node, gen, stream, seq, ts, data) put together, data of at most ``chunk`` bytes.

    Whole chunks go when ``flush`` bytes are held; what is held goes when the watermark is delay_ms past the oldest of it. Writes are
    taken by seq, each once; one with a seq at or below what has been taken is a replay. The state of a stream is less than flush bytes.
    """
    ship(chunks.sparkSession)
    kind = chunks.schema["node"].dataType.simpleString()

    def gather(at: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        offset, top, since, held = state.get if state.exists else (0, None, None, b"")
        buffer = bytearray(held)
        out: list[tuple[int, bytes]] = []

        def cut(least: int) -> None:
            nonlocal offset
            done = 0
            while len(buffer) - done >= least and len(buffer) > done:
                piece = bytes(buffer[done : done + chunk])
                out.append((offset, piece))
                offset, done = offset + len(piece), done + len(piece)
            del buffer[:done]

        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            rows = sorted((a, b, bytes(c)) for part in parts for a, b, c in zip(part["seq"].tolist(), part["ms"].tolist(), part["data"].tolist(), strict=True))
            for seq, ms, data in rows:
                if top is not None and seq <= top:
                    continue
                top = seq
                since = ms if not buffer else since
                buffer += data
                if len(buffer) >= flush:
                    cut(chunk)
                    since = ms
        if buffer and since + delay_ms < mark:
            cut(1)
        state.update((offset, top, since if buffer else None, bytes(buffer)))
        if buffer:
            state.setTimeoutTimestamp(max(mark + 1, since + delay_ms + 1))
        if out:
            yield pd.DataFrame({"node": [at[0]] * len(out), "gen": [at[1]] * len(out), "stream": [at[2]] * len(out), "offset": [o for o, _ in out], "data": [d for _, d in out]})

    rows = chunks.select("node", F.col("gen").cast("long").alias("gen"), F.coalesce("stream", F.lit("")).alias("stream"), F.col("seq").cast("long").alias("seq"), "ts", F.coalesce(F.col("data").cast("binary"), F.lit(b"")).alias("data"))
    kept = rows.dropna(subset=["node", "gen", "seq", "ts"]).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return kept.groupBy("node", "gen", "stream").applyInPandasWithState(gather, f"node {kind}, gen long, stream string, offset long, data binary", "offset long, top long, since long, held binary", "append", GroupStateTimeout.EventTimeTimeout)
