"""Events and attempts: dedup, gaps, spans, retry trails, roll-ups. Every operator gives the same for replayed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildtrail.functions.scalars import backoff_ms
from buildtrail.ship import ship


def micros(c: Column | str) -> Column:
    """Microseconds of a timestamp of either kind."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def dedup_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def events_of(events: DataFrame, types: list[str]) -> DataFrame:
    return events.filter(F.col("type").isin(*types))


# The data fields of each type of event.
EVENT_FIELDS = {
    "request.node": "label string, platform string",
    "request.failed": "status string, err string",
    "node.offered": "claim string",
    "node.done": "cached boolean",
    "node.failed": "class string, exit int, phase string, stderr string",
    "node.declined": "reason string, fetcher string, platform string",
    "node.named": "name string",
    "node.queued": "reason string, cpu_milli long, mem_bytes long, runner string, free_cpu_milli long, free_mem_bytes long, running array<string>",
    "node.cancelled": "reason string",
    "node.offer-dropped": "claim string",
    "exec.started": "kind string, requests array<string>",
    "exec.phase": "phase string",
    "exec.progress": "phase string, objects long, bytes long, total long",
    "exec.output": "stream string, phase string, chunk binary, offset long",
    "exec.output-truncated": "stream string, cap long, written long",
    "exec.finished": "outcome string, exit int",
    "exec.cache": "cache string, stage string, ms long, bytes long, files long, cold boolean, result string",
    "exec.heartbeat": "phase string, cpu_ms long, mem_bytes long, mem_peak_bytes long",
    "exec.cas": "stored_bytes long, stored_objects long, stored_deduped long, pushed_bytes long, pushed_objects long, push_total_objects long",
    "emitter.dropped": "count long",
}
FAMILIES = {"server": ("request.", "node."), "exec": ("exec.",), "meta": ("emitter.",)}


def family(kind: Column) -> Column:
    """server, exec or meta by the type's first part; NULL for others."""
    out = F.lit(None).cast("string")
    for name, heads in FAMILIES.items():
        for head in heads:
            out = F.when(kind.startswith(head), name).otherwise(out)
    return out


def typed_events(events: DataFrame, kind: str, data: str = "data") -> DataFrame:
    """Events of one type, with a typed column for each field of its data (JSON text) in place of it.

    Absent fields are NULL, as are those of other kinds than they should be; a field called as a column of events gets the type's name before it.
    """
    rest = [c for c in events.columns if c != data]
    rows = events.filter(F.col("type") == kind)
    fields = EVENT_FIELDS.get(kind)
    if fields is None:
        return rows.select(*rest)
    parsed = rows.withColumn(data, F.from_json(F.col(data), fields, {"mode": "PERMISSIVE"}))
    taken = {c.lower() for c in rest}
    names = parsed.schema[data].dataType.names
    return parsed.select(*rest, *[F.col(data)[n].alias(f"{kind}.{n}" if n.lower() in taken else n) for n in names])


def latest_status(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last row's values for each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("s")).select(key, "s.*")


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Missing ranges of seq for each (emitter, boot)."""
    w = Window.partitionBy("emitter", "boot").orderBy("seq")
    before = events.select("emitter", "boot", "seq").distinct().withColumn("prev", F.lag("seq").over(w))
    return before.filter(F.col("seq") > F.col("prev") + 1).select("emitter", "boot", (F.col("prev") + 1).alias("gap_from"), (F.col("seq") - 1).alias("gap_to"), (F.col("seq") - F.col("prev") - 1).alias("missing"))


def progress_deltas(events: DataFrame, value: str, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """Cumulative readings as steps for each ``by`` (a job and its phase, say); a falling reading starts anew."""
    w = Window.partitionBy(*by).orderBy("seq")
    prev = F.lag(value).over(w)
    return events.withColumn("delta", F.when(prev.isNull() | (F.col(value) < prev), F.col(value)).otherwise(F.col(value) - prev))


def phase_durations(events: DataFrame, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """Microseconds that each ``by`` (node, or node and attempt) spends in each type until its next event; the last lasts 0."""
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    spans = events.withColumn("until", F.lead("ts").over(w))
    length = micros(F.coalesce("until", "ts")) - micros("ts")
    return spans.groupBy(*by, "type").agg(F.sum(length).alias("micros"), F.count("*").alias("times"))


def events_to_attempts(events: DataFrame, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """As-of join: attach each event to the latest exec.started of its ``by`` (node and runner) at or before it; none after a finish until the next start."""
    w = Window.partitionBy(*by).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    started = F.last(F.when(F.col("type") == "exec.started", F.col("seq")), ignorenulls=True).over(w)
    over = F.max(F.when(F.col("type") == "exec.finished", F.struct("ts", "seq"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.max(F.when(F.col("type") == "exec.started", F.struct("ts", "seq"))).over(w)
    out = events.withColumn("attempt", started).withColumn("__done", over).withColumn("__begun", begun)
    return out.withColumn("attempt", F.when(F.col("__done").isNull() | (F.col("__done") < F.col("__begun")), F.col("attempt"))).drop("__done", "__begun")


def attempt_usage(events: DataFrame, cpu: str, memory: str) -> DataFrame:
    """Last known cpu and memory reading of each node; NULL for what was never read (negative readings are unknown)."""
    known = lambda c: F.max_by(F.when(F.col(c) >= 0, F.col(c)), F.when(F.col(c) >= 0, F.struct("ts", "seq")))
    return events.groupBy("node").agg(known(cpu).alias("cpu"), known(memory).alias("memory"))


def dedup_attempts(attempts: DataFrame, order: list[str]) -> DataFrame:
    """One row for each (node, gen): the first by arrival, then by ``order``."""
    return dedup_first(attempts, ["node", "gen"], [F.col("arrival"), *map(F.col, order)])


def kept_in_window(key: np.ndarray, at: np.ndarray, width: int, held: tuple[int, int] | None) -> tuple[np.ndarray, tuple[int, int] | None]:
    """Which rows of (key, at), sorted, are no repeat within ``width`` of the last row kept; held: key and time of the last kept before, then after.

    A row after a gap of more than ``width`` stays, whatever was kept before. Only runs without such a gap, longer than ``width``, are
    stepped through, from kept row to kept row.
    """
    if not len(key):
        return np.zeros(0, bool), held
    stay = np.ones(len(key), bool)
    stay[1:] = (key[1:] != key[:-1]) | (at[1:] - at[:-1] > width)
    starts = np.flatnonzero(stay)
    ends = np.append(starts[1:], len(key))
    long = at[ends - 1] - at[starts] > width
    last = at[starts].copy()
    if held is not None and held[0] == key[0]:
        stay[0] = at[0] - held[1] > width
        last[0] = at[0] if stay[0] else held[1]
        long[0] = True
    for low, high, t in zip(starts[long].tolist(), ends[long].tolist(), last[long].tolist(), strict=True):
        i = low + int(np.searchsorted(at[low:high], t + width, "right"))
        while i < high:
            stay[i], t = True, int(at[i])
            i += max(1, int(np.searchsorted(at[i:high], t + width, "right")))
    mine = np.flatnonzero(stay & (key == key[-1]))
    return stay, (int(key[-1]), int(at[mine[-1]])) if len(mine) else held


def dedup_in_window(attempts: DataFrame, seconds: int, order: list[str]) -> DataFrame:
    """The rows of (node, gen) that are no repeat: the first, then each that comes more than ``seconds`` after the last row kept.

    Whether a row stays depends on the last one kept, so a key's rows are passed in order, a batch at a time, with one number as state.
    Rows without an arrival come first and are one instant.
    """
    columns = attempts.columns
    ship(attempts.sparkSession)
    sorted_ = attempts.withColumn("__us", F.coalesce(micros("arrival"), F.lit(-(1 << 61)))).withColumn("__k", F.xxhash64("node", "gen"))
    sorted_ = sorted_.repartition(F.col("node"), F.col("gen")).sortWithinPartitions("node", "gen", "arrival", *order)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            key, at = (batch.column(batch.num_columns - i).to_numpy(zero_copy_only=False) for i in (1, 2))
            stay, held = kept_in_window(key, at, seconds * 1_000_000, held)
            yield batch.filter(pa.array(stay))

    return sorted_.mapInArrow(keep, sorted_.schema).select(*columns)


def recordable_failures(attempts: DataFrame) -> DataFrame:
    """Attempts (class, disposition) that leave a failure record: all but good ones and cancelled ones that will be retried."""
    return attempts.filter((F.col("class") != "ok") & ~((F.col("class") == "cancelled") & (F.col("disposition") == "retry")))


def newest_attempts(attempts: DataFrame, n: int = 4) -> DataFrame:
    """The n newest attempts of each node, newest first (nth from 1)."""
    w = Window.partitionBy("node").orderBy(F.desc("gen"))
    return attempts.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def retry_trail(attempts: DataFrame, most_retries: int = 3, most_control: int = 20, base_ms: int = 1000) -> DataFrame:
    """Adds consec_retry, consec_control, disposition and backoff_ms to deduplicated attempts.

    retryable adds to consec_retry and zeroes consec_control; control and cancelled add to consec_control; ok zeroes
    both; other classes fail at once. Counters start anew after a final failure.
    """
    w = Window.partitionBy("node").orderBy("gen")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    retry, control = F.col("class") == "retryable", F.col("class").isin("control", "cancelled")
    fatal = ~F.col("class").isin("ok", "retryable", "control", "cancelled")
    total = lambda c, over: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(over), F.lit(0))
    trail = attempts.withColumn("__ok", total((F.col("class") == "ok") | fatal, before))
    trail = trail.withColumn("__n", F.sum(F.when(retry, 1).otherwise(0)).over(Window.partitionBy("node", "__ok").orderBy("gen").rowsBetween(Window.unboundedPreceding, 0)))
    # each most_retries + 1 retryable results end a trail, so the count goes round
    trail = trail.withColumn("consec_retry", F.when(F.col("__n") > 0, (F.col("__n") - F.when(retry, 1).otherwise(0)) % (most_retries + 1) + F.when(retry, 1).otherwise(0)).otherwise(0))
    trail = trail.withColumn("__island", total((F.col("class") == "ok") | fatal | retry, upto))
    trail = trail.withColumn("__c", F.sum(F.when(control, 1).otherwise(0)).over(Window.partitionBy("node", "__island").orderBy("gen").rowsBetween(Window.unboundedPreceding, 0)))
    trail = trail.withColumn("consec_control", F.when(control, (F.col("__c") - 1) % (most_control + 1) + 1).otherwise(0))
    failed = fatal | (retry & (F.col("consec_retry") > most_retries)) | (control & (F.col("consec_control") > most_control))
    trail = trail.withColumn("disposition", F.when(F.col("class") == "ok", "done").when(failed, "failed").otherwise("retry"))
    trail = trail.withColumn("consec_retry", F.when(F.col("class").isin("retryable", "control", "cancelled"), F.col("consec_retry")).otherwise(0))
    return trail.withColumn("backoff_ms", F.when(retry & ~failed, backoff_ms("consec_retry", base_ms)).otherwise(F.lit(0)).cast("long")).drop("__ok", "__n", "__island", "__c")


def failure_breakdown(attempts: DataFrame, dims: list[str]) -> DataFrame:
    return attempts.groupBy(*dims).agg(F.count("*").alias("attempts"), F.countDistinct("node").alias("nodes"))


def usage_rollup(attempts: DataFrame, dims: list[str], sums: list[str]) -> DataFrame:
    """Sums by all leading combinations of dims, with the level of the subtotal."""
    return attempts.rollup(*dims).agg(F.grouping_id().alias("level"), F.count("*").alias("attempts"), *[F.round(F.sum(c), 2).alias(c) for c in sums])


def fence_stale(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds reason: NULL for results that may be applied, else why they are dropped; nodes (node, gen, phase, last_gen: the last gen with a result).

    Of several results of one gen the first (by arrival, where there is such a column) is applied.
    """
    now = nodes.select("node", F.col("gen").alias("__gen"), F.col("phase").alias("__phase"), (F.col("last_gen") if "last_gen" in nodes.columns else F.lit(None).cast("long")).alias("__last"))
    joined = results.join(now, "node", "left")
    w = Window.partitionBy("node", "gen").orderBy(*(["arrival"] if "arrival" in results.columns else ["class"]))
    reason = F.when(F.col("__gen").isNull(), "unknown node").when(F.col("gen") != F.col("__gen"), "stale").when(F.col("gen") <= F.col("__last"), "handled")
    reason = reason.when(~F.col("__phase").isin("queued", "running"), "not running").when(F.row_number().over(w) > 1, "handled")
    return joined.withColumn("reason", reason).drop("__gen", "__phase", "__last")


def attempts_join(jobs: DataFrame, results: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One row for each (node, gen) that was enqueued, reported or recorded as failed; ``state`` says which; failures (node, gen, disposition, backoff_ms)."""
    j, r = jobs.select("node", "gen", "enqueued"), results.select("node", "gen", "class", "reported")
    out = j.join(r, ["node", "gen"], "full")
    state = F.when(F.col("class").isNull(), "no result").when(F.col("enqueued").isNull(), "no job").otherwise("both")
    if failures is None:
        return out.withColumn("state", state)
    f = failures.select("node", "gen", "disposition", "backoff_ms", F.lit(True).alias("recorded"))
    return out.withColumn("state", state).join(f, ["node", "gen"], "full").withColumn("recorded", F.coalesce("recorded", F.lit(False)))


def attempt_timing(attempts: DataFrame, now: Column | None = None) -> DataFrame:
    """queued_us and ran_us only where their ends are in order; elapsed_us from start, else enqueue, to the end, else to now, never negative.

    Attempts with neither start nor enqueue took 0, as do those that still run where no now is given.
    """
    span = lambda a, b: micros(b) - micros(a)
    begin = F.coalesce("started", "enqueued")
    return attempts.withColumn("queued_us", F.when(F.col("started") > F.col("enqueued"), span("enqueued", "started"))).withColumn("ran_us", F.when(F.col("finished") > F.col("started"), span("started", "finished"))).withColumn("elapsed_us", F.greatest(F.lit(0), (micros("finished") if now is None else F.coalesce(micros("finished"), micros(now))) - micros(begin)))


def apply_retention(failures: DataFrame, newest, days: int = 7, per_node: int = 8, max_bytes: int | None = None) -> DataFrame:
    """Rows of the last ``days`` before newest (a timestamp column or literal), the last per_node of each node.

    With max_bytes (of a column size), the oldest rows beyond that sum go too. The running sum is taken over days first, so no
    window holds all rows: days that fit whole stay, and only the day that crosses the bound is summed row by row.
    """
    w = Window.partitionBy("node").orderBy(F.desc("arrival"), F.desc("gen"))
    fresh = failures.filter(micros("arrival") > micros(newest) - days * 86_400_000_000)
    kept = fresh.withColumn("__nth", F.row_number().over(w)).filter(F.col("__nth") <= per_node).drop("__nth")
    if max_bytes is None:
        return kept
    dated = kept.withColumn("__day", F.floor(micros("arrival") / 86_400_000_000))
    upto = Window.orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)
    by_day = dated.groupBy("__day").agg(F.sum("size").alias("__all")).withColumn("__newer", F.coalesce(F.sum("__all").over(upto), F.lit(0)))  # a row a day, ``days`` at most
    placed = dated.join(F.broadcast(by_day), "__day").filter(F.col("__newer") < max_bytes)
    within = F.sum("size").over(Window.partitionBy("__day").orderBy(F.desc("arrival"), "node", F.desc("gen")))
    return placed.withColumn("__sum", F.col("__newer") + within).filter(F.col("__sum") <= max_bytes).drop("__day", "__all", "__newer", "__sum")
