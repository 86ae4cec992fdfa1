"""Runners: capacity, fits, liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildtrail.functions.scalars import GIB, LADDER
from buildtrail.operators.telemetry import micros


def ladder(spark: SparkSession) -> DataFrame:
    """The nine rungs: (ord, rung, rung_cpu, rung_mem)."""
    return spark.createDataFrame([(i, name, cpu, gib * GIB) for i, (name, cpu, gib) in enumerate(LADDER)], "ord int, rung string, rung_cpu long, rung_mem long")


def round_to_class(jobs: DataFrame) -> DataFrame:
    """Adds rung (the first that fits cpu_milli and mem_bytes, else the top one) and capped. Requirements are joined once each."""
    rungs = ladder(jobs.sparkSession)
    needs = jobs.select("cpu_milli", "mem_bytes").distinct()
    fit = needs.join(F.broadcast(rungs), (F.col("cpu_milli") <= F.col("rung_cpu")) & (F.col("mem_bytes") <= F.col("rung_mem")), "left")
    best = fit.groupBy("cpu_milli", "mem_bytes").agg(F.min_by("rung", "ord").alias("found"))
    out = jobs.join(best, ["cpu_milli", "mem_bytes"])
    return out.withColumn("capped", F.col("found").isNull()).withColumn("rung", F.coalesce("found", F.lit(LADDER[-1][0]))).drop("found")


def classes_within(runners: DataFrame) -> DataFrame:
    """Adds rungs (how many a runner can serve) and size (the last of them, NULL for none)."""
    sizes = runners.select("cpu_milli", "mem_bytes").distinct()
    fit = sizes.join(F.broadcast(ladder(runners.sparkSession)), (F.col("rung_cpu") <= F.col("cpu_milli")) & (F.col("rung_mem") <= F.col("mem_bytes")), "left")
    best = fit.groupBy("cpu_milli", "mem_bytes").agg(F.count("rung").alias("rungs"), F.max_by("rung", "ord").alias("size"))
    return runners.join(best, ["cpu_milli", "mem_bytes"])


def fit_runners(queued: DataFrame, runners: DataFrame) -> DataFrame:
    """(platform, cpu_milli, mem_bytes, runner, fits): the runner that each queued requirement fits with the least slack, ties to the smaller id.

    Slack is compared by cpu, then memory; fits counts all runners that do. No pair of requirement and runner is made: cpu values are cut
    into blocks of powers of two, a runner lies in one block of each size, and "at least c" is a few blocks. Within a
    block, rows in falling order of memory carry the best runner and the number of runners so far. Rows and sorting are linear in
    requirements and runners, times the bits of the largest cpu value. Nulls and negative values fit nothing.
    """
    fine = "platform is not null and cpu >= 0 and mem >= 0"
    needs = queued.selectExpr("platform", "cast(cpu_milli AS long) AS cpu", "cast(mem_bytes AS long) AS mem").filter(fine).distinct()
    free = runners.selectExpr("platform", "id AS runner", "cast(free_cpu AS long) AS cpu", "cast(free_mem AS long) AS mem").filter(fine).filter("runner is not null")
    top = needs.select("cpu").unionByName(free.select("cpu")).agg(F.max("cpu")).first()[0] or 0
    bits = max(1, int(top).bit_length())
    here = free.selectExpr("platform", "cpu", "mem", "runner", f"explode(transform(sequence(0, {bits - 1}), l -> struct(l AS level, shiftright(cpu, l) AS block))) AS b")
    at_least = f"concat(array(struct(0 AS level, cpu AS block)), transform(filter(sequence(0, {bits - 1}), l -> shiftright(cpu, l) % 2 = 0), l -> struct(l AS level, shiftright(cpu, l) + 1 AS block)))"
    ask = needs.selectExpr("platform", "cpu", "mem", f"explode({at_least}) AS b")
    put = here.selectExpr("platform", "b.level", "b.block", "mem", "0 AS turn", "struct(cpu, mem, runner) AS has", "cast(null AS long) AS cpu")
    want = ask.selectExpr("platform", "b.level", "b.block", "mem", "1 AS turn", "cpu").withColumn("has", F.lit(None).cast(put.schema["has"].dataType))
    so_far = Window.partitionBy("platform", "level", "block").orderBy(F.desc("mem"), "turn").rowsBetween(Window.unboundedPreceding, 0)
    met = put.unionByName(want).withColumn("best", F.min("has").over(so_far)).withColumn("fits", F.count("has").over(so_far)).filter("turn = 1 and best is not null")
    found = met.groupBy("platform", "cpu", "mem").agg(F.min("best").alias("best"), F.sum("fits").alias("fits"))
    kinds = queued.schema
    return found.select("platform", F.col("cpu").cast(kinds["cpu_milli"].dataType).alias("cpu_milli"), F.col("mem").cast(kinds["mem_bytes"].dataType).alias("mem_bytes"), "best.runner", "fits")


def fleet(hello: DataFrame, beats: DataFrame) -> DataFrame:
    """hello (id, platform, cpu, seen) and beats (id, free_cpu, seen) -> a row a runner; a later hello resets the free value; beat-only runners have no platform."""
    h = hello.filter("id is not null").groupBy("id").agg(F.max_by(F.struct("platform", "cpu"), "seen").alias("h"), F.max("seen").alias("hello_seen"))
    b = beats.filter("id is not null").groupBy("id").agg(F.max_by("free_cpu", "seen").alias("free"), F.max("seen").alias("beat_seen"))
    both = h.join(b, "id", "full")
    fresh = F.when(F.col("hello_seen").isNull() | (F.col("beat_seen") >= F.col("hello_seen")), F.col("free"))
    return both.select("id", "h.platform", F.coalesce(fresh, F.col("h.cpu")).alias("free_cpu"), F.greatest("hello_seen", "beat_seen").alias("seen"))


def ledger(holds: DataFrame, runners: DataFrame) -> DataFrame:
    """Free capacity of each runner (0 at least) and holds in flight."""
    held = holds.groupBy("runner").agg(F.sum("cpu_milli").alias("used_cpu"), F.count("*").alias("in_flight"))
    out = runners.join(held, runners["id"] == held["runner"], "left")
    return out.select("id", F.greatest(F.lit(0), F.col("capacity") - F.coalesce("used_cpu", F.lit(0))).alias("free_cpu"), F.coalesce("in_flight", F.lit(0)).alias("in_flight"))


def ledger_of_jobs(holds: DataFrame, runners: DataFrame, prefix: str = "job/") -> DataFrame:
    """(id, free_cpu, free_mem, in_flight, slots): what all holds (runner, name, cpu_milli, mem_bytes) leave of a runner (id, cpu_milli, mem_bytes), 0 at least.

    in_flight counts the holds of jobs, by the prefix of their names; slots counts all, reservations included.
    """
    held = holds.groupBy(F.col("runner").alias("id")).agg(F.sum("cpu_milli").alias("__c"), F.sum("mem_bytes").alias("__m"), F.count_if(F.col("name").startswith(prefix)).alias("__n"), F.count("*").alias("__s"))
    out = runners.join(held, "id", "left")
    free = lambda have, used: F.greatest(F.lit(0), F.col(have) - F.coalesce(used, F.lit(0)))
    return out.select("id", free("cpu_milli", "__c").alias("free_cpu"), free("mem_bytes", "__m").alias("free_mem"), F.coalesce("__n", F.lit(0)).alias("in_flight"), F.coalesce("__s", F.lit(0)).alias("slots"))


def peak_usage(holds: DataFrame) -> DataFrame:
    """Most slots, cpu and memory held at once by each runner, each with the first time it was; holds end before others begin at the same time.

    Changes are summed by runner and time before the running sums, so repeated times don't widen the window's rows.
    """
    change = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).alias("slots"), (sign * F.col("cpu_milli")).alias("cpu_milli"), (sign * F.col("mem_bytes")).alias("mem_bytes"))
    steps = holds.select("runner", F.explode(F.array(change("since", 1), change("until", -1))).alias("s")).select("runner", "s.*")
    kinds = ("slots", "cpu_milli", "mem_bytes")
    at = steps.groupBy("runner", "at").agg(*[F.sum(c).alias(c) for c in kinds])
    w = Window.partitionBy("runner").orderBy("at")
    at = at.select("runner", "at", *[F.sum(c).over(w).alias(c) for c in kinds])
    return at.groupBy("runner").agg(*[F.max(c).alias(c) for c in kinds], *[F.min_by("at", F.struct(-F.col(c), "at")).alias(f"{c}_at") for c in kinds])


def peak_concurrency(holds: DataFrame) -> DataFrame:
    """Most slots and cpu held at once by each runner; holds end before others begin at the same time."""
    steps = holds.select("runner", F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("n"), F.col("cpu_milli").alias("cpu")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("n"), (-F.col("cpu_milli")).alias("cpu")))).alias("s")).select("runner", "s.*")
    at = steps.groupBy("runner", "at").agg(F.sum(F.when(F.col("n") < 0, F.col("n")).otherwise(0)).alias("down"), F.sum("n").alias("n"), F.sum("cpu").alias("cpu"))
    w = Window.partitionBy("runner").orderBy("at")
    return at.withColumn("n", F.sum("n").over(w)).withColumn("cpu", F.sum("cpu").over(w)).groupBy("runner").agg(F.max("n").alias("slots"), F.max("cpu").alias("cpu_milli"))


def runnerless_gaps(seen: DataFrame, window_s: int, least_s: int) -> DataFrame:
    """(platform, gap_from, gap_s): spans in which no runner of a platform had been seen for window_s, of least_s at least."""
    w = Window.partitionBy("platform").orderBy("us")
    rows = seen.select("platform", micros("seen").alias("us")).distinct().withColumn("prev", F.lag("us").over(w))
    gap = (F.col("us") - F.col("prev")) / 1e6 - window_s
    return rows.withColumn("gap_s", gap).filter(F.col("gap_s") >= least_s).select("platform", (F.col("prev") + window_s * 1_000_000).alias("gap_from_us"), F.round("gap_s", 3).alias("gap_s"))


def liveness_gate(requests: DataFrame, runners: DataFrame, window_s: int) -> DataFrame:
    """Requests whose platform has no runner seen within window_s before the request; requests (request, platform, asked), runners (platform, seen)."""
    bucket = lambda c: F.floor(micros(c) / (window_s * 1_000_000))
    beats = runners.select(F.col("platform").alias("p"), F.col("seen"), F.explode(F.array(bucket("seen"), bucket("seen") + 1)).alias("b")).distinct()
    near = (F.col("platform") == F.col("p")) & (bucket("asked") == F.col("b")) & (micros("asked") - micros("seen")).between(0, window_s * 1_000_000)
    return requests.join(beats, near, "left_anti")
