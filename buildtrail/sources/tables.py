"""Readers and writers of the library's tables, batch or stream, with fixed schemas; optional fields may be absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "emitter string, boot string, seq bigint, ts_ns bigint, type string, request string, node string, runner string, data string"
RUSAGE = "struct<wall_ns:bigint,cpu_ns:bigint,max_rss:bigint,stored:bigint,deduped:bigint>"
RESULTS = f"node string, gen bigint, runner string, class string, exit int, err_summary string, refs array<struct<name:string,key:string,label:string>>, rusage {RUSAGE}, scratch_ref string"
FAILURES = (
    "node string, gen bigint, platform string, label string, origin string, disposition string, err_summary string, consec_retry int, consec_control int, backoff_ms bigint,"
    " request_ids array<string>, for_f array<string>, class string, exit int, runner string, enqueued_ns bigint, started_ns bigint, failed_ns bigint,"
    " log_head binary, log_gap bigint, log_tail binary, log_missing boolean"
)
LOG_CHUNKS = "node string, gen bigint, stream string, seq bigint, data binary, arrival bigint"


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    """The rows under path with this schema; columns that the files lack are NULL."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).format(fmt).load(path)


def read_event_batches(spark: SparkSession, path: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """Files of JSON lines, each an array of events whose data may be any object: the events, and what doesn't decode.

    The second frame (value) holds whole lines that are no array, and single events with a field of a wrong type; the other events of
    their line are in the first. Empty lines are neither.
    """
    lines = (spark.readStream if stream else spark.read).text(path).filter("trim(value) <> ''")
    items = lines.withColumn("items", F.from_json("value", "array<string>"))
    one = items.select(F.explode(F.coalesce("items", F.array("value"))).alias("raw"), F.col("items").isNull().alias("broken"))
    read = F.from_json("raw", f"{EVENTS}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    parsed = one.withColumn("event", read)
    bad = F.col("broken") | F.col("raw").isNull() | F.col("event").isNull() | F.col("event.__bad").isNotNull()
    return parsed.filter(~bad).select(F.col("event").dropFields("__bad").alias("event")).select("event.*"), parsed.filter(bad).select(F.col("raw").alias("value"))


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    """The event log. With fmt "batches", the events of ``read_event_batches``, which also tells what didn't decode."""
    return read_event_batches(spark, path, stream)[0] if fmt == "batches" else read_table(spark, path, EVENTS, fmt, stream)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    return read_table(spark, path, RESULTS, fmt, stream)


def read_failures(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    return read_table(spark, path, FAILURES, fmt, stream)


def read_log_chunks(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    return read_table(spark, path, LOG_CHUNKS, fmt, stream)


def read_tree(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """(path, content, size, mtime[, mode, uid, gid, link_target]) of all files under path; what only a manifest (path, ...) knows is joined."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = F.expr(f"substring(regexp_replace(path, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*(?=/))?', ''), {len(root) + 2})")
    tree = files.select(inner.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return tree if manifest is None else tree.join(manifest, "path", "left")


def write_diagnosis(reports: DataFrame, path: str) -> None:
    """reports (node, report: JSON text), one line a node."""
    reports.select("report").write.mode("overwrite").text(path)


def write_attempt_logs(attempts: DataFrame, path: str) -> None:
    """attempts (node, gen, head, tail): each part verbatim under node=.../gen=..., empty parts skipped."""
    parts = F.array(F.struct(F.lit("head").alias("part"), F.col("head").alias("data")), F.struct(F.lit("tail").alias("part"), F.col("tail").alias("data")))
    rows = attempts.select("node", "gen", F.explode(parts).alias("p")).select("node", "gen", "p.part", "p.data").filter(F.octet_length("data") > 0)
    rows.repartition(F.col("node")).write.mode("overwrite").partitionBy("node", "gen").parquet(path)
