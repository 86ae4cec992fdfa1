"""Stores on disk: objects in a table bucketed by key, refs in versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from buildtrail.operators.store import append_objects


def create_store(objects: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Write objects (key, ...), one row a key, as a table bucketed and sorted by key; path makes it an external one."""
    _written(objects, table, buckets, path, "errorifexists")


def _written(rows: DataFrame, table: str, buckets: int, path: str | None, mode: str) -> None:
    writer = rows.repartition(buckets, "key").write.mode(mode).bucketBy(buckets, "key").sortBy("key")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def store_buckets(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").collect()
    if not rows:
        raise ValueError(f"{table} has no buckets")
    return int(rows[0]["data_type"])


def missing_in_store(spark: SparkSession, table: str, wanted: DataFrame) -> DataFrame:
    """The keys of wanted (key) that the table lacks, each once. Only wanted is shuffled: the table is read bucket by bucket."""
    keys = wanted.select("key").distinct().repartition(store_buckets(spark, table), "key")
    return keys.join(spark.table(table).select("key").hint("merge"), "key", "left_anti")


def append_to_store(spark: SparkSession, table: str, batch: DataFrame) -> None:
    """Add the rows of batch (key, size) whose key the table lacks, each key once, without a shuffle of the table. Repeating a batch adds nothing.

    One writer at a time: two that run at once may both add a key.
    """
    new = append_objects(spark.table(table).select("key").hint("merge"), batch)
    location = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Location'").first()["data_type"]
    _written(new, table, store_buckets(spark, table), location, "append")


def write_snapshot(refs: DataFrame, path: str, expected: int | None = None) -> int:
    """Write refs as the next version under path, and return its number. With expected, the version that refs were read from: an error if
    there is a newer one. A version is written once: of two writers of the same one the second fails."""
    spark = refs.sparkSession
    now = latest_version(spark, path)
    if expected is not None and now != expected:
        raise RuntimeError(f"version {now} of {path} is newer than {expected}")
    refs.write.mode("errorifexists").parquet(f"{path}/version={now + 1}")
    return now + 1


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the newest complete version under path, 0 for none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "version=*/_SUCCESS")) if fs.exists(root) else None
    return max((int(str(s.getPath().getParent().getName()).partition("=")[2]) for s in found or []), default=0)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Refs as of a version, by default the newest."""
    return spark.read.parquet(f"{path}/version={latest_version(spark, path) if version is None else version}")
