"""Content store and trees: dedup, missing sets, transfers, path work, chunking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildtrail.lineage import checkpointed
from buildtrail.ship import ship, shuffle_partitions


def append_objects(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of batch (key, size) to write: each absent key once."""
    return batch.groupBy("key").agg(F.max("size").alias("size")).join(store.select("key"), "key", "left_anti")


def ingest_stats(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Objects and bytes offered, stored and found present or repeated."""
    new = append_objects(store, batch).agg(F.count("*").alias("stored"), F.coalesce(F.sum("size"), F.lit(0)).alias("stored_bytes"))
    return batch.agg(F.count("*").alias("offered"), F.coalesce(F.sum("size"), F.lit(0)).alias("offered_bytes")).crossJoin(new).withColumn("deduped", F.col("offered") - F.col("stored"))


def missing_objects(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    return wanted.select("key").distinct().join(objects.select("key"), "key", "left_anti")


def undelivered(wants: DataFrame, received: DataFrame) -> DataFrame:
    """How many wanted keys didn't arrive, and one of them."""
    return missing_objects(wants, received).agg(F.count("*").alias("missing"), F.min("key").alias("example"))


def verify_content(blobs: DataFrame) -> DataFrame:
    """Blobs (digest, content) whose content has another sha256."""
    return blobs.filter(F.sha2("content", 256) != F.col("digest"))


def store_union(*sets: DataFrame) -> DataFrame:
    out = sets[0].select("key")
    for s in sets[1:]:
        out = out.unionByName(s.select("key"))
    return out.distinct()


def dedupe_keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def sweep_blobs(blobs: DataFrame, now: Column, days: int) -> DataFrame:
    """Count and bytes of blobs (last_read, size) that weren't read for ``days``."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    old = us(now) - us(F.col("last_read")) > days * 86_400_000_000
    return blobs.filter(old).agg(F.count("*").alias("removed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def expired_blobs(blobs: DataFrame, now: Column, days: int) -> DataFrame:
    """Blobs (name, last_read, size) that a sweep removes: not read for ``days``, or left under a temporary name (tmp-) for over an hour."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    age = us(now) - us(F.col("last_read"))
    return blobs.filter((age > days * 86_400_000_000) | (F.col("name").startswith("tmp-") & (age > 3_600_000_000)))


def ancestors(path: Column) -> Column:
    """The path and all directories above it, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def tree_sizes(entries: DataFrame) -> DataFrame:
    """(dir, files, bytes) for each directory of entries (path, size), "" for the whole tree."""
    dirs = F.concat(F.array(F.lit("")), F.filter(ancestors(F.col("path")), lambda p: p != F.col("path")))
    return entries.select(F.explode(dirs).alias("dir"), "size").groupBy("dir").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def prune_tree(entries: DataFrame, keep: DataFrame) -> DataFrame:
    """Entries at or below a path of keep (path), and the directories above those paths, where they are entries."""
    marks = keep.select(F.col("path").alias("__up")).distinct()
    hit = entries.select("path", F.explode(ancestors(F.col("path"))).alias("__up")).join(marks, "__up", "left_semi").select("path")
    above = hit.select(F.explode(ancestors(F.col("path"))).alias("path"))
    return entries.join(above.distinct(), "path", "left_semi")


def missing_keeps(entries: DataFrame, keep: DataFrame) -> DataFrame:
    """Paths of keep that no entry is at or below."""
    there = entries.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return keep.select("path").distinct().join(there, "path", "left_anti")


def overlay_tree(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (path, content_key) with files put over them; origin says where each row is from."""
    f = files.select("path", F.col("content_key").alias("__new"))
    both = entries.select("path", F.col("content_key").alias("__old")).join(f, "path", "full")
    origin = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "added").otherwise("replaced")
    return both.select("path", F.coalesce("__new", "__old").alias("content_key"), origin.alias("origin"))


def tree_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every path of two trees (path, content_key): removed, added, changed or unchanged."""
    both = a.select("path", F.col("content_key").alias("__a")).join(b.select("path", F.col("content_key").alias("__b")), "path", "full")
    state = F.when(F.col("__b").isNull(), "removed").when(F.col("__a").isNull(), "added").when(F.col("__a") == F.col("__b"), "unchanged").otherwise("changed")
    return both.select("path", state.alias("state"))


EPOCH_NS = 315_532_800 * 10**9  # fixed value: the time of all entries of a normalised tree, 1980


def merkle_trees(entries: DataFrame, normalize: bool = True) -> DataFrame:
    """(tree, path, digest) of all directories of all trees, "" for the root, from the leaves up.

    entries: (tree, path, kind, mode, content_key, target[, uid, gid, mtime]), kind "file", "dir" or "link"; a directory needs no row. A
    directory's digest is that of the sorted lines of its children: name, kind, mode, uid, gid, mtime, content. Normalised, uid
    and gid are 0 and mtime is EPOCH_NS, so that only content and modes count. Large directories are first digested in groups by the
    start of the name's hash, so that no row holds all children. A tree without entries has no row.
    """
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    meta = {"uid": F.lit(0), "gid": F.lit(0), "mtime": F.lit(EPOCH_NS)} if normalize else {c: F.col(c) if c in entries.columns else F.lit(0) for c in ("uid", "gid", "mtime")}
    kind, mode = F.coalesce("kind", F.lit("dir")), F.coalesce(F.col("mode"), F.lit(0o555))
    level = entries.select("tree", "path", kind.alias("kind"), F.concat_ws("\t", kind, mode.cast("string"), *[c.cast("string") for c in meta.values()]).alias("meta"), F.coalesce("content_key", "target", F.lit("")).alias("digest"))
    level = checkpointed(level.withColumn("depth", F.size(F.split("path", "/"))))
    made = F.concat_ws("\t", F.lit("dir"), F.lit("365"), F.lit("0"), F.lit("0"), F.lit(str(EPOCH_NS if normalize else 0)))
    top = level.agg(F.max("depth")).first()[0] or 0
    out, ready = None, None
    for depth in range(top, 0, -1):
        now = level.filter(F.col("depth") == depth)
        if ready is not None:  # digests of directories of this depth, with or without a row of their own
            dirs = now.filter("kind = 'dir'").select("tree", "path", F.col("meta").alias("own"))
            inner = ready.join(dirs, ["tree", "path"], "left").select("tree", "path", F.coalesce("own", made).alias("meta"), "digest")
            now = now.join(ready.select("tree", "path"), ["tree", "path"], "left_anti").select("tree", "path", "meta", "digest").unionByName(inner)
        line = F.concat_ws("\t", F.substring_index("path", "/", -1), "meta", "digest")
        lines = now.select("tree", parent.alias("dir"), line.alias("line"), F.substring(F.sha2(F.substring_index("path", "/", -1), 256), 1, 3).alias("part"))
        parts = lines.groupBy("tree", "dir", "part").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"))
        joined = parts.groupBy("tree", "dir").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("part", "digest"))), "\n"), 256).alias("digest"))
        ready = checkpointed(joined.select("tree", F.col("dir").alias("path"), "digest"))
        out = ready if out is None else out.unionByName(ready)
    return out if out is not None else entries.select("tree", "path", F.col("content_key").alias("digest")).limit(0)


def merkle_keys(entries: DataFrame) -> DataFrame:
    """(path, digest) of all directories of one tree of files (path, content_key)."""
    one = entries.select(F.lit(0).alias("tree"), "path", F.lit("file").alias("kind"), F.lit(0o444).alias("mode"), "content_key", F.lit(None).cast("string").alias("target"))
    return merkle_trees(one).drop("tree")


def split_rounds(wants: DataFrame, most: int = 32768) -> DataFrame:
    """wants (key) -> (key, round): rounds of at most ``most`` distinct keys in key order, without one sort of all in a task."""
    keys = wants.select("key").distinct()
    salts = max(8, shuffle_partitions(wants.sparkSession))
    ranged = checkpointed(keys.repartitionByRange(salts, "key").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    shift = counts.withColumn("shift", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return ranged.withColumn("nth", nth).join(F.broadcast(shift), "part").select("key", F.floor((F.col("nth") + F.col("shift")) / most).alias("round"))


def chunk_content(blobs: DataFrame, least: int = 32 << 10, normal: int = 128 << 10, most: int = 256 << 10) -> DataFrame:
    """blobs (key, content binary) -> (key, offset, length, chunk): content-defined chunks, an empty blob as one empty chunk.

    A chunk ends after a byte where the rolling sum of mixed bytes over the last 32 has its low bits zero, at most after ``most`` bytes.
    """
    ship(blobs.sparkSession)
    bits = max(1, int(np.log2(max(2, normal - least))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64)
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                raw = value.as_py() or b""
                buf = np.frombuffer(raw, np.uint8)
                sums = np.cumsum(gear[buf])
                roll = sums.copy()
                roll[32:] -= sums[:-32]
                marks = np.flatnonzero((roll >> np.uint64(20)) & np.uint64((1 << bits) - 1) == 0) + 1
                start, rows = 0, []
                while True:
                    i = np.searchsorted(marks, start + least)
                    end = min(int(marks[i]) if i < len(marks) else len(raw), start + most, len(raw))
                    rows.append((start, end))
                    start = end
                    if start >= len(raw):
                        break
                yield pa.RecordBatch.from_pydict({"key": pa.array([key.as_py()] * len(rows)).cast(batch.schema.field(0).type), "offset": pa.array([a for a, _ in rows], pa.int64()), "length": pa.array([b - a for a, b in rows], pa.int64()), "chunk": pa.array([raw[a:b] for a, b in rows], pa.binary())})

    kind = blobs.schema["key"].dataType.simpleString()
    return blobs.select("key", F.col("content").cast("binary").alias("content")).mapInArrow(cut, f"key {kind}, offset long, length long, chunk binary")


def layer_sharing(images: DataFrame) -> DataFrame:
    """images (image, deps array, size) -> a row a layer: identity of its distinct sorted deps, images that share it, bytes saved.

    With a column shell, what it names is part of the layer: NULL is an image without one.
    """
    deps = F.array_join(F.array_sort(F.array_distinct("deps")), "\n")
    ident = F.sha2(F.concat_ws("\n\n", deps, "shell") if "shell" in images.columns else deps, 256)
    return images.withColumn("layer", ident).groupBy("layer").agg(F.count("*").alias("images"), (F.sum("size") - F.max("size")).alias("saved"))
