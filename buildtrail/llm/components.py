"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildtrail.llm.session import checkpointed


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


BROADCAST_EDGES, FEW = 100_000, 8  # about 100 bytes each; so few edges stay in so many partitions


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edges (u, v) of any ordered type -> (node, root), root the least node of the component; nodes without an edge have no row.

    A node's neighbours are never gathered: only their least is, and joined back.
    """
    now = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())  # v < u: the lesser node of an edge
    mark = _print(now)
    for i in count(1):
        small = mark[0] <= BROADCAST_EDGES
        near = F.broadcast if small else lambda df: df
        now = now.coalesce(FEW) if small else now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(near(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(near(least), "u")
        stars = joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = checkpointed(stars.coalesce(FEW) if small else stars)
        new = _print(now)
        if new == mark:
            break
        if i == most:
            raise RuntimeError(f"components still change after {most} rounds")
        mark = new
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
