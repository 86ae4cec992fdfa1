"""Ranks within groups of any size: no group is sorted in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildtrail.lineage import checkpointed
from buildtrail.ship import shuffle_partitions


def ranked(df: DataFrame, group: list[str], order: list[str], nth: str = "nth", total: str = "total") -> DataFrame:
    """df with nth (a row's place in its group, from 1, by order) and total (the group's rows).

    Rows are dealt by ranges of (group, order), so that a hot group takes as many tasks as its rows need. A row's place is its place
    in its range and what earlier ranges hold of its group. Null groups and null values come first and are ranked as any other. Rows
    equal in group and order meet in one range; which of them comes first is open.
    """
    ranges = max(8, shuffle_partitions(df.sparkSession))
    dealt = checkpointed(df.repartitionByRange(ranges, *group, *order).withColumn("__range", F.spark_partition_id()))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy("__range", *group).agg(F.count("*").alias("__n"))  # a row for each range that a group meets
    runs = runs.select(F.col("__range").alias("__at"), *(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias(total))
    placed = dealt.withColumn(nth, F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)], F.col("__range") == F.col("__at"))
    return placed.join(runs, same).select(*df.columns, (F.col(nth) + F.col("__before")).alias(nth), total)


def runs_of(df: DataFrame, group: str, value: str, out: str, most: int) -> DataFrame:
    """(group, run, out): the distinct values of each group in order, at most ``most`` in a row, so that no row grows with the data. Null values are left out."""
    places = ranked(df.select(group, value).filter(F.col(value).isNotNull()).distinct(), [group], [value])
    return places.groupBy(group, F.floor((F.col("nth") - 1) / most).alias("run")).agg(F.sort_array(F.collect_list(value)).alias(out))
