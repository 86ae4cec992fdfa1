"""Row keys for text tables whose ids may be null or repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = (1 << 63) - 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, rank, text): rank is the id, the largest long for null; text is "" for null.

    k is a hash of id and text: only fully repeated rows share (k, rank), and they get equal results.
    """
    number, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(number, text).alias("k"), F.coalesce(number, F.lit(LAST)).alias("rank"), text.alias("text"))


def ident() -> Column:
    """The id of a ``rank``."""
    return F.when(F.col("rank") != LAST, F.col("rank"))


def copies(texts: DataFrame) -> DataFrame:
    """Of ``keyed`` rows: (k, rank, first) for each text that stands in several rows; first: the least rank."""
    by = texts.select("k", "rank", F.unhex(F.sha2("text", 256)).alias("h"))
    first = by.groupBy("h").agg(F.min("rank").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return by.join(first, "h").select("k", "rank", "first").distinct()
