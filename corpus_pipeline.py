"""The corpus pipeline: STAGES in order, each written as Parquet and read again by the next.

Toxic documents go; repeated lines go, and documents of which no line is left; of each class of near
duplicates the smallest id stays; documents with a benchmark passage go; the rest is packed.

Null texts count as empty and stay, as long as they are no near copy (texts without words never are). Null ids come after all others.
Fully repeated rows are one document: of near copies only one row stays. Any further columns pass through, whatever their
names; an empty table gives an empty result. doc_id and text are needed, n_chars is counted anew where there is one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildtrail.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from buildtrail.llm.session import shared_folder

ORACLE_SQL = None  # packing and the learnt stages have no SQL; tests hold the stages against brute force


def _matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of docs with (left_semi) or without (left_anti) a row of keys (k, rank), whatever docs' columns are called."""
    work = "_" * (1 + max(len(c) for c in docs.columns))
    number, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    wide = docs.withColumn(work + "k", F.xxhash64(number, text)).withColumn(work + "rank", F.coalesce(number, F.lit((1 << 63) - 1)))
    named = keys.select(F.col("k").alias(work + "k"), F.col("rank").alias(work + "rank"))
    return wide.join(named, [work + "k", work + "rank"], how).select(*docs.columns)


def _wide(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): all of a document's columns in row, so that none can clash with what an operator adds."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least one half go; none where the labels gave the model nothing to tell texts by."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not (model.log_odds > toxicity.SHIFT).any():
        return docs
    return toxicity.score(_wide(docs), model).filter("score < 0.5").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents that had lines and have none left; n_chars is counted anew."""
    kept = line_dedup.dedup_lines(_wide(docs)).filter("n_removed = 0 or trim(text) <> ''")
    row = F.col("row").withField("text", F.col("text").cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        n = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return kept.select(row.alias("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each class; repeated rows stay once."""
    classes = jaccard_join.classes(docs)
    others = classes.filter((F.col("root.k") != F.col("k")) | (F.col("root.rank") != F.col("rank"))).select("k", "rank")
    return _matching(docs, others, "left_anti").dropDuplicates(["doc_id", "text"])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=1)
    return _matching(docs, found.select("k", "rank").distinct(), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each packed piece."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents table; results between stages go to the shared checkpoint folder."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
