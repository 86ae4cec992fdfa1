"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from buildtrail.llm import chat_format, decontaminate, html_extract, jaccard_join, line_dedup, packing, sharding, spelling, substring_dedup, suffix_dedup, toxicity, vector_search, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_block_html": html_extract.query,
        "op2_suffix_dedup": suffix_dedup.query,
        "op3_latent_decontamination": decontaminate.query,
        "op4_chat_examples": chat_format.query,
        "op5_toxic_segments": toxicity.query,
        "op6_line_dedup": line_dedup.query,
        "op7_additive_quantisation": vector_search.query,
        "op8_jaccard_join": jaccard_join.query,
        "op9_nnls_packing": packing.query,
        "op10_fm_substring_dedup": substring_dedup.query,
        "op11_exact_whitening": whitening.query,
        "op12_stratified_shards": sharding.query,
        "op13_bloom_spelling": spelling.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_examples": chat_format.SQL,
        "op6_line_dedup": line_dedup.SQL,
        "op12_stratified_shards": sharding.SQL,
        "op13_bloom_spelling": spelling.SQL,
    }
