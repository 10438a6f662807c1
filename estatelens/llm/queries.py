"""The corpus operators over the given tables, each with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from estatelens.llm import alignment, bpe, decontamination, exact, extraction, mixing, negatives, quality, secrets, sharding, simhash, toxicity, warc
from estatelens.llm.common import table

QUERIES, ORACLES = {}, {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Sources weigh 3, 1, 2 in turn and share 150% of all words."""
    return mixing.document_mix(table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


@query
def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), "doc_id", "text", distance=3, width=3)


@query
def op6_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.document_shards(table(spark, folder, "documents"), n_shards=8, seed=42)


@query
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"), "doc_id", "text")


ORACLES["op7_exact_dedup"] = exact.EXACT_SQL


@query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.document_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.document_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.page_texts(table(spark, folder, "pages"))


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


ORACLES["op9_warc"] = warc.ARCHIVED_SQL


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.document_secrets(table(spark, folder, "documents"))


@query
def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.document_tokens(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mined(table(spark, folder, "embeddings"))


ORACLES["op12_hard_negatives"] = negatives.MINED_SQL


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.document_alignment(table(spark, folder, "documents"), *files, public_tokenizers.PATTERN)
