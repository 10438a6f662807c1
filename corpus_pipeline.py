"""A corpus pipeline over `documents`: quality, near copies, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir) and gives a frame; `run` writes each stage's frame as
Parquet into the shared folder and reads it again for the next one. All stages but the last
return the columns of documents as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estatelens.llm import decontamination, mixing, quality, sharding, similar
from estatelens.llm.common import table
from estatelens.session import settle


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, similarity 0.8 or more."""
    return similar.one_of_each(docs, "doc_id", "text", least=0.8, width=5)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in proportion 3, 1, 2; a document taken twice is there twice."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return sharding.sharded_documents(docs, n_shards=8, seed=42)


STAGES = [("quality", good), ("near_dedup", distinct), ("decontamination", clean), ("mix", mix), ("shards", shards)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's frame over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
