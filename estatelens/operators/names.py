"""Structure of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions.text import classify_name, name_pattern
from .histogram import fold_other, shares, value_counts


def name_patterns(df: DataFrame, name: str, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Shares of whole patterns, and of token classes per position.

    Names shrink to counted class sequences first; positions are read off those.
    """
    named = df.where(F.col(name).isNotNull())
    return sequence_shares(value_counts(named.select(classify_name(name).alias("classes")), "classes"), min_size)


def sequence_shares(sequences: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """The same from counted class sequences (classes, n)."""
    sequences = sequences.where(F.col("classes").isNotNull())
    patterns = sequences.groupBy(name_pattern("classes").alias("pattern")).agg(
        F.sum("n").alias("n")
    )
    positions = (
        sequences.select("n", F.posexplode("classes").alias("position", "token_class"))
        .groupBy("position", "token_class")
        .agg(F.sum("n").alias("n"))
    )
    return (
        shares(fold_other(patterns, "pattern", min_size)),
        shares(fold_other(positions, "token_class", min_size, ["position"]), ["position"]),
    )
