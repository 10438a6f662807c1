"""Tag keys, tag values and tag coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.catalogues import words
from estatelens.functions.jsonmaps import json_map
from estatelens.functions.text import (
    canonical_namespace, is_identifier_key, is_identifier_value, is_listed,
)
from estatelens.session import settle
from .histogram import check_floor, fold_other, rows_of, shares, value_counts


def tag_value_counts(
    df: DataFrame, tags: str = "tags", keys: tuple[str, ...] | None = None, weight: str | None = None
) -> DataFrame:
    """Rows per (key, value); with ``keys`` only of listed keys, cut before they are counted."""
    entries = json_map(tags)
    if keys is not None:
        entries = F.map_filter(entries, lambda k, _: is_listed(k, keys))
    kept = [weight] if weight else []
    pairs = df.where(F.col(tags).isNotNull()).select(*kept, F.explode(entries).alias("key", "value"))
    return value_counts(pairs, "key", "value", weight=weight)


def key_frequencies(key_counts: DataFrame, total) -> DataFrame:
    """Share of all rows that carry each publishable key, at most 1."""
    return key_counts.where(~is_identifier_key("key")).select(
        "key", F.least(F.lit(1.0), F.col("n") / total).alias("share")
    )


def value_shares(value_counts: DataFrame, min_size: int) -> DataFrame:
    """Value distribution of each allow-listed key.

    Rare and identifier-shaped values are folded; a key that still shows more than 40
    values is left out. The counts are settled first: a filter on keys would else be tried
    on every row before it is counted.
    """
    allowed = settle(value_counts).where(
        ~is_identifier_key("key") & is_listed("key", words.VALUE_TAG_KEYS)
    )
    folded = fold_other(allowed, "value", min_size, ["key"], also=is_identifier_value("value"))
    few = (
        folded.groupBy("key")
        .agg(F.count_if(F.col("value") != words.OTHER).alias("labels"))
        .where(F.col("labels") <= words.MAX_TAG_VALUES)
        .select("key")
    )
    return shares(folded.join(few, "key", "left_semi"), ["key"])


def value_cardinality(value_counts: DataFrame, min_size: int) -> DataFrame:
    """Distinct values above the floor per publishable key; 0 where none reaches it."""
    clean = value_counts.where(~is_identifier_key("key"))
    reaches = F.col("n") >= check_floor(min_size)
    # (key, value) is unique here, so counting rows with a value counts distinct values;
    # NULL counts as one value of its own.
    return clean.groupBy("key").agg(F.count_if(reaches).alias("cardinality"))


def tag_coverage(
    df: DataFrame, type_col: str = "type", tags: str = "tags", weight: str | None = None
) -> DataFrame:
    """Rows and rows with a non-empty tag object, per type."""
    tagged = F.coalesce(F.size(F.map_keys(json_map(tags))) > 0, F.lit(False))
    return df.groupBy(F.col(type_col).alias("type")).agg(
        rows_of(weight).alias("total"),
        (F.count_if(tagged) if weight is None else F.sum(F.when(tagged, F.col(weight)).otherwise(0))).alias("tagged"),
    )


def untagged_rates(coverage: DataFrame) -> DataFrame:
    rate = (F.col("total") - F.col("tagged")) / F.col("total")
    return (
        coverage.where(F.col("total") > 0)
        .select(
            canonical_namespace("type").alias("type"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate)).alias("rate"),
        )
        .groupBy("type")
        .agg(F.max("rate").alias("rate"))
    )


def owner_features(
    df: DataFrame, owner: str = "subscription_id", group: str = "resource_group", tags: str = "tags",
    weight: str | None = None,
) -> DataFrame:
    """Rows, distinct groups and mean number of tag keys per owner.

    Rows are first summed per (owner, group), so a hot owner reaches the second step as
    one row per group.
    """
    keys = F.greatest(F.coalesce(F.size(F.map_keys(json_map(tags))), F.lit(0)), F.lit(0))
    per_group = df.groupBy(owner, group).agg(
        rows_of(weight).alias("rows"), F.sum(keys if weight is None else keys * F.col(weight)).alias("keys")
    )
    return per_group.groupBy(owner).agg(
        F.sum("rows").alias("resource_count"),
        F.count(group).alias("rg_count"),
        (F.sum("keys") / F.sum("rows")).alias("tag_density"),
    )
