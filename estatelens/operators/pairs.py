"""Which types share a group, which tag keys share a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.jsonmaps import json_map
from estatelens.functions.text import canonical_namespace, is_identifier_key
from estatelens.session import settle
from .histogram import check_floor, shares, value_counts


def _pairs_of(items: Column) -> Column:
    """The pairs a < b of a sorted array."""
    return F.flatten(
        F.transform(
            items,
            lambda a, i: F.transform(
                F.slice(items, i + 2, F.size(items)),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )


def pairs_in_sets(sets: DataFrame, items: str, weight: str = "n") -> DataFrame:
    """Weighted pair counts over distinct sorted sets."""
    return (
        sets.where(F.size(items) > 1)
        .select(weight, F.explode(_pairs_of(F.col(items))).alias("p"))
        .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .agg(F.sum(weight).alias("n"))
    )


def pair_counts(
    df: DataFrame, group_cols: list[str], item: str, min_size: int | None = None
) -> DataFrame:
    """In how many groups each unordered pair of items occurs.

    Rows shrink to distinct (group, item), groups to their item sets, and equal sets to
    one weighted set, so pairs are written once per distinct set and summed map-side.
    Under a floor, items that occur in fewer groups than the floor go first: no pair
    that holds one can reach it, so the result is the same and far less is written.
    """
    members = df.select(*group_cols, F.col(item).alias("item")).where(
        F.col("item").isNotNull()
    ).distinct()
    if min_size is not None:
        frequent = (
            members.groupBy("item")
            .agg(F.count(F.lit(1)).alias("groups"))
            .where(F.col("groups") >= check_floor(min_size))
            .select("item")
        )
        members = members.join(frequent, "item", "left_semi")
    sets = (
        members.groupBy(*group_cols)
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
        .where(F.size("items") > 1)
        .groupBy("items")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = pairs_in_sets(sets, "items")
    return counted if min_size is None else counted.where(F.col("n") >= min_size)


def key_pair_counts(
    df: DataFrame, json_col: str, min_size: int | None = None, weight: str | None = None
) -> DataFrame:
    """In how many rows each unordered pair of keys of a JSON object occurs.

    Rows shrink to counted key sets first. Under a floor, keys that fewer rows carry leave
    the sets before any pair is written, since no pair that holds one can reach it, and
    sets that are equal then are merged again; pairs below the floor are left out.
    """
    keys = F.sort_array(F.map_keys(json_map(json_col))).alias("items")
    kept = [weight] if weight else []
    sets = value_counts(df.where(F.col(json_col).isNotNull()).select(*kept, keys), "items", weight=weight)
    if min_size is None:
        return pairs_in_sets(sets, "items")
    sets = settle(sets.where(F.size("items") > 1))
    members = sets.select("items", "n", F.explode("items").alias("item"))
    frequent = members.groupBy("item").agg(F.sum("n").alias("rows")).where(F.col("rows") >= check_floor(min_size))
    cut = (
        members.join(frequent.select("item"), "item", "left_semi")
        .groupBy("items", "n")
        .agg(F.sort_array(F.collect_list("item")).alias("cut"))
        .groupBy("cut")
        .agg(F.sum("n").alias("n"))
    )
    return pairs_in_sets(cut, "cut").where(F.col("n") >= min_size)


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions, as shares of what goes with the first item."""
    ends = F.explode(
        F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("target")),
            F.struct(F.col("b").alias("source"), F.col("a").alias("target")),
        )
    )
    directed = (
        pairs.select("n", ends.alias("e"))
        .groupBy("e.source", "e.target")
        .agg(F.sum("n").alias("n"))
    )
    return shares(directed, ["source"])


def cooccurrence(pairs: DataFrame, min_size: int) -> DataFrame:
    """Share of each canonical type among those found beside a type."""
    kept = pairs.where(F.col("n") >= check_floor(min_size))
    return _both_ways(
        kept.withColumn("a", canonical_namespace("a")).withColumn("b", canonical_namespace("b"))
    )


def key_cooccurrence(pairs: DataFrame, min_size: int) -> DataFrame:
    """The same for tag keys, without identifier-shaped keys."""
    kept = pairs.where(F.col("n") >= check_floor(min_size))
    return _both_ways(kept.where(~is_identifier_key("a") & ~is_identifier_key("b")))
