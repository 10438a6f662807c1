"""What resource groups are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.catalogues import words
from estatelens.functions.text import canonical_namespace, is_identifier_key
from estatelens.session import settle
from .histogram import check_floor, rows_of, shares
from .joins import scalar
from .ranking import split_top


def group_type_sets(
    resources: DataFrame,
    groups: DataFrame | None = None,
    owner: str = "subscription_id",
    group: str = "resource_group",
    type_col: str = "type",
    weight: str | None = None,
) -> DataFrame:
    """Sorted distinct types and row count of each group, true empties included.

    Group names match without case inside one owner. Rows are counted per (group, type)
    first, so a hot group shrinks to one row per type before its set is built.
    """
    per_type = resources.groupBy(
        F.col(owner).alias("owner"),
        F.lower(F.col(group)).alias("group_key"),
        F.col(type_col).alias("type"),
    ).agg(rows_of(weight).alias("rows"), F.min(group).alias("name"))
    found = per_type.groupBy("owner", "group_key").agg(
        F.sort_array(F.collect_list("type")).alias("type_set"),
        F.sum("rows").alias("resource_count"),
        F.min("name").alias("name"),
    )
    if groups is None:
        return found.select("owner", F.col("name").alias("resource_group"), "type_set", "resource_count")
    declared = groups.groupBy(
        F.col("subscription_id").alias("owner"), F.lower(F.col("name")).alias("group_key")
    ).agg(F.min("name").alias("declared_name"))
    return declared.join(found, ["owner", "group_key"], "full").select(
        "owner",
        F.coalesce("name", "declared_name").alias("resource_group"),
        F.coalesce("type_set", F.array().cast("array<string>")).alias("type_set"),
        F.coalesce("resource_count", F.lit(0)).alias("resource_count"),
    )


def _compositions(sets: DataFrame) -> DataFrame:
    """One row per distinct composition with the moments of its groups' row counts."""
    types = F.coalesce(F.col("type_set"), F.array().cast("array<string>"))
    comp = F.array_sort(F.array_distinct(F.transform(types, canonical_namespace)))
    rows = F.col("resource_count").cast("double")
    return (
        sets.groupBy(comp.alias("comp"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(rows).alias("mean"),
            F.stddev_pop(rows).alias("std"),
            F.min(rows).alias("min"),
            F.max(rows).alias("max"),
            F.sum(rows).alias("rows"),
            F.count_if(rows <= 0).alias("empties"),
            F.avg(F.when(rows > 0, rows)).alias("mean_used"),
            F.stddev_pop(F.when(rows > 0, rows)).alias("std_used"),
            F.min(F.when(rows > 0, rows)).alias("min_used"),
        )
    )


def _pooled(prefix_n: str, mean: str, std: str) -> tuple:
    """Mean and population deviation of several groups from their own moments."""
    n, m, s = F.col(prefix_n), F.col(mean), F.col(std)
    total = F.sum(n)
    pooled_mean = F.sum(n * m) / total
    second = F.sum(n * (s * s + m * m)) / total
    return pooled_mean, F.sqrt(F.greatest(second - pooled_mean * pooled_mean, F.lit(0.0)))


def templates(
    sets: DataFrame, min_size: int, top: int = words.TOP_TEMPLATES
) -> tuple[DataFrame, DataFrame]:
    """Frequent compositions, the folded rest, and the type mass of the rest.

    Compositions are ordered by (-groups, composition); the first ``top`` that hold a
    type and reach the floor stand alone, everything else goes into one folded template.
    """
    check_floor(min_size)
    # One row per distinct composition, read four times below.
    comps = settle(_compositions(sets))
    total = scalar(comps.agg(F.sum("n")))
    leading, behind = split_top(comps, top, [F.desc("n"), F.asc("comp")], "comp")
    stands = (F.col("n") >= min_size) & (F.size("comp") > 0)
    # At most ``top`` rows from here on, so numbering them is bounded.
    numbered = leading.where(stands)
    position = F.row_number().over(Window.orderBy("rank")) - 1
    alone = numbered.select(
        F.concat(F.lit("template-"), position.cast("string")).alias("id"),
        (F.col("n") / total).alias("weight"),
        F.col("comp").alias("type_set"),
        "mean", "std", "min", "max",
        F.lit(None).cast("double").alias("empty_share"),
    )
    rest = leading.where(~stands).drop("rank").unionByName(behind)
    used = rest.withColumn("n_used", F.col("n") - F.col("empties"))
    mean_all, std_all = _pooled("n", "mean", "std")
    mean_used, std_used = _pooled("n_used", "mean_used", "std_used")
    any_used = F.sum("n_used") > 0
    folded = (
        used.agg(
            F.sum("n").alias("n"),
            F.sum("empties").alias("empties"),
            F.when(any_used, mean_used).otherwise(mean_all).alias("mean"),
            F.when(any_used, std_used).otherwise(std_all).alias("std"),
            F.when(any_used, F.min("min_used")).otherwise(F.min("min")).alias("min"),
            F.max("max").alias("max"),
        )
        .where(F.col("n") > 0)
        .select(
            F.lit(words.MISC).alias("id"),
            (F.col("n") / total).alias("weight"),
            F.array(F.lit(words.MISC)).alias("type_set"),
            "mean", "std", "min", "max",
            (F.col("empties") / F.col("n")).alias("empty_share"),
        )
    )
    mass = (
        rest.where(F.size("comp") > 0)
        .select((F.col("rows") / F.size("comp")).alias("n"), F.explode("comp").alias("type"))
        .where(~is_identifier_key("type"))
        .groupBy("type")
        .agg(F.sum("n").alias("n"))
    )
    return alone.unionByName(folded), shares(mass)

