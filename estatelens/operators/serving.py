"""Roll-ups and summaries of an estate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dimensions import with_spelling
from .histogram import value_counts
from .paging import PREVIEW_OWNERS, preview
from .ranking import top_n


def cost_facts(
    costs: DataFrame, resources: DataFrame, first, last, owner: str | None = None
) -> DataFrame:
    """Cost rows of a period (both ends included) with their resource's columns."""
    rows = costs.where(F.col("billing_period").between(F.lit(first), F.lit(last)))
    if owner is not None:
        rows = rows.where(F.col("subscription_id") == owner)
    return rows.join(resources, "resource_id")


def violations_with_owner(violations: DataFrame, resources: DataFrame) -> DataFrame:
    """Every violation with its resource's owner; NULL where the resource is gone."""
    return violations.join(
        resources.select(F.col("id").alias("resource_id"), "subscription_id"), "resource_id", "left"
    )


def owner_rollup(
    owners: DataFrame, metrics: dict[str, DataFrame], key: str = "subscription_id"
) -> DataFrame:
    """One count column per metric and owner, 0 where there is none.

    Each metric frame carries the owner key; it is aggregated on its own before it is
    joined, so metrics never multiply each other.
    """
    rows = owners
    for name, facts in metrics.items():
        rows = rows.join(facts.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return rows.na.fill(0, list(metrics))


def owner_preview(rollup: DataFrame, by: str, key: str = "subscription_id") -> DataFrame:
    return preview(rollup, [F.desc(by), F.asc(key)], PREVIEW_OWNERS)


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) for each table; an empty table counts 0."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def leading_values(df: DataFrame, col: str, limit: int = PREVIEW_OWNERS) -> DataFrame:
    """Counts per value, most frequent first, ties by value."""
    return top_n(value_counts(df, col), limit, [F.desc("n"), F.asc(col)])


def summary(
    tables: dict[str, DataFrame], visible_resources: DataFrame, owner_metrics: dict[str, DataFrame]
) -> DataFrame:
    """Long summary (section, rank, key, n): totals, leading types, locations and owners."""
    counted = totals(tables).select(
        F.lit("totals").alias("section"), F.lit(0).alias("rank"), F.col("table").alias("key"), "n"
    )
    by_type = with_spelling(leading_values(visible_resources, "type"), "type", "key").select(
        F.lit("by_type").alias("section"), "rank", "key", "n"
    )
    by_location = leading_values(visible_resources, "location").select(
        F.lit("by_location").alias("section"), "rank", F.col("location").alias("key"), "n"
    )
    rollup = owner_rollup(tables["subscriptions"].select("subscription_id"), owner_metrics)
    leading = next(iter(owner_metrics))
    owners = top_n(rollup, PREVIEW_OWNERS, [F.desc(leading), F.asc("subscription_id")])
    per_owner = owners.select(
        "rank",
        F.col("subscription_id").cast("string").alias("key"),
        F.inline(F.array(*[
            F.struct(F.lit(f"owner_{m}").alias("section"), F.col(m).alias("n"))
            for m in owner_metrics
        ])),
    ).select("section", "rank", "key", "n")
    return counted.unionByName(by_type).unionByName(by_location).unionByName(per_owner)


def estate_metadata(tenant: DataFrame) -> DataFrame:
    """One row of tenant id, profile name and seed, NULL for an empty estate."""
    seed = F.get_json_object("scale_params", "$.seed").cast("bigint")
    return tenant.limit(1).agg(
        F.max("tenant_id").alias("tenant_id"),
        F.max("profile_name").alias("profile_name"),
        F.max(seed).alias("seed"),
    )


def busiest(df: DataFrame, key: str, inner: str) -> DataFrame:
    """The key with most rows, and the value of ``inner`` most frequent within it."""
    top_key = value_counts(df, key).orderBy(F.desc("n"), F.asc(key)).limit(1)
    within = df.join(
        F.broadcast(top_key.select(key, F.col("n").alias("key_rows"))), key
    )
    return (
        within.groupBy(key, "key_rows", inner)
        .agg(F.count(F.lit(1)).alias("inner_rows"))
        .orderBy(F.desc("inner_rows"), F.asc(inner))
        .limit(1)
    )


def compare_counts(actual: DataFrame, expected: DataFrame, floors: dict[str, int] | None = None) -> DataFrame:
    """Counts per table beside the expected ones, with a verdict.

    Both frames are (table, n). Tables with a floor pass when they reach it.
    """
    both = actual.join(expected.withColumnRenamed("n", "expected"), "table", "full")
    ok = F.coalesce(F.col("n") == F.col("expected"), F.lit(False))
    for table, floor in (floors or {}).items():
        ok = F.when(F.col("table") == table, F.coalesce(F.col("n") >= floor, F.lit(False))).otherwise(ok)
    return both.withColumn("ok", ok)
