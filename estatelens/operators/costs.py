"""Cost samples, fitted distributions and the grouped cost query."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions.jsonmaps import json_map
from estatelens.functions.periods import timeframe_range
from estatelens.functions.text import canonical_namespace
from .dimensions import with_service
from .histogram import check_floor

# --- fixed values: must equal the reference's for right results ---------------------
MAX_GROUPINGS = 2
MAX_ROWS = 1000
MAX_KEY_BYTES = 65536
DIMENSIONS = {
    "ResourceType": "type",
    "ResourceGroup": "resource_group",
    "ResourceId": "resource_id",
    "SubscriptionId": "subscription_id",
    "ServiceName": "service",
    "MeterCategory": "service",
}


def cost_samples(
    costs: DataFrame, resources: DataFrame, amount: str = "amortized_cost_eur"
) -> DataFrame:
    """One amount per (row, month, type); only the type and the amount leave.

    Ids are compared without case. Each side moves once, by id, and is counted or summed
    there: meter rows to one row per (id, month), scan rows to one per (id, type). The long
    ids stay behind: two hashes of 64 bits under different seeds stand for one, which two of
    a billion ids share with a chance below 1e-20.
    """
    def by_id(df: DataFrame, *columns) -> DataFrame:
        keyed = df.where(F.col("resource_id").isNotNull()).withColumn("id_key", F.lower("resource_id"))
        hashes = F.xxhash64("id_key").alias("id_hash"), F.xxhash64(F.lit(1), F.col("id_key")).alias("id_hash2")
        return keyed.select(*hashes, *columns).repartition("id_hash", "id_hash2")

    # Spellings of one id are summed apart.
    spelling = F.col("resource_id")
    spelled = F.when(spelling == F.col("id_key"), 0).when(spelling == F.upper("id_key"), 1).otherwise(F.xxhash64(spelling))
    monthly = (
        by_id(costs, spelled.alias("spelled"), "billing_month", F.col(amount).alias("amount"))
        .groupBy("id_hash", "id_hash2", "spelled", "billing_month").agg(F.sum("amount").alias("amount"))
    )
    # An id may stand in several scan rows of one type; they count as one sample of the
    # summed amounts, as grouping after the join would give.
    weighted = by_id(resources, "type").groupBy("id_hash", "id_hash2", "type").agg(F.count(F.lit(1)).alias("rows"))
    return monthly.join(weighted, ["id_hash", "id_hash2"]).select(
        "type", (F.col("amount") * F.col("rows")).alias("monthly_cost")
    )


def lognormal_fit(samples: DataFrame, value: str, min_size: int, type_col: str = "type") -> DataFrame:
    """Closed-form lognormal fit per type with enough rows, and enough positive rows."""
    check_floor(min_size)
    positive = F.when(F.col(value) > 0, F.log(value))
    return (
        samples.where(F.col(type_col).isNotNull())
        .groupBy(canonical_namespace(type_col).alias("type"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(positive).alias("sample_count"),
            F.avg(positive).alias("mu"),
            F.stddev_pop(positive).alias("sigma"),
        )
        .where((F.col("rows") >= min_size) & (F.col("sample_count") >= min_size))
        .select("type", F.lit("lognormal").alias("distribution"), "mu", "sigma", "sample_count")
    )


def bounded_key(value: Column, max_bytes: int = MAX_KEY_BYTES) -> tuple[Column, Column]:
    """The value as a grouping key, and whether it was too long to be one.

    A value over the limit becomes a NULL key, so it is never hashed, sorted or moved.
    """
    text = value.cast("string")
    fits = F.octet_length(text) <= max_bytes
    return F.when(fits, text), F.coalesce(F.octet_length(text) > max_bytes, F.lit(False))


def fail_if(condition: Column, message: str, value: Column) -> Column:
    """``value``, or an error when the condition holds at run time."""
    return F.when(condition, F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def _grouping_column(kind: str, name: str) -> Column:
    if kind == "Tag":
        return F.element_at(json_map("tags"), F.lit(name))
    if kind == "Dimension" and name in DIMENSIONS:
        return F.col(DIMENSIONS[name])
    raise ValueError(f"unknown grouping {kind} {name!r}")


def cost_query(
    costs: DataFrame,
    resources: DataFrame,
    timeframe: str,
    today: dt.date,
    grouping: list[tuple[str, str]] | None = None,
    owner: str | None = None,
    group: str | None = None,
    custom: tuple[str, str] | None = None,
    max_rows: int | None = MAX_ROWS,
    max_key_bytes: int = MAX_KEY_BYTES,
) -> DataFrame:
    """Total cost of a period by up to two dimensions or tags.

    ``costs`` has resource_id, billing_period, cost_amount (and subscription_id for a
    scope); ``resources`` has resource_id, type and whatever the grouping reads. More
    rows than ``max_rows``, or a key beyond the size limit, fails the query; nothing is
    cut off. The row limit is that of one served answer; without it (None) the whole
    result is a table of any length. Amounts are summed per resource before the join.
    """
    grouping = grouping or []
    if len(grouping) > MAX_GROUPINGS:
        raise ValueError(f"at most {MAX_GROUPINGS} groupings, got {len(grouping)}")
    first, last = timeframe_range(timeframe, today, custom)
    columns = [_grouping_column(kind, name) for kind, name in grouping]
    billed = costs.where(F.col("billing_period").between(F.lit(first), F.lit(last)))
    if owner is not None:
        billed = billed.where(F.col("subscription_id") == owner)
    by_owner = any(name == "SubscriptionId" for _, name in grouping)
    keep = ["resource_id", "subscription_id"] if by_owner else ["resource_id"]
    per_resource = billed.groupBy(*keep).agg(F.sum("cost_amount").alias("amount"))
    if by_owner:
        resources = resources.drop("subscription_id")
    if group is not None:
        resources = resources.where(F.lower("resource_group") == group.lower())
    joined = per_resource.join(resources, "resource_id")
    if any(name in ("ServiceName", "MeterCategory") for kind, name in grouping if kind == "Dimension"):
        joined = with_service(joined, "type", "service")
    if not columns:
        return joined.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"))
    keys, too_long = zip(*[bounded_key(c, max_key_bytes) for c in columns])
    names = [name for _, name in grouping]
    grouped = (
        joined.groupBy(*[k.alias(f"key{i}") for i, k in enumerate(keys)])
        .agg(
            F.sum("amount").alias("total"),
            *[F.bool_or(over).alias(f"over{i}") for i, over in enumerate(too_long)],
        )
    )
    out = [fail_if(F.col(f"over{i}"), f"a {names[i]} key is too long", F.col(f"key{i}")) for i in range(len(keys))]
    if max_rows is not None:
        grouped = grouped.orderBy(*[F.asc_nulls_last(f"key{i}") for i in range(len(keys))]).limit(max_rows + 1)
        # At most max_rows + 1 rows are left, so the one-partition window is bounded.
        crowded = F.count(F.lit(1)).over(Window.partitionBy()) > max_rows
        out = [fail_if(crowded, f"the result has more than {max_rows} rows", c) for c in out]
    out = [c.alias(name) for c, name in zip(out, names)]
    return grouped.select(*out, "total").orderBy(*[F.asc_nulls_last(n) for n in names])
