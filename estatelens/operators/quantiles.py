"""Exact order statistics without gathering a group in one task.

Equal values are merged first. Groups and values are then cut into even ranges and
settled; cumulative range counts show which range holds each wanted rank, and only
those ranges are looked at value by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.session import settle


def counted_values(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Settled counts ``__k`` of each group's values ``__v``, with the number ``__b`` of their range.

    Ranges rise with the value and hold about as many distinct values each, however close
    to one another the values are; a group may fill any number of them.
    """
    counted = df.groupBy(*groups, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    return settle(counted.repartitionByRange(*groups, "__v").withColumn("__b", F.spark_partition_id()))


def order_statistics(counts: DataFrame, groups: list[str], ranks: dict[str, Column]) -> DataFrame:
    """One row per group of `counted_values` with its row count ``n`` and the value at each wanted rank.

    Each rank is a 1-based expression over the column ``n``. Nulls do not count.
    """
    counted = counts.where(F.col("__v").isNotNull())
    coarse = counted.groupBy(*groups, "__b").agg(F.sum("__k").alias("__bk"))
    upto = Window.partitionBy(*groups).orderBy("__b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(*groups)
    coarse = coarse.withColumn("__hi", F.sum("__bk").over(upto)).withColumn(
        "n", F.sum("__bk").over(whole)
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), rank).cast("long").alias("rank"))
            for name, rank in ranks.items()
        ]
    )
    low = F.col("__hi") - F.col("__bk")
    targets = coarse.select(
        *groups,
        "__b",
        "n",
        low.alias("__low"),
        F.filter(
            wanted, lambda w: (w["rank"] > low) & (w["rank"] <= F.col("__hi"))
        ).alias("__wanted"),
    ).where(F.size("__wanted") > 0)
    # One struct key, which compares NULLs as equal, serves the join and the window.
    key = F.struct(*groups, "__b").alias("__spot")
    fine = counted.select("*", key).join(targets.select(key, "n", "__low", "__wanted"), "__spot")
    climbing = Window.partitionBy("__spot").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    fine = fine.withColumn("__cum", F.col("__low") + F.sum("__k").over(climbing))
    hits = fine.select(*groups, "n", "__v", "__cum", F.explode("__wanted").alias("__w")).where(
        F.col("__cum") >= F.col("__w.rank")
    )
    return hits.groupBy(*groups).agg(
        F.max("n").alias("n"),
        *[F.min(F.when(F.col("__w.name") == name, F.col("__v"))).alias(name) for name in ranks],
    )


def nearest_rank_of(counts: DataFrame, groups: list[str], ps: dict[str, float]) -> DataFrame:
    """Percentiles that are values of the data: rank ceil(p * n)."""
    return order_statistics(counts, groups, {name: F.ceil(F.lit(p) * F.col("n")) for name, p in ps.items()})


def nearest_rank(df: DataFrame, groups: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    return nearest_rank_of(counted_values(df, groups, value), groups, ps)


def interpolated(df: DataFrame, groups: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    return interpolated_of(counted_values(df, groups, value), groups, ps)


def interpolated_of(counts: DataFrame, groups: list[str], ps: dict[str, float]) -> DataFrame:
    """Inclusive percentiles, linear between the two neighbouring ranks."""
    ranks: dict[str, Column] = {}
    for name, p in ps.items():
        position = F.lit(p) * (F.col("n") - 1)
        ranks[f"__lo_{name}"] = F.floor(position) + 1
        ranks[f"__hi_{name}"] = F.ceil(position) + 1
    found = order_statistics(counts, groups, ranks)
    between = []
    for name, p in ps.items():
        position = F.lit(p) * (F.col("n") - 1)
        share = position - F.floor(position)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        between.append((lo + (hi - lo) * share).alias(name))
    return found.select(*groups, "n", *between)


def distribution(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Mean, population standard deviation, min and max; zeros where there are no values."""
    def stat(c: Column) -> Column:
        return F.coalesce(c.cast("double"), F.lit(0.0))

    stats = [
        stat(F.avg(value)).alias("mean"), stat(F.stddev_pop(value)).alias("std"),
        stat(F.min(value)).alias("min"), stat(F.max(value)).alias("max"),
    ]
    return df.groupBy(*groups).agg(*stats) if groups else df.agg(*stats)
