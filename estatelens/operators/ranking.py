"""Top-n, ranks and exact samples that never sort a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.functions.keyed import key_hash
from estatelens.session import settle
from .joins import join_same

LEAST_BUCKET_BITS = 12
BUCKET_ROWS = 10_000  # of a group that one window sorts, about
RANGE_SHIFT = 33  # monotonically_increasing_id holds the partition above these bits


def top_n(df: DataFrame, n: int, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of a total order, numbered from 1.

    Sorting and cutting is a per-partition top-n; only ``n`` rows reach the window.
    """
    first = df.orderBy(*order).limit(n)
    return first.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def split_top(df: DataFrame, n: int, order: list[Column], key: str) -> tuple[DataFrame, DataFrame]:
    """The top rows and the remainder, for folding. ``key`` identifies a row."""
    top = top_n(df, n, order)
    rest = df.join(top.select(key), key, "left_anti")
    return top, rest


def _with_offsets(df: DataFrame, groups: list[str], bucket: str) -> DataFrame:
    """Add to each row how many rows of its group lie in earlier buckets.

    Group and bucket are one struct key, which compares NULLs as equal; joining and
    ranking on the same key need one shuffle between them.
    """
    keyed = df.withColumn("__place", F.struct(*groups, bucket))
    sizes = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("__size"))
    below = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    offsets = sizes.select(
        F.struct(*groups, bucket).alias("__place"),
        (F.sum("__size").over(below) - F.col("__size")).alias("__offset"),
    )
    return keyed.join(offsets, "__place")


def rank_in_buckets(
    df: DataFrame, groups: list[str], bucket: str, order: list[Column], rank: str = "rank"
) -> DataFrame:
    """Exact 1-based rank within each group, where ``bucket`` rises with ``order``.

    Bucket sizes are counted first and turned into offsets, so the window sorts one
    bucket at a time: a hot group is shared by as many tasks as it has buckets.
    """
    within = Window.partitionBy("__place").orderBy(*order)
    return (
        _with_offsets(df, groups, bucket)
        .withColumn(rank, F.col("__offset") + F.row_number().over(within))
        .drop("__offset", "__place")
    )


def rank_in_ranges(df: DataFrame, groups: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """Exact 1-based rank within each group by any columns, ``order`` telling all rows apart.

    The rows are cut into even ranges of (groups, order), sorted there and settled with
    their place: the range in the high bits, the place in it in the low ones. So they move
    once, and one group may fill any number of ranges. Only the ranges' sizes meet again.
    """
    cut = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    placed = settle(cut.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__place", F.struct(*groups, F.shiftright("__at", RANGE_SHIFT).alias("__range")))
    below = Window.partitionBy(*[f"__place.{g}" for g in groups]).orderBy("__place.__range").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    sizes = placed.groupBy("__place").agg(F.count(F.lit(1)).alias("__size"), F.min("__at").alias("__first"))
    offsets = sizes.select(
        "__place", (F.sum("__size").over(below) - F.col("__size") - F.col("__first") + 1).alias("__offset"))
    # Without groups there is one row for each range, as many as shuffle partitions.
    ranked = placed.join(offsets if groups else F.broadcast(offsets), "__place")
    return ranked.withColumn(rank, F.col("__at") + F.col("__offset")).drop("__at", "__offset", "__place")


def keyed_rank(
    df: DataFrame,
    groups: list[str],
    key: list[str],
    seed: int,
    purpose: str,
    rank: str = "rank",
    at_most: Column | None = None,
) -> DataFrame:
    """Rank rows of each group in a seeded pseudo-random order of their keys.

    With ``at_most`` only rows of rank <= ``at_most`` are returned; whole buckets beyond
    it are dropped before any row is sorted. The buckets are cut so fine that even a group
    with all rows leaves about BUCKET_ROWS to each.
    """
    h = key_hash(seed, purpose, *groups, *key)
    n = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    bits = F.greatest(F.lit(LEAST_BUCKET_BITS), F.ceil(F.log2(n / BUCKET_ROWS))).cast("int")
    hashed = df.withColumn("__order", F.shiftrightunsigned(h, 1)).withColumn(
        "__bucket", F.call_function("shiftrightunsigned", h, F.lit(64) - bits)
    )
    placed = _with_offsets(hashed, groups, "__bucket")
    if at_most is not None:
        placed = placed.where(F.col("__offset") < at_most)
    within = Window.partitionBy("__place").orderBy("__order", *key)
    ranked = placed.withColumn(rank, F.col("__offset") + F.row_number().over(within))
    if at_most is not None:
        ranked = ranked.where(F.col(rank) <= at_most)
    return ranked.drop("__order", "__bucket", "__offset", "__place")


def sample_exactly(
    df: DataFrame, quotas: DataFrame, groups: list[str], key: list[str], seed: int,
    purpose: str = "sample",
) -> DataFrame:
    """Exactly ``quota`` rows of each group, chosen by seed and key alone.

    ``quotas`` has one row per group with a ``quota`` column. Where the groups are few,
    hand it over marked for broadcast, so that no row moves to meet its quota.
    """
    wanted = join_same(df, quotas.select(*groups, "quota"), groups)
    return keyed_rank(wanted, groups, key, seed, purpose, "rank", F.col("quota")).drop(
        "rank", "quota"
    )


def planned_count(intensity: float, eligible: Column) -> tuple[Column, Column]:
    """Rows to change and the count asked for: a share up to 1, an absolute number above."""
    if 0.0 <= intensity <= 1.0:
        target = F.bround(F.lit(float(intensity)) * eligible).cast("long")
    else:
        target = F.lit(int(intensity)).cast("long")
    return F.least(target, eligible), target
