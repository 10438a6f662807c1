"""Tables cut into ranges of a key, with an index of the ranges: a page opens the ranges it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.operators import paging

ROWS_A_RANGE = 50_000
MOST_RANGES = 20_000  # beyond that many, ranges grow


def write_paged(df: DataFrame, path: str, key: str, rows_a_range: int = ROWS_A_RANGE) -> None:
    """Write ``df`` in ranges of ``key``, each sorted and in a folder of its own, and their index.

    The index holds each range's first and last key, its rows, and the rows ``before`` it.
    It is written last, so a table without one was not finished. Null keys come first; the
    first key of their range is null.
    Rows of one key share a range, however many they are. Any key that sorts will do, a
    struct of several columns too.
    """
    spark = df.sparkSession
    ranges = min(MOST_RANGES, max(1, -(-df.count() // rows_a_range)))
    cut = df.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("__range", F.spark_partition_id())
    cut.write.partitionBy("__range").parquet(f"{path}/rows")
    cut.limit(0).write.parquet(f"{path}/schema")
    found = all_ranges(spark, path).groupBy("__range").agg(
        F.when(F.count(key) == F.count(F.lit(1)), F.min(key)).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counted = found.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counted.coalesce(1).write.parquet(f"{path}/ranges")


def all_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Every row, with the number of its range in `__range`."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


def range_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/ranges")


def in_ranges(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """The rows of some ranges; no file of another range is opened."""
    return all_ranges(spark, path).where(F.col("__range").isin(numbers)).drop("__range")


def page_ranges(spark: SparkSession, path: str, after=None, top: int | None = None) -> list[int]:
    """The ranges that the page behind ``after`` can lie in: the first that reaches past it, and on until a page is sure."""
    index = range_index(spark, path)
    ahead = index if after is None else index.where(F.col("last") > F.lit(after))
    head = ahead.orderBy("__range").first()
    if head is None:
        return []
    enough = head["before"] + head["n"] + paging.clamp_top(top) + 1
    if after is None:
        enough -= head["n"]
    chosen = index.where((F.col("__range") >= head["__range"]) & (F.col("before") < enough)).select("__range")
    return sorted(r[0] for r in chosen.collect())  # a page's rows bound the ranges


def paged(spark: SparkSession, path: str, key: str, after=None, top: int | None = None) -> DataFrame:
    """`paging.page` of a written table, from the ranges that can hold it."""
    numbers = page_ranges(spark, path, after, top)
    return paging.page(in_ranges(spark, path, numbers), key, after, top)


def rows_behind(spark: SparkSession, path: str, key: str, after=None) -> int:
    """How many rows lie behind ``after``: counts of the index, and one range where the key falls inside it."""
    index = range_index(spark, path)
    if after is None:
        return index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole = index.where(F.col("first") > F.lit(after)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cut = index.where((F.col("last") > F.lit(after)) & ~F.coalesce(F.col("first") > F.lit(after), F.lit(False))).select("__range")
    part = in_ranges(spark, path, [r[0] for r in cut.collect()])  # the one range that the key falls into
    return whole + part.where(F.col(key) > F.lit(after)).count()


def first_matching(spark: SparkSession, path: str, key: str, condition: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows in key order that meet ``condition``.

    Ranges are read in order, twice as many each time, until enough rows are found; a
    condition that nothing meets reads all of them once.
    """
    numbers = sorted(r[0] for r in range_index(spark, path).select("__range").collect())
    at, step = 0, 1
    while True:
        found = in_ranges(spark, path, numbers[:at + step]).where(condition).orderBy(key).limit(limit)
        at, step = at + step, 2 * step
        if at >= len(numbers) or found.count() >= limit:
            return found
