"""Substring search through an inverted index of trigrams.

The index is two paged tables: rows with a number, and posting blocks (gram, numbers). A term's
rarest gram picks the candidates, whose whole texts are then compared. Terms of one or two
characters have no gram and scan the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.sources import paged
from .predicates import holds_term, normalise_term

GRAM = 3
BLOCK = 4096  # rows whose numbers one posting block may hold


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none for a text that is null or shorter."""
    lower = F.lower(text)
    places = F.sequence(F.lit(1), F.length(lower) - (GRAM - 1))
    each = F.transform(places, lambda i: F.substring(lower, i, F.lit(GRAM)))
    return F.when(F.length(lower) >= GRAM, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def write_index(df: DataFrame, path: str, columns: list[str], order: str) -> None:
    """Index the texts of ``columns``; rows are numbered and stored in the order of ``order``.

    A block holds the numbers of one gram within BLOCK consecutive rows, so a gram that
    every row has is many blocks, built by as many tasks. ``__row`` and ``__range`` must be
    no columns of ``df``.
    """
    spark = df.sparkSession
    n = min(paged.MOST_RANGES, max(1, -(-df.count() // paged.ROWS_A_RANGE)))
    numbered = df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__row", F.monotonically_increasing_id())
    numbered = numbered.withColumn("__range", range_of(F.col("__row")))
    numbered.write.partitionBy("__range").parquet(f"{path}/rows/rows")
    numbered.limit(0).write.parquet(f"{path}/rows/schema")
    rows = paged.all_ranges(spark, f"{path}/rows")
    found = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(F.col(c)), F.array().cast("array<string>")) for c in columns])))
    pairs = rows.select("__row", F.explode(found).alias("gram"))
    blocks = pairs.groupBy("gram", F.floor(F.col("__row") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("__row")).alias("rows"))
    paged.write_paged(blocks.select("gram", "rows", F.size("rows").alias("n")), f"{path}/postings", "gram")


def range_of(row: Column) -> Column:
    """The range that a row's number names."""
    return F.shiftright(row, 33).cast("int")


def _holding(spark: SparkSession, path: str, values: Column) -> list[int]:
    """The ranges of a paged table whose keys may be among ``values`` (an array)."""
    index = paged.range_index(spark, path)
    inside = F.exists(values, lambda v: (v >= F.col("first")) & (v <= F.col("last")))
    return [r[0] for r in index.where(inside).select("__range").collect()]


def candidates(spark: SparkSession, path: str, term: str) -> DataFrame | None:
    """The numbers (`__row`) of rows that hold the term's rarest gram; None for a term without grams."""
    wanted = spark.range(1).select(grams(F.lit(term)).alias("g")).first()["g"]  # one for each character at most
    if not wanted:
        return None
    blocks = paged.in_ranges(spark, f"{path}/postings", _holding(spark, f"{path}/postings", F.array(*map(F.lit, wanted))))
    counts = {r["gram"]: r["n"] for r in blocks.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    rarest = min(wanted, key=lambda g: (counts.get(g, 0), g))  # a gram without postings has no row
    held = paged.in_ranges(spark, f"{path}/postings", _holding(spark, f"{path}/postings", F.array(F.lit(rarest))))
    return held.where(F.col("gram") == rarest).select(F.explode("rows").alias("__row"))


def search(spark: SparkSession, path: str, term: str, columns: list[str]) -> DataFrame:
    """The indexed rows of which one of ``columns`` holds the term, without case; ``%`` and ``_`` mean themselves.

    Only ranges of rows that a candidate lies in are opened.
    """
    term = normalise_term(term)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(holds_term(c, term), F.lit(False))
    numbers = candidates(spark, path, term.lower())
    if numbers is None:
        return paged.all_ranges(spark, f"{path}/rows").where(hit).drop("__row", "__range")
    parts = numbers.select(range_of(F.col("__row"))).distinct().collect()  # MOST_RANGES at most
    rows = paged.in_ranges(spark, f"{path}/rows", [r[0] for r in parts])
    return rows.join(numbers, "__row", "left_semi").where(hit).drop("__row")
