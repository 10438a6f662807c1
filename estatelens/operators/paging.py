"""Keyset pages and bounded previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: must equal the reference's for right results ---------------------
DEFAULT_TOP = 100
MAX_TOP = 1000
PREVIEW_OWNERS = 500
PREVIEW_MATCHES = 50


def clamp_top(top: int | None) -> int:
    return DEFAULT_TOP if top is None else max(1, min(MAX_TOP, int(top)))


def page(df: DataFrame, key: str, after=None, top: int | None = None) -> DataFrame:
    """The next ``top`` rows behind ``after`` in key order, with the cursor to go on from.

    One row more than the page is read to learn whether there is a next page; the cursor
    is the last kept key and NULL on the last page.
    """
    size = clamp_top(top)
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    ahead = rows.orderBy(key).limit(size + 1)
    # size + 1 rows at most, so the one-partition window is bounded.
    whole = Window.partitionBy()
    numbered = ahead.withColumn(
        "__i", F.row_number().over(Window.orderBy(key))
    ).withColumn("__seen", F.count(F.lit(1)).over(whole))
    kept = numbered.where(F.col("__i") <= size)
    cursor = F.when(F.col("__seen") > size, F.max(key).over(whole))
    return kept.withColumn("next_after", cursor).drop("__i", "__seen").orderBy(key)


def preview(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows of a total order."""
    return df.orderBy(*order).limit(limit)


def page_with_total(df: DataFrame, condition: Column, key: str, after=None, top=None) -> DataFrame:
    """A page of the matching rows, each with the number of all matching rows."""
    matching = df.where(condition)
    total = matching.agg(F.count(F.lit(1))).scalar()
    return page(matching, key, after, top).withColumn("total", total)
