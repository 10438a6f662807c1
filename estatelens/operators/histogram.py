"""The histogram kernel: count, floor, fold, share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.catalogues import words
from estatelens.functions.jsonmaps import json_map
from estatelens.functions.text import canonical_namespace
from .joins import with_group_total


class PrivacyFloorError(ValueError):
    """The minimum bucket size is too small, or no integer."""


def check_floor(min_size: int) -> int:
    if type(min_size) is not int:
        raise PrivacyFloorError(f"the minimum bucket size must be an integer, not {min_size!r}")
    if min_size < words.MIN_BUCKET:
        raise PrivacyFloorError(
            f"a minimum bucket size of {min_size} is below the floor of {words.MIN_BUCKET}"
        )
    return min_size


def rows_of(weight: str | None = None) -> Column:
    """How many rows a group holds; with ``weight``, of a frame whose rows stand for that many."""
    return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))


def value_counts(df: DataFrame, *cols: str, weight: str | None = None) -> DataFrame:
    """Rows per value; NULL is a value."""
    return df.groupBy(*cols).agg(rows_of(weight).alias("n"))


def drop_small(df: DataFrame, min_size: int, count: str = "n") -> DataFrame:
    """Keep the buckets that reach the floor."""
    return df.where(F.col(count) >= check_floor(min_size))


def fold_other(
    df: DataFrame,
    label: str,
    min_size: int,
    by: list[str] | None = None,
    count: str = "n",
    also: Column | None = None,
    null_label: str = "None",
) -> DataFrame:
    """Sum the buckets below the floor (and those marked by ``also``) into one bucket.

    The total per ``by`` group is kept.
    """
    small = F.col(count) < check_floor(min_size)
    if also is not None:
        small = small | F.coalesce(also, F.lit(False))
    folded = F.when(small, words.OTHER).otherwise(
        F.coalesce(F.col(label).cast("string"), F.lit(null_label))
    )
    return (
        df.withColumn(label, folded).groupBy(*(by or []), label).agg(F.sum(count).alias(count))
    )


def shares(
    df: DataFrame, by: list[str] | None = None, count: str = "n", share: str = "share"
) -> DataFrame:
    """Each bucket as a share of its group's total."""
    totalled = with_group_total(df, count, "__total", by or [])
    return (
        totalled.where(F.col("__total") > 0)
        .withColumn(share, F.col(count) / F.col("__total"))
        .drop(count, "__total")
    )


def type_frequencies(type_counts: DataFrame, min_size: int) -> DataFrame:
    """Share of each canonical type among the types that reach the floor.

    Spellings that fall together under the canonical name overwrite each other, the
    rarer one last.
    """
    kept = shares(drop_small(type_counts, min_size))
    return (
        kept.withColumn("type", canonical_namespace("type"))
        .groupBy("type")
        .agg(F.min("share").alias("share"))
    )


def location_shares(counts: DataFrame, min_size: int, by: list[str] | None = None) -> DataFrame:
    return shares(fold_other(counts, "location", min_size, by), by)


def json_histogram(
    df: DataFrame, json_col: str, by: list[str] | None = None, fields: Column | None = None
) -> DataFrame:
    """Rows per (group, field, value) of a JSON object's top-level fields.

    One pass covers every group. ``fields`` may restrict which fields are exploded
    (a condition over ``field``), which keeps unwanted wide values out of the shuffle.
    """
    entries = df.where(F.col(json_col).isNotNull()).select(
        *(by or []), F.explode(json_map(json_col)).alias("field", "value")
    )
    if fields is not None:
        entries = entries.where(fields)
    return value_counts(entries, *(by or []), "field", "value")


def key_counts(df: DataFrame, json_col: str) -> DataFrame:
    """Rows that carry each key of a JSON object."""
    keys = df.where(F.col(json_col).isNotNull()).select(
        F.explode(F.map_keys(json_map(json_col))).alias("key")
    )
    return value_counts(keys, "key")


def pivot_counts(
    df: DataFrame, row: str, column: str, values: list, prefix: str = "loc__", weight: str | None = None
) -> DataFrame:
    """One count column per value, zeros where a pair does not occur, columns sorted.

    The value list is an argument, so no extra job looks for the values; the pairs are
    counted before the pivot, so a hot row value does not reach one task row by row.
    """
    pairs = value_counts(df, row, column, weight=weight)
    return pairs.groupBy(row).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(column) == v, F.col("n"))), F.lit(0)).alias(
                f"{prefix}{v}"
            )
            for v in sorted(values)
        ]
    )
