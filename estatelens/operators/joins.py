"""Join helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scalar(df: DataFrame) -> Column:
    """The single value of a one-row, one-column frame, as a subquery."""
    return df.scalar()


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the left keys are kept."""
    marked = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(marked[f"__{k}"]) for k in keys]
    )
    return left.join(marked, same, how).drop(*[f"__{k}" for k in keys])


def with_group_total(df: DataFrame, value: str, total: str, by: list[str]) -> DataFrame:
    """Add the sum of ``value`` per group of a counted frame.

    The frame holds one row per label, so a group is as long as its vocabulary however
    many rows stand behind it. Without groups the total comes from a subquery, so the
    frame is not gathered in one task.
    """
    if not by:
        return df.withColumn(total, scalar(df.agg(F.sum(value))))
    return df.withColumn(total, F.sum(value).over(Window.partitionBy(*by)))


def join_salted(
    left: DataFrame, right: DataFrame, on: str, salt_by: list[str], salts: int = 16
) -> DataFrame:
    """Inner join on ``on`` that spreads each key of ``left`` over ``salts`` tasks.

    ``right`` is repeated once per salt, so it should be the smaller side; a key that
    holds a third of ``left`` is then shared by ``salts`` tasks. The sides are merged: the
    planner does not count the repeats and would send a side of any size through the driver.
    """
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [on, "__salt"]).drop("__salt")


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row frame beside every row."""
    only = one_row.limit(1).withColumn("__one", F.lit(1))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(only), "__one").drop("__one")
