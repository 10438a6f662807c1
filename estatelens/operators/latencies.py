"""Latency histograms that can be merged.

A slot holds the values between two bounds that lie ``2 ** (1 - bits)`` of the lower bound
apart at most, so a percentile read from slots is known within that share (below
``2 ** bits`` steps of the unit: within one step). Counts are exact, and histograms of parts add up to the
histogram of the whole, which sketches of percentiles read off early do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 7  # 1/64 of the value
STEPS = 1000  # of the unit; finer values share a slot


def slot(value: str, bits: int = BITS, steps: int = STEPS) -> Column:
    """The slot of a value, rising with it; NULL and NaN have none. Values below 0 mirror those above."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    n = F.floor(F.abs(v) * F.lit(float(steps))).cast("bigint")
    shift = F.greatest(F.length(F.bin(n)) - bits, F.lit(0))
    place = F.call_function("shiftleft", shift.cast("bigint"), F.lit(bits)) + F.call_function("shiftright", n, shift)
    return F.when(v < 0, -1 - place).otherwise(place)


def bounds(slot_: Column, bits: int = BITS, steps: int = STEPS) -> tuple[Column, Column]:
    """The least and the greatest value that a slot stands for (the one farther from 0 is left out)."""
    place = F.when(slot_ < 0, -1 - slot_).otherwise(slot_)
    shift = F.shiftright(place, bits).cast("int")
    part = place.bitwiseAND(F.lit((1 << bits) - 1))
    near = F.call_function("shiftleft", part, shift) / F.lit(float(steps))
    far = F.call_function("shiftleft", part + 1, shift) / F.lit(float(steps))
    return F.when(slot_ < 0, -far).otherwise(near), F.when(slot_ < 0, -near).otherwise(far)


def histogram(df: DataFrame, keys: list, value: str, bits: int = BITS, steps: int = STEPS) -> DataFrame:
    """(keys, slot, n, max): one row for each slot that is not empty. Works on streams too."""
    return df.groupBy(*keys, slot(value, bits, steps).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max"))


def merged(histograms: DataFrame, keys: list) -> DataFrame:
    """The histograms of coarser keys."""
    return histograms.groupBy(*keys, "slot").agg(F.sum("n").alias("n"), F.max("max").alias("max"))


def percentiles(histograms: DataFrame, keys: list[str], wanted: dict[str, float], bits: int = BITS, steps: int = STEPS) -> DataFrame:
    """Per key the exact count and maximum, and for each name in ``wanted`` its nearest-rank
    percentile's bounds, ``<name>_low`` and ``<name>_high``; NULL where no value is known.

    A key has at most 2 ** bits * 128 slots, whatever its rows, so its running count is short.
    """
    upto = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("slot").isNotNull(), F.col("n")).otherwise(0)
    rows = histograms.withColumn("__upto", F.sum(known).over(upto))
    rows = rows.withColumn("__known", F.sum(known).over(Window.partitionBy(*keys)))
    at = {
        name: F.min(F.when(F.col("slot").isNotNull() & (F.col("__upto") >= F.ceil(F.lit(p) * F.col("__known"))), F.col("slot"))).alias(f"__{name}")
        for name, p in wanted.items()
    }
    found = rows.groupBy(*keys).agg(F.sum("n").alias("count"), F.max("max").alias("max"), *at.values())
    ends = [
        end.alias(f"{name}_{side}")
        for name in wanted for side, end in zip(("low", "high"), bounds(F.col(f"__{name}"), bits, steps))
    ]
    return found.select(*keys, "count", "max", *ends)
