"""Bloom filters as arrays of 64-bit words, built by one aggregate and tested by built-in functions.

A filter has 16 bits or more for a value and 3 positions each, so a foreign value passes with
a probability of at most (1 - exp(-3/16))^3 = 0.5 %. It never has more than 2^24 bits (2 MB),
whatever it holds: beyond 2^20 values foreign ones pass more often, by the same formula with
3 * values / bits in place of 3/16. A value that was put in always passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_VALUE = 16
PLACES = 3
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 24


def bits_for(values: int) -> int:
    """A power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, values * BITS_A_VALUE - 1).bit_length()))


def _places(value: Column, bits: int) -> list[Column]:
    h = F.xxhash64(value)
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [(h.bitwiseAND(F.lit(bits - 1)) + step * i).bitwiseAND(F.lit(bits - 1)) for i in range(PLACES)]


def build(values: DataFrame, column: str, bits: int) -> Column:
    """The filter's words, as a subquery. Words are merged before they move; one task takes at most 2^18 of them."""
    at = values.where(F.col(column).isNotNull()).select(F.explode(F.array(*_places(F.col(column), bits))).alias("at"))
    held = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    every = values.sparkSession.range(0, bits // 64, 1, 1).select(F.col("id").alias("word"))
    dense = every.join(held, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    return dense.agg(F.sort_array(F.collect_list("w"))["bits"]).scalar()


def might_hold(value: Column, words: Column, bits: int) -> Column:
    """False only for values that were not put in."""
    return reduce(
        lambda a, b: a & b,
        [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in _places(value, bits)])
