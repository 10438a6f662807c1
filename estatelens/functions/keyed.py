"""Randomness as a pure function of a seed and a row key.

Nothing here depends on partitioning, task order or retries: a lost executor
recomputes the same values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, col


HEX_DIGITS = 15  # of the digest, which are 60 bits


def key_hash(seed: int, purpose: str, *key: ColumnOrName) -> Column:
    """60 random bits at the top of a long: the first digits of an MD5 of the key as text.

    Any SQL engine has MD5, so a draw can be recomputed elsewhere.
    """
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[col(k).cast("string") for k in key])
    digits = F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS)
    return F.shiftleft(F.conv(digits, 16, 10).cast("long"), 64 - 4 * HEX_DIGITS)


def uniform(seed: int, purpose: str, *key: ColumnOrName) -> Column:
    """Uniform in [0, 1) with 53 random bits."""
    return F.shiftrightunsigned(key_hash(seed, purpose, *key), 11) / F.lit(float(2**53))


def bernoulli(p: ColumnOrName | float, seed: int, purpose: str, *key: ColumnOrName) -> Column:
    chance = F.lit(p) if isinstance(p, (int, float)) else col(p)
    chance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), chance))
    return uniform(seed, purpose, *key) < chance


def normal(seed: int, purpose: str, *key: ColumnOrName) -> Column:
    """Standard normal by the Box-Muller transform of two uniforms."""
    u = F.lit(1.0) - uniform(seed, purpose + "/radius", *key)
    v = uniform(seed, purpose + "/angle", *key)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def _rounded(x: Column, lo, hi) -> Column:
    n = F.bround(x)
    if lo is not None:
        n = F.greatest(F.lit(lo).cast("double") if not isinstance(lo, Column) else lo, n)
    if hi is not None:
        n = F.least(F.lit(hi).cast("double") if not isinstance(hi, Column) else hi, n)
    return F.greatest(F.lit(0.0), n).cast("long")


def normal_count(mean: Column, std: Column, z: Column, lo=None, hi=None) -> Column:
    """Rounded normal draw held inside [lo, hi] and never negative."""
    return _rounded(mean + F.greatest(std, F.lit(1e-9)) * z, lo, hi)


def lognormal_count(mean: Column, std: Column, z: Column, lo=None, hi=None) -> Column:
    """Rounded lognormal draw that keeps the given mean, held inside [lo, hi]."""
    m = F.greatest(mean, F.lit(1e-9))
    spread = F.greatest(std, F.lit(0.0))
    variance = F.log(F.lit(1.0) + spread * spread / (m * m))
    return _rounded(F.exp(F.log(m) - variance / 2 + F.sqrt(variance) * z), lo, hi)


def skewed_count(mean: Column, std: Column, z: Column, lo=None, hi=None) -> Column:
    """Normal draw, or lognormal where the spread exceeds the mean."""
    return F.when(std > mean, lognormal_count(mean, std, z, lo, hi)).otherwise(
        normal_count(mean, std, z, lo, hi)
    )


def pick(labels: Column, cumulative: Column, u: Column) -> Column:
    """The label whose cumulative share first exceeds ``u``."""
    position = F.size(F.filter(cumulative, lambda c: c <= u)) + 1
    return F.element_at(labels, F.least(position, F.size(labels)))


def pick_word(words, seed: int, purpose: str, *key: ColumnOrName) -> Column:
    """One entry of a fixed word list, each equally likely."""
    vocabulary = F.array(*[F.lit(w) for w in words])
    index = F.pmod(F.shiftrightunsigned(key_hash(seed, purpose, *key), 4), F.lit(len(words))).cast("int")
    return F.element_at(vocabulary, index + 1)


def pick_weighted(weights: dict[str, float], seed: int, purpose: str, *key: ColumnOrName) -> Column:
    """One label of a fixed weight table."""
    total = sum(weights.values())
    labels, cumulative, running = [], [], 0.0
    for label in sorted(weights):
        running += weights[label] / total
        labels.append(F.lit(label))
        cumulative.append(F.lit(running))
    return pick(F.array(*labels), F.array(*cumulative), uniform(seed, purpose, *key))


def keyed_uuid(seed: int, purpose: str, *key: ColumnOrName) -> Column:
    """A version-4 shaped id derived from the key."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[col(k).cast("string") for k in key]), 256)
    variant = F.element_at(
        F.array(F.lit("8"), F.lit("9"), F.lit("a"), F.lit("b")),
        (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1,
    )
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-4"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3),
        F.lit("-"), F.substring(digest, 21, 12),
    )


def keyed_letters(n: int, seed: int, purpose: str, *key: ColumnOrName) -> Column:
    """``n`` lower-case letters, at most eleven."""
    h = key_hash(seed, purpose, *key)
    letters = [
        F.char(F.pmod(F.shiftrightunsigned(h, 4 + 5 * i), F.lit(26)) + F.lit(97)) for i in range(n)
    ]
    return F.concat(*letters)
