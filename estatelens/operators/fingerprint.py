"""Content fingerprints that do not depend on row order or partitioning.

Every row is hashed on its own; the row hashes are summed piecewise. Sums combine
map-side, so only a handful of numbers per task is moved, where sorting all row hashes
would gather them in one place.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.jsonmaps import sorted_map_text

SEPARATOR = "\x1f"
ABSENT = "\x00"
PIECES = ((1, 15), (16, 15), (31, 15), (46, 15))
HALF = 30  # bits: a piece has 60, and sums of its halves stay whole longs over 2 ** 33 rows


def canonical(df: DataFrame, columns: list[str], cents: set[str] = frozenset(), marks: set[str] = frozenset()) -> Column:
    """One text per row from its columns in name order.

    ``cents`` are amounts, rounded to whole cents; ``marks`` are clocks of which only
    presence counts. Maps are written with sorted keys.
    """
    types = dict(df.dtypes)
    parts = []
    for c in sorted(columns):
        value = F.col(c)
        if c in cents:
            value = F.round(value * 100).cast("bigint")
        elif c in marks:
            value = value.isNotNull()
        elif types[c].startswith("map<"):
            value = sorted_map_text(value)
        parts.append(F.concat(F.lit(f"{c}="), F.coalesce(value.cast("string"), F.lit(ABSENT))))
    return F.concat_ws(SEPARATOR, *parts)


def piece_sums(digest: Column) -> list[Column]:
    """How many rows have a digest, and the sum of each piece of the digests.

    The halves of a piece are summed as longs, which a task adds up in place; decimals meet
    once, in the end.
    """
    def total(piece: Column) -> Column:
        high = F.sum(F.shiftright(piece, HALF)).cast("decimal(20,0)")
        low = F.sum(piece.bitwiseAND(F.lit(2**HALF - 1))).cast("decimal(20,0)")
        return F.coalesce((high * F.lit(2**HALF).cast("decimal(10,0)") + low).cast("decimal(30,0)"), F.lit(0).cast("decimal(30,0)"))

    return [F.count(digest)] + [
        total(F.conv(F.substring(digest, start, length), 16, 10).cast("long")) for start, length in PIECES]


def _combine(digest: Column) -> list[Column]:
    rows, *sums = piece_sums(digest)
    text = F.concat_ws(":", rows.cast("string"), *[s.cast("string") for s in sums])
    return [rows.alias("rows"), F.sha2(text, 256).alias("fingerprint")]


def moved_sums(parent: list[int], rows: DataFrame, was: str, now: str) -> list[int]:
    """The sums of a state whose changed rows had the digest ``was`` and have ``now``.

    A null digest is a row that did not count before, or does not count any longer. The
    sums add up, so those of the old rows are taken off and those of the new put in;
    nothing but the changed rows is read.
    """
    old, new = piece_sums(F.col(was)), piece_sums(F.col(now))
    row = rows.agg(*[c.cast("string").alias(f"s{i}") for i, c in enumerate(old + new)]).first()
    n = len(parent)
    return [p - int(a) + int(b) for p, a, b in zip(parent, row[:n], row[n:])]


def digest_of(sums: list[int]) -> str:
    """The fingerprint that belongs to a count and sums."""
    return hashlib.sha256(":".join(map(str, sums)).encode()).hexdigest()


def fingerprint(
    df: DataFrame, columns: list[str], by: list[str] | None = None,
    cents: set[str] = frozenset(), marks: set[str] = frozenset(),
) -> DataFrame:
    """(rows, fingerprint) of the listed columns, per group if ``by`` is given."""
    hashed = df.select(*(by or []), F.sha2(canonical(df, columns, cents, marks), 256).alias("__h"))
    combined = _combine(F.col("__h"))
    return hashed.groupBy(*by).agg(*combined) if by else hashed.agg(*combined)


def content_fingerprint(tables: dict[str, tuple[DataFrame, list[str], set[str]]]) -> DataFrame:
    """(table, rows, fingerprint) per table. Surrogate keys and clocks are left out by
    not listing them."""
    parts = [
        fingerprint(df, columns, cents=cents).select(
            F.lit(name).alias("table"), "rows", "fingerprint"
        )
        for name, (df, columns, cents) in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
