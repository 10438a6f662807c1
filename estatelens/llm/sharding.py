"""Sharding by a seeded permutation of global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import ROW, running, whole_text, with_row_id
from estatelens.session import settle

ROUNDS = 8
MOST_WALKS = 64  # see `permuted`


def halves(n: int) -> tuple[int, int]:
    """The two halves' sizes: the smallest near-square that holds ``n`` numbers."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _mixed(half: Column, turn: Column, seed: int, size: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), turn.cast("long"), half), F.lit(size).cast("long"))


def _turned(left: Column, right: Column, turn: Column, seed: int, a: int, b: int) -> tuple[Column, Column]:
    """One Feistel round; even rounds change the left half, odd ones the right."""
    even = turn % 2 == 0
    return (
        F.when(even, (left + _mixed(right, turn, seed, a)) % a).otherwise(left),
        F.when(even, right).otherwise((right + _mixed(left, turn, seed, b)) % b),
    )


def permuted(df: DataFrame, number: str, out: str, n: int, seed: int) -> DataFrame:
    """Add ``out``: the place of row ``number`` (0 to n - 1) in a seeded permutation of these numbers.

    A Feistel network over the product of two halves permutes a domain of a * b >= n
    numbers. Numbers that fall outside the n are walked along their cycle until they fall
    inside. Fewer than sqrt(n) + 1 numbers lie outside, and a walk meets each at most once:
    up to 64 of them the walk is bounded exactly, and beyond that a longer walk has a
    chance below (1 / 64) ** 64. Should one happen, the job fails instead of
    returning a wrong place.
    """
    a, b = halves(n)
    left, right = (F.col(number) / b).cast("long"), F.col(number) % b
    left = F.expr(f"`{number}` div {b}L")
    rows = df.withColumn("_l", left).withColumn("_r", right.cast("long"))
    for turn in range(ROUNDS):
        new_left, new_right = _turned(F.col("_l"), F.col("_r"), F.lit(turn), seed, a, b)
        rows = rows.withColumn("_l", new_left) if turn % 2 == 0 else rows.withColumn("_r", new_right)
    first = F.col("_l") * b + F.col("_r")
    outside = a * b - n
    if not outside:
        return rows.withColumn(out, first).drop("_l", "_r")

    def step(state: Column, i: Column) -> Column:
        l, r = state["l"], state["r"]
        done = (i % ROUNDS == 0) & (l * b + r < n)
        done = state["done"] | done
        new_left, new_right = _turned(l, r, i % ROUNDS, seed, a, b)
        return F.struct(
            F.when(done, l).otherwise(new_left).alias("l"), F.when(done, r).otherwise(new_right).alias("r"), done.alias("done"))

    walk = F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS * min(outside, MOST_WALKS) - 1)),
        F.struct(F.col("_l").alias("l"), F.col("_r").alias("r"), F.lit(False).alias("done")),
        step, lambda s: s["l"] * b + s["r"])
    rows = rows.withColumn(out, F.when(first < n, first).otherwise(walk))
    checked = F.when(F.col(out) < n, F.col(out)).otherwise(F.raise_error(F.lit("a cycle is too long")).cast("long"))
    return rows.withColumn(out, checked).drop("_l", "_r")


def shuffled(df: DataFrame, order: list[str], seed: int = 42) -> DataFrame:
    """Rows with ``row_number`` (their rank by ``order``, from 0) and ``position`` in the seeded shuffle.

    Ranks come from sorted ranges and the ranges' counts, so no task holds more than a
    range; rows equal in every key of ``order`` are ranked in any order.
    """
    rows = settle(running(df, order, {"row_number": "1"}))
    return permuted(rows, "row_number", "position", rows.count(), seed)


def sharded(df: DataFrame, order: list[str], n_shards: int, seed: int = 42) -> DataFrame:
    """Deal the shuffled rows out in turn: ``shard`` is position mod n, ``slot`` position div n.

    Law "rows": shard counts differ by one at most, slots are gapless from 0. Both follow
    from (row_number, row count, seed) alone; `place` gives them without any table.
    """
    rows = shuffled(df, order, seed)
    return (
        rows.withColumn("law", F.lit("rows"))
        .withColumn("shard", (F.col("position") % n_shards).cast("int"))
        .withColumn("slot", F.expr(f"position div {n_shards}L"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
    )


def place(row_number: int, n: int, n_shards: int, seed: int, mix) -> tuple[int, int]:
    """Shard and slot of one row, on the driver. ``mix(seed, turn, half)`` is the signed round hash."""
    a, b = halves(n)
    x = row_number
    while True:
        left, right = divmod(x, b)
        for turn in range(ROUNDS):
            if turn % 2 == 0:
                left = (left + mix(seed, turn, right) % a) % a
            else:
                right = (right + mix(seed, turn, left) % b) % b
        x = left * b + right
        if x < n:
            return x % n_shards, x // n_shards


def document_shards(documents: DataFrame, n_shards: int = 8, seed: int = 42) -> DataFrame:
    """Shards of documents with their size (UTF-8 bytes plus 1; null text: 1) and CRC-32.

    A null text has the CRC of the empty text. Rows are numbered by doc_id (null first),
    then size and hashes of the text, so repeated ids are ordered by their text; equal rows
    may swap places. Columns other than doc_id and text are not read. An empty table gives
    an empty result.
    """
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(whole_text("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("_hash"))
    out = sharded(rows, ["doc_id", "size", "text_crc32", "_hash"], n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number", "position")


def sharded_documents(docs: DataFrame, n_shards: int = 8, seed: int = 42) -> DataFrame:
    """The documents with their columns as they are, and shard and slot as `document_shards` gives them.

    Only ids, sizes and hashes are sorted; the documents are then joined to their places.
    Columns of the documents named shard or slot give way.
    """
    named = with_row_id(docs)
    text = F.col("row.text")
    rows = named.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).alias("_size"),
        F.crc32(whole_text(text).cast("binary")).alias("_crc"), F.xxhash64(text).alias("_hash"), *ROW)
    placed = sharded(rows, ["doc_id", "_size", "_crc", "_hash", *ROW], n_shards, seed).select(*ROW, "shard", "slot")
    keep = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return named.join(placed, list(ROW)).select(*keep, "shard", "slot")
