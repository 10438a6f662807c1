"""Wiring resources to each other inside an owner.

Pools are numbered inside their owner bucket by bucket, and a row picks its partner by
number, so owner, type and number together are the join key: a hot owner's rows spread
over as many tasks as its pool has members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions.keyed import key_hash
from .ranking import keyed_rank

OWNER = "subscription_id"


def numbered_pool(rows: DataFrame, type_name: str, seed: int) -> DataFrame:
    """(owner, number, member, size) of one type's rows, numbered from 1 per owner."""
    pool = rows.where(F.col("type") == type_name).select(OWNER, "id")
    sizes = pool.groupBy(OWNER).agg(F.count(F.lit(1)).alias("size"))
    ranked = keyed_rank(pool, [OWNER], ["id"], seed, f"pool/{type_name}", "number")
    return ranked.join(sizes, OWNER).select(OWNER, "number", F.col("id").alias("member"), "size")


def pick_partner(rows: DataFrame, pool: DataFrame, seed: int, purpose: str, out: str) -> DataFrame:
    """Add a random member of the owner's pool to each row; NULL where the pool is empty."""
    sizes = pool.where(F.col("number") == 1).select(OWNER, "size")
    sized = rows.join(sizes, OWNER, "left").withColumn(
        "__number", F.pmod(F.shiftrightunsigned(key_hash(seed, purpose, "id"), 4), F.col("size")) + 1)
    members = pool.select(OWNER, F.col("number").alias("__number"), F.col("member").alias(out))
    return sized.join(members, [OWNER, "__number"], "left").drop("size", "__number")
