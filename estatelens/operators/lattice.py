"""One table of partial counts from which the sections of a profile are rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.functions.text import classify_name
from estatelens.session import settle
from .topology import other_owner

KEYS = ("subscription_id", "resource_group", "type", "location", "tags")


def row_lattice(resources: DataFrame) -> DataFrame:
    """Settled counts ``n`` of rows by owner, group, type, location, tags, class sequence of the name and referred owner.

    The scan is read once, names and properties shrink to a class sequence and an owner
    there, and every count over these keys is a sum over the lattice. Its columns keep the
    scan's names, so operators that take a ``weight`` read it like the scan. Null is a value
    of every key. At worst, when no two rows agree, it holds the scan's rows without their
    wide columns.
    """
    keyed = resources.select(
        *KEYS,
        F.when(F.col("name").isNotNull(), classify_name("name")).alias("classes"),
        other_owner("properties", "subscription_id").alias("target"),
    )
    return settle(keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n")))


def rolled_up(lattice: DataFrame, *keys: str) -> DataFrame:
    """The lattice by fewer keys."""
    return lattice.groupBy(*keys).agg(F.sum("n").alias("n"))
