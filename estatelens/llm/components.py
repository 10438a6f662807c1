"""Connected components by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.session import settle


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the links; the component is its smallest node.

    Each round points every node and its greater neighbours at the smallest neighbour, then
    every node and its lesser neighbours at the smallest of them. The stars that remain are
    the components. Both steps are an aggregate of links by node and a join, so a node with
    very many links is merged within tasks first. Each round's links are written to the
    shared folder; the rounds end when a round changes nothing.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = settle(links)
    mark = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is not the smallest among its neighbours also points at the smallest
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        links = settle(large.unionByName(own).where("u <> v").distinct())
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        small = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = _mark(links)
        if new == mark:
            break
        mark = new
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(links: DataFrame) -> tuple:
    """Count and two sums of hashes: equal for equal sets of links."""
    h = F.xxhash64("u", "v")
    row = links.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))).first()
    return tuple(row)
