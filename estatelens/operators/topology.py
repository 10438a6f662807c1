"""References that cross owners, and the topology odds read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.catalogues.types import TOPOLOGY_DEFAULTS
from .histogram import value_counts

REFERENCE = "/subscriptions/([0-9a-zA-Z-]+)/"


def cross_refs(df: DataFrame, text: str = "properties", owner: str = "subscription_id") -> DataFrame:
    """One row: rows whose text names another owner first, distinct sources and targets.

    The references are counted per (source, target) pair before they are counted again,
    so no single task sees every referring row.
    """
    return crossings(value_counts(df.select(F.col(owner).alias("source"), other_owner(text, owner).alias("target")), "source", "target"))


def other_owner(text: str, owner: str) -> Column:
    """The owner that a text names first, if it is another one."""
    referred = F.regexp_extract(F.col(text), REFERENCE, 1)
    return F.when((referred != "") & (referred != F.col(owner)), referred)


def crossings(pairs: DataFrame) -> DataFrame:
    """The signal from counted (source, target, n); a null target is a row that names no other owner."""
    crossing = F.col("target").isNotNull()
    return pairs.agg(
        F.coalesce(F.sum(F.when(crossing, F.col("n"))), F.lit(0)).alias("cross_ref_resources"),
        F.count_distinct(F.when(crossing, F.col("source"))).alias("spoke_subscriptions"),
        F.count_distinct("target").alias("hub_subscriptions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_resources"),
    )


def topology_odds(signal: DataFrame) -> DataFrame:
    """Long rows (pattern, measure, value) of the one-row signal; defaults where it is empty."""
    refs, spokes = F.col("cross_ref_resources"), F.col("spoke_subscriptions")
    total = F.col("total_resources")
    seen = (refs > 0) & (spokes > 0) & (total > 0)

    def clamp(c):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))

    measured = {
        ("hub_spoke", "probability"): F.greatest(
            clamp(spokes / total), F.lit(TOPOLOGY_DEFAULTS["hub_spoke", "probability"])
        ),
        ("hub_spoke", "hub_count_mean"): F.col("hub_subscriptions").cast("double"),
        ("hub_spoke", "hub_count_std"): F.lit(0.0),
        ("private_endpoints", "probability"): clamp(refs / total),
        ("private_endpoints", "per_spoke_mean"): refs / spokes,
        ("private_endpoints", "per_spoke_std"): F.lit(0.0),
    }
    rows = [
        F.struct(
            F.lit(pattern).alias("pattern"),
            F.lit(measure).alias("measure"),
            (
                F.when(seen, measured[pattern, measure]).otherwise(F.lit(default))
                if (pattern, measure) in measured
                else F.lit(default)
            ).alias("value"),
        )
        for (pattern, measure), default in TOPOLOGY_DEFAULTS.items()
    ]
    return signal.select(F.inline(F.array(*rows)))
