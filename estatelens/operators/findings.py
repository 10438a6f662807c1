"""Violation rates from raw findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.catalogues.types import VIOLATION_OF_FINDING
from .dimensions import with_violation_code
from .histogram import drop_small, value_counts


def violation_rates(
    findings: DataFrame,
    total,
    min_size: int,
    vocabulary,
    mapping: dict[str, str] = VIOLATION_OF_FINDING,
    finding: str = "finding_type",
) -> DataFrame:
    """Findings above the floor, mapped to codes, per row of the estate, at most 1."""
    kept = drop_small(value_counts(findings, finding), min_size)
    coded = with_violation_code(kept, finding, "code", mapping, vocabulary)
    return coded.groupBy("code").agg(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum("n") / total)).alias("rate")
    )
