"""Lookups in the fixed dictionaries.

The dictionaries hold a few dozen constant rows, so broadcasting them is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.catalogues import types as catalogue


def _lookup(spark: SparkSession, entries: dict[str, str]) -> DataFrame:
    return F.broadcast(
        spark.createDataFrame(sorted(entries.items()), "lookup_key string, lookup_value string")
    )


def _looked_up(df: DataFrame, key, entries: dict[str, str], default, out: str) -> DataFrame:
    table = _lookup(df.sparkSession, entries)
    joined = df.withColumn("__key", key).join(
        table, F.col("__key") == F.col("lookup_key"), "left"
    )
    return joined.withColumn(out, F.coalesce("lookup_value", default)).drop(
        "__key", "lookup_key", "lookup_value"
    )


def with_spelling(
    df: DataFrame, type_col: str, out: str, spellings: tuple[str, ...] = catalogue.TYPE_SPELLINGS
) -> DataFrame:
    """The documented spelling of a known type; other types keep theirs."""
    entries = {t.lower(): t for t in spellings}
    return _looked_up(df, F.lower(type_col), entries, F.col(type_col), out)


def with_service(
    df: DataFrame, type_col: str, out: str, services: dict[str, str] = catalogue.SERVICE_OF_TYPE
) -> DataFrame:
    """The billing service of a type, else the text before the first ``/``."""
    return _looked_up(
        df, F.lower(type_col), services, F.split(F.col(type_col), "/")[0], out
    )


def with_violation_code(
    df: DataFrame, finding: str, out: str, mapping: dict[str, str], vocabulary
) -> DataFrame:
    """Finding name to violation code: the table first, then a known code, else dropped."""
    entries = {code: code for code in vocabulary} | dict(mapping)
    return _looked_up(
        df, F.col(finding), entries, F.lit(None).cast("string"), out
    ).where(F.col(out).isNotNull())
