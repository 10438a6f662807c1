"""Property, sku and kind values of the most frequent types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.catalogues import types as catalogue
from estatelens.catalogues import words
from estatelens.functions.jsonmaps import json_map
from estatelens.functions.text import canonical_namespace
from .histogram import check_floor, fold_other, shares, value_counts
from .ranking import top_n


def _allowed(type_col: str, fields: dict[str, tuple[str, ...]]) -> Column:
    listed = F.lit(False)
    for type_name, names in fields.items():
        listed = listed | ((F.col(type_col) == type_name) & F.col("field").isin(*names))
    return listed


def type_shapes(
    resources: DataFrame,
    frequencies: DataFrame,
    min_size: int,
    property_fields: dict[str, tuple[str, ...]] = catalogue.PROPERTY_FIELDS,
    sku_fields: tuple[str, ...] = catalogue.SKU_FIELDS,
    top: int = words.TOP_TYPES,
) -> DataFrame:
    """Value shares of allowed fields, for the ``top`` types by (-share, type).

    Fields are denied unless listed. All types go through one pass over the rows: rows
    shrink to what their listed fields hold and are counted, then entries are made of that.
    """
    check_floor(min_size)
    leading = top_n(frequencies, top, [F.desc("share"), F.asc("type")]).select("type")
    # ``top`` rows, so the broadcast is bounded.
    rows = resources.withColumn("type", canonical_namespace("type")).join(
        F.broadcast(leading), "type", "left_semi"
    )
    # Fields that no type lists go before rows are counted: they may tell all rows apart.
    wanted = sorted({name for names in property_fields.values() for name in names})
    held = rows.select("type", _held("properties", wanted).alias("properties"), _held("sku", sku_fields).alias("sku"), "kind")
    held = value_counts(held, *held.columns)
    kind = F.array(F.struct(F.lit("kind").alias("key"), F.col("kind").alias("value")))
    labelled = F.concat(
        _part("properties", F.col("properties")),
        _part("sku", F.col("sku")),
        _part("kind", F.when(F.col("kind").isNotNull(), kind)),
    )
    part = F.col("part")
    listed = (
        ((part == "properties") & _allowed("type", property_fields))
        | ((part == "sku") & F.col("field").isin(*sku_fields))
        | ((part == "kind") & F.col("field").isin(*catalogue.KIND_FIELDS))
    )
    by = ["part", "type", "field"]
    counted = value_counts(held.select("type", "n", F.inline(labelled)).where(listed), *by, "value", weight="n")
    return shares(fold_other(counted, "value", min_size, by, null_label=words.NULL_LABEL), by)


def _held(json_text: str, fields) -> Column:
    """Entries of the listed fields of a JSON object, as they stand in it."""
    return F.map_entries(F.map_filter(json_map(json_text), lambda k, _: k.isin(*fields)))


def _part(name: str, entries: Column) -> Column:
    """Entries of one object as (part, field, value); none for a missing object."""
    shape = "array<struct<part: string, field: string, value: string>>"
    named = F.transform(
        entries,
        lambda e: F.struct(F.lit(name).alias("part"), e["key"].alias("field"), e["value"].alias("value")),
    )
    return F.coalesce(named.cast(shape), F.array().cast(shape))
