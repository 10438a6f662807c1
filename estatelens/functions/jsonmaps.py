"""JSON objects as maps: parsing, key filters, setting and removing fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, col, is_listed

TEXT_MAP = "map<string,string>"


def null_if_empty(json_text: ColumnOrName) -> Column:
    """An empty JSON object counts as no object."""
    trimmed = F.trim(col(json_text))
    return F.when(trimmed != "{}", col(json_text))


def json_map(json_text: ColumnOrName) -> Column:
    """Top-level fields as text; nested values stay JSON text, JSON null becomes NULL."""
    return F.from_json(col(json_text), TEXT_MAP)


def empty_map() -> Column:
    return F.from_json(F.lit("{}"), TEXT_MAP)


def filter_map_keys(mapping: ColumnOrName, allowed) -> Column:
    """Keep the allowed keys (trimmed, any case); nothing left becomes NULL."""
    kept = F.map_filter(col(mapping), lambda k, _: is_listed(k, allowed))
    return F.when(F.size(kept) > 0, kept)


def set_key(mapping: ColumnOrName, key: ColumnOrName, value: Column) -> Column:
    m, k = F.coalesce(col(mapping), empty_map()), col(key)
    others = F.map_filter(m, lambda name, _: name != k)
    return F.map_concat(others, F.create_map(k, value.cast("string")))


def remove_key(mapping: ColumnOrName, key: ColumnOrName) -> Column:
    k = col(key)
    return F.map_filter(F.coalesce(col(mapping), empty_map()), lambda name, _: name != k)


def sorted_map_text(mapping: ColumnOrName) -> Column:
    """One canonical text per map, whatever the key order; a map in order of its keys is not built anew."""
    m = col(mapping)
    keys = F.map_keys(m)
    ordered = F.map_from_entries(F.sort_array(F.map_entries(m)))
    return F.when(keys == F.sort_array(keys), F.to_json(m)).otherwise(F.to_json(ordered))


def revert_field(
    mapping: ColumnOrName, path: ColumnOrName, before: ColumnOrName, after: ColumnOrName
) -> Column:
    """Undo one recorded change of ``<container>.<key>`` or ``<container>.<key>[]``.

    ``[]`` takes the appended element out again and drops the key once the list is
    empty; a NULL ``before`` removes the key; anything else is put back.
    """
    m = F.coalesce(col(mapping), empty_map())
    rest = F.regexp_replace(col(path), "^[^.]*\\.", "")
    appended = rest.endswith("[]")
    key = F.regexp_replace(rest, "\\[\\]$", "")
    elements = F.from_json(F.element_at(m, key), "array<string>")
    remaining = F.filter(elements, lambda e: e != col(after))
    rebuilt = F.concat(F.lit("["), F.concat_ws(",", remaining), F.lit("]"))
    return (
        F.when(
            appended,
            F.when(F.size(remaining) > 0, set_key(m, key, rebuilt)).otherwise(remove_key(m, key)),
        )
        .when(col(before).isNull(), remove_key(m, key))
        .otherwise(set_key(m, key, col(before)))
    )
