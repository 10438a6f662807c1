"""Rewriting group names inside nested references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, col

REFERENCE = "/subscriptions/([^/]+)/resourceGroups/([^/]+)/"


def reference_keys(text: ColumnOrName) -> Column:
    """``owner/group`` of every reference in a JSON text, in order."""
    owners = F.regexp_extract_all(col(text), F.lit(REFERENCE), F.lit(1))
    groups = F.regexp_extract_all(col(text), F.lit(REFERENCE), F.lit(2))
    return F.zip_with(owners, groups, lambda o, g: F.concat_ws("/", o, g))


def rewrite_refs(text: ColumnOrName, renamed: ColumnOrName) -> Column:
    """Replace renamed group segments in one pass.

    ``renamed`` maps ``owner/old group`` to the new group name. The text is cut at each
    reference and rebuilt from its pieces, so a new name is never rewritten again.
    """
    t, names = col(text), col(renamed)
    pieces = F.split(t, REFERENCE)
    keys = reference_keys(t)

    def replacement(key: Column) -> Column:
        owner = F.regexp_extract(key, "^([^/]+)/", 1)
        group = F.regexp_extract(key, "/(.*)$", 1)
        return F.concat(
            F.lit("/subscriptions/"), owner, F.lit("/resourceGroups/"),
            F.coalesce(F.element_at(names, key), group), F.lit("/"),
        )

    rebuilt = F.zip_with(
        pieces,
        F.concat(F.transform(keys, replacement), F.array(F.lit(""))),
        lambda piece, ref: F.concat(piece, F.coalesce(ref, F.lit(""))),
    )
    return F.when(F.size(keys) > 0, F.array_join(rebuilt, "")).otherwise(t)
