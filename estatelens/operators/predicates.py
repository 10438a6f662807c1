"""Filters over estate rows."""

from __future__ import annotations

from functools import reduce
from uuid import UUID

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paging import page

# --- fixed values: must equal the reference's for right results ---------------------
MAX_TERM_CHARS = 200
SEVERITIES = ("high", "medium", "low")


def where_tree(tree: tuple, tags: str = "tags") -> Column:
    """Condition of a predicate tree.

    Leaves are ``("eq", column, value)``, ``("tag", key, value)`` and
    ``("tag_exists", key)``; nodes are ``("and", ...)`` and ``("or", ...)``. Equality is
    exact and case-sensitive. ``tags`` is a map column.
    """
    op, *args = tree
    if op == "eq":
        return F.col(args[0]) == F.lit(args[1])
    if op == "tag":
        return F.element_at(F.col(tags), F.lit(args[0])) == F.lit(args[1])
    if op == "tag_exists":
        return F.map_contains_key(F.col(tags), F.lit(args[0]))
    if op in ("and", "or") and args:
        parts = [where_tree(a, tags) for a in args]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
    raise ValueError(f"unknown predicate {op!r}")


def visible(df: DataFrame, mark: str = "drift_deleted_at") -> DataFrame:
    """Rows that no change batch has hidden."""
    return df.where(F.col(mark).isNull())


def same_text(column: str, value: str) -> Column:
    """Equality without case."""
    return F.lower(F.col(column)) == value.lower()


def normalise_term(term: str) -> str:
    if len(term) > MAX_TERM_CHARS:
        raise ValueError(f"the search term is longer than {MAX_TERM_CHARS} characters")
    cleaned = term.replace("*", "")
    if not cleaned.strip():
        raise ValueError("the search term is blank")
    return cleaned


def holds_term(column: str, term: str) -> Column:
    """Literal substring match without case; ``%`` and ``_`` mean themselves."""
    return F.contains(F.lower(F.col(column)), F.lit(term.lower()))


def search(
    df: DataFrame,
    parents: DataFrame,
    term: str,
    name: str = "name",
    type_col: str = "type",
    parent_key: str = "subscription_id",
    parent_name: str = "display_name",
    parent_id: str | None = None,
) -> DataFrame:
    """Rows whose name, type or parent's name holds the term.

    Matching parents are joined as a mark, so a row that matches twice is kept once.
    """
    wanted = normalise_term(term)
    marks = parents.where(holds_term(parent_name, wanted)).select(parent_key).distinct()
    marks = marks.withColumn("__hit", F.lit(True))
    rows = df if parent_id is None else df.where(F.col(parent_key) == parent_id)
    hit = (
        F.coalesce(holds_term(name, wanted), F.lit(False))
        | F.coalesce(holds_term(type_col, wanted), F.lit(False))
        | F.col("__hit").isNotNull()
    )
    return rows.join(marks, parent_key, "left").where(hit).drop("__hit")


def violation_filter(
    owner: str | None = None, code: str | None = None, resource: str | None = None,
    severity: str | None = None,
) -> Column:
    """All given conditions together; the severity must be a known one."""
    if severity is not None and severity.lower() not in SEVERITIES:
        raise ValueError(f"unknown severity {severity!r}")
    parts = [F.lit(True)]
    if owner is not None:
        parts.append(F.col("subscription_id") == owner)
    if code is not None:
        parts.append(same_text("violation_type", code))
    if resource is not None:
        parts.append(F.col("resource_id") == resource)
    if severity is not None:
        parts.append(same_text("severity", severity))
    return reduce(lambda a, b: a & b, parts)


def edges(df: DataFrame, owner=None, kind: str | None = None) -> DataFrame:
    """Edges that touch an owner, with a mark on those that cross owners."""
    rows = df
    if owner is not None:
        rows = rows.where(
            (F.col("source_subscription") == owner) | (F.col("target_subscription") == owner)
        )
    if kind is not None:
        rows = rows.where(same_text("dependency_type", kind))
    return rows.withColumn(
        "cross_subscription", F.col("source_subscription") != F.col("target_subscription")
    )


def assignments(
    df: DataFrame, owner: str, principal: str | None = None, at_scope: bool = False
) -> DataFrame:
    """Role assignments of an owner; ``at_scope`` keeps those made on the owner itself."""
    rows = df.where(F.col("subscription_id") == owner)
    if principal is not None:
        rows = rows.where(F.col("principal_oid") == principal)
    if at_scope:
        rows = rows.where(F.col("scope") == f"/subscriptions/{owner}")
    return rows


def assignment_page(
    df: DataFrame, owner: str, after: str | None = None, top: int | None = None,
    principal: str | None = None, at_scope: bool = False,
) -> DataFrame:
    """A page of an owner's assignments in order of their UUID.

    UUIDs are kept in lower case, whose text order is their value order; a cursor that is
    none is an error.
    """
    cursor = None if after is None else str(UUID(after))
    return page(assignment_rows(assignments(df, owner, principal, at_scope)), "name", cursor, top)


def assignment_rows(df: DataFrame) -> DataFrame:
    """Served columns of role assignments: full id and role id scoped to the owner."""
    return df.select(
        F.concat(
            "scope", F.lit("/providers/Microsoft.Authorization/roleAssignments/"), "assignment_id"
        ).alias("id"),
        F.col("assignment_id").alias("name"),
        F.lit("Microsoft.Authorization/roleAssignments").alias("type"),
        F.concat(F.lit("/subscriptions/"), "subscription_id", "role_definition_id").alias(
            "role_definition_id"
        ),
        F.col("principal_oid").alias("principal_id"),
        "principal_type",
        "scope",
    )


def scoped_read(
    df: DataFrame, owner=None, types: list[str] | None = None, mark: str | None = "drift_deleted_at",
    owner_col: str = "subscription_id", type_col: str = "type", key: str = "id",
) -> DataFrame:
    """Visible rows in order of id; an absent filter lets everything through."""
    rows = df if mark is None else visible(df, mark)
    if owner is not None:
        rows = rows.where(F.col(owner_col) == owner)
    if types:
        rows = rows.where(F.col(type_col).isin(*types))
    return rows.orderBy(key)
