"""Renaming groups whose contents do not back their name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.rewriting import reference_keys, rewrite_refs
from .coherence import GENERIC_TOKENS, confirm_archetype
from .sampling import next_free


def name_stem(name: Column, token: Column, new_token: Column) -> Column:
    """The name up to its number, with the token exchanged."""
    quoted = F.concat(F.lit("-"), token, F.lit("-"))
    number = F.call_function("substring_index", name, quoted, F.lit(-1))
    known = F.contains(name, quoted) & number.rlike("^[0-9]+$")
    prefix = F.substring(name, F.lit(1), F.length(name) - F.length(number) - F.length(quoted))
    shaped = F.regexp_extract(name, "^(rg-[a-z0-9]+-[a-z0-9]+)-(.+)-([0-9]+)$", 1)
    base = F.when(known, prefix).when(shaped != "", shaped).otherwise(name)
    return F.concat(base, F.lit("-"), new_token, F.lit("-"))


def confirmed_names(groups: DataFrame) -> DataFrame:
    """New names of groups (subscription_id, name, token, type_set) that claim too much.

    Returns subscription_id, old_name, new_name. Confirmed and generic names stay.
    """
    judged = confirm_archetype(groups, "token", "type_set", "__v")
    claims = judged.where(~F.col("token").isin(*GENERIC_TOKENS) & (F.col("__v.token") != F.col("token")))
    wanted = claims.select(
        "subscription_id", F.col("name").alias("old_name"),
        name_stem(F.col("name"), F.col("token"), F.col("__v.token")).alias("stem"))
    kept = groups.select("subscription_id", "name").join(
        wanted.select("subscription_id", F.col("old_name").alias("name")), ["subscription_id", "name"], "left_anti")
    return next_free(wanted, ["subscription_id"], "stem", kept, "old_name", "new_name").select(
        "subscription_id", "old_name", "new_name")


def renamed_id(path: Column, old: Column, new: Column) -> Column:
    """An id with its own group segment exchanged."""
    marker = F.concat(F.lit("/resourceGroups/"), old)
    at = F.instr(path, "/resourceGroups/")
    head = F.substring(path, F.lit(1), at - 1)
    tail = F.substring(path, at + F.length(marker), F.length(path))
    return F.when(new.isNotNull(), F.concat(head, F.lit("/resourceGroups/"), new, tail)).otherwise(path)


def rewrite_column(rows: DataFrame, key: str, column: str, renames: DataFrame) -> DataFrame:
    """Rewrite the group names inside every reference of a text column.

    Only rows that hold a renamed reference get a map, and only of the names they hold.
    """
    table = renames.select(
        F.concat_ws("/", "subscription_id", "old_name").alias("__ref"), F.col("new_name").alias("__new"))
    found = rows.select(key, F.explode(F.array_distinct(reference_keys(column))).alias("__ref")).join(table, "__ref")
    # A row refers to a handful of groups.
    maps = found.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("__ref", "__new"))).alias("__names"))
    joined = rows.join(maps, key, "left")
    return joined.withColumn(
        column, F.when(F.col("__names").isNotNull(), rewrite_refs(column, "__names")).otherwise(F.col(column))
    ).drop("__names")


def rename_ids(rows: DataFrame, renames: DataFrame, id_cols: list[str]) -> DataFrame:
    """Exchange the group segment of id columns that lie in renamed groups."""
    out = rows
    for c in id_cols:
        owner = F.regexp_extract(c, "^/subscriptions/([^/]+)/resourceGroups/([^/]+)", 1)
        group = F.regexp_extract(c, "^/subscriptions/([^/]+)/resourceGroups/([^/]+)", 2)
        table = renames.select(
            F.col("subscription_id").alias("__o"), F.col("old_name").alias("__g"), F.col("new_name").alias("__n"))
        joined = out.withColumn("__o", owner).withColumn("__g", group).join(table, ["__o", "__g"], "left")
        out = joined.withColumn(c, renamed_id(F.col(c), F.col("__g"), F.col("__n"))).drop("__o", "__g", "__n")
    return out


def rename_estate(tables: dict[str, DataFrame], renames: DataFrame) -> dict[str, DataFrame]:
    """Groups, rows, edges and violations under the new names, every reference rewritten."""
    table = renames.select("subscription_id", F.col("old_name").alias("__old"), F.col("new_name").alias("__new"))

    def with_name(df: DataFrame, column: str) -> DataFrame:
        joined = df.join(table.withColumnRenamed("__old", column), ["subscription_id", column], "left")
        return joined.withColumn(column, F.coalesce("__new", column)).drop("__new")

    out = dict(tables)
    out["resource_groups"] = with_name(rename_ids(tables["resource_groups"], renames, ["id"]), "name")
    rows = rewrite_column(tables["resources"], "id", "properties", renames)
    out["resources"] = with_name(rename_ids(rows, renames, ["id", "managed_by"]), "resource_group_name")
    if "dependencies" in tables:
        out["dependencies"] = rename_ids(tables["dependencies"], renames, ["source_resource_id", "target_resource_id"])
    if "violations" in tables:
        out["violations"] = rename_ids(tables["violations"], renames, ["resource_id"])
    return out
