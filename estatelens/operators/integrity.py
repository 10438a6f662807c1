"""Completeness, dangling references, removable rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.session import settle


def complete_parents(children: DataFrame, declared: DataFrame, key: str = "subscription_id") -> DataFrame:
    """Declared parents plus every parent a child names, each once."""
    return declared.select(key).union(children.select(key)).where(F.col(key).isNotNull()).distinct()


def complete_groups(
    declared: DataFrame, children: DataFrame, owner: str = "subscription_id", name: str = "name",
    child_group: str = "resource_group",
) -> DataFrame:
    """Declared groups plus the groups rows name that are not declared in any casing."""
    seen = (
        children.where(F.col(child_group).isNotNull())
        .groupBy(F.col(owner).alias(owner), F.lower(F.col(child_group)).alias("__key"))
        .agg(F.min(child_group).alias(name))
    )
    known = declared.select(owner, F.lower(F.col(name)).alias("__key")).distinct()
    extra = seen.join(known, [owner, "__key"], "left_anti").select(owner, name)
    return declared.select(owner, name).unionByName(extra)


def dangling(
    edges: DataFrame, nodes: DataFrame, source: str = "source_resource_id",
    target: str = "target_resource_id", node: str = "id",
) -> DataFrame:
    """Edges whose source or target is not a node.

    The distinct ids are hashed, a share of them in each task, and the edges pass by unsorted.
    """
    ids = nodes.select(node).distinct().withColumn("__known", F.lit(True))
    ends = edges
    for side, col in (("__s", source), ("__t", target)):
        known = ids.select(F.col(node).alias(col), F.col("__known").alias(side))
        ends = ends.join(known.hint("shuffle_hash"), col, "left")
    return ends.where(F.col("__s").isNull() | F.col("__t").isNull()).drop("__s", "__t")


def dangling_scopes(
    assignments: DataFrame, principals: DataFrame, owners: DataFrame, groups: DataFrame,
    rows: DataFrame,
) -> DataFrame:
    """Assignments whose scope is no owner, group or row, or whose principal is unknown."""
    scopes = (
        owners.select(F.concat(F.lit("/subscriptions/"), F.col("subscription_id")).alias("scope"))
        .union(groups.select("id"))
        .union(rows.select("id"))
        .distinct()
    )
    homeless = assignments.join(scopes, "scope", "left_anti").withColumn("reason", F.lit("scope"))
    strangers = assignments.join(
        principals.select(F.col("oid").alias("principal_oid")), "principal_oid", "left_anti"
    ).withColumn("reason", F.lit("principal"))
    return homeless.unionByName(strangers)


def path_order(path: str) -> Column:
    """A text for each path that sorts as its components do: the slash is the least character, two others are escaped."""
    escaped = F.replace(F.replace(F.col(path), F.lit("\u0001"), F.lit("\u0001\u0002")), F.lit("\u0000"), F.lit("\u0001\u0001"))
    return F.replace(escaped, F.lit("/"), F.lit("\u0000"))


def with_something_below(ids: DataFrame, key: str = "id") -> DataFrame:
    """The ids that another id extends by further path components.

    In order of components an id stands directly before everything below it, so it has
    something below exactly if its successor extends it. The ids are cut into even ranges of
    that order, the first id of each range is carried to the range before it, and no ancestor
    is ever written out: neither depth nor a hot parent makes more rows. Repeated ids stand
    together, the last of them has the successor. The empty path is nobody's parent; null
    ids take no part.
    """
    slim = ids.select(F.col(key).alias("id")).where(F.col(key).isNotNull())
    cut = settle(slim.repartitionByRange(path_order("id")).withColumn("__range", F.spark_partition_id()))
    firsts = cut.groupBy("__range").agg(F.min_by("id", path_order("id")).alias("id"))  # one row a range
    carried = firsts.select("__range", F.lead("id").over(Window.orderBy("__range")).alias("__next"))
    within = Window.partitionBy("__range").orderBy("__place")
    after = F.coalesce(F.lead("id").over(within), F.col("__next"))
    below = (F.col("id") != "") & F.startswith(F.col("__after"), F.concat("id", F.lit("/")))
    placed = cut.withColumn("__place", path_order("id")).join(F.broadcast(carried), "__range").withColumn("__after", after)
    return placed.where(below).select(F.col("id").alias(key))


def removable(rows: DataFrame, references: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows nobody refers to and that no other row lies below; rows without an id are kept."""
    held = reduce(
        DataFrame.union, [r.select(F.col(r.columns[0]).alias(key)) for r in references], with_something_below(rows, key))
    return rows.join(held, key, "left_anti")


def removable_by_keys(rows: DataFrame, references: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key stands in none of the reference frames."""
    named = reduce(DataFrame.union, [r.select(F.col(r.columns[0]).alias(key)) for r in references])
    return rows.join(named.where(F.col(key).isNotNull()).distinct(), key, "left_anti")


NESTED = (
    "networkProfile struct<networkInterfaces: array<struct<id: string>>>, "
    "storageProfile struct<osDisk: struct<managedDisk: struct<id: string>>>, "
    "ipConfigurations array<struct<properties: struct<"
    "subnet: struct<id: string>, publicIPAddress: struct<id: string>>>>"
)


def referenced_ids(rows: DataFrame, properties: str = "properties", managed_by: str = "managed_by") -> DataFrame:
    """Distinct ids that rows refer to from nested JSON or as their manager."""
    parsed = F.from_json(F.col(properties), NESTED)
    configs = parsed["ipConfigurations"]["properties"]
    none = F.array().cast("array<string>")
    ids = F.concat(
        F.coalesce(parsed["networkProfile"]["networkInterfaces"]["id"], none),
        F.coalesce(F.array(parsed["storageProfile"]["osDisk"]["managedDisk"]["id"]), none),
        F.coalesce(configs["subnet"]["id"], none),
        F.coalesce(configs["publicIPAddress"]["id"], none),
        F.array(F.col(managed_by)),
    )
    return rows.select(F.explode(ids).alias("id")).where(F.col("id").isNotNull()).distinct()


def missing_sibling(
    items: DataFrame, siblings: DataFrame, scope: list[str], name: str, suffix: str = "-lock"
) -> DataFrame:
    """Items without a sibling named ``item || suffix`` in the same scope."""
    expected = items.withColumn("expected_name", F.concat(F.col(name), F.lit(suffix)))
    present = siblings.select(*scope, F.col(name).alias("expected_name")).distinct()
    return expected.join(present, [*scope, "expected_name"], "left_anti")


def blocking_batches(batches: DataFrame, records: DataFrame, batch_id) -> DataFrame:
    """Newer batches, not reverted, that changed any resource the given batch changed."""
    newer = newer_in_force(batches, batch_id)
    mine = records.where(F.col("batch_id") == batch_id).select("resource_id").distinct()
    # Only records of newer batches can share a row with it.
    later = records.select("batch_id", "resource_id").join(newer.select("batch_id"), "batch_id", "left_semi")
    sharing = later.join(mine, "resource_id", "left_semi").select("batch_id").distinct()
    return newer.join(sharing, "batch_id", "left_semi")


def newer_in_force(batches: DataFrame, batch_id) -> DataFrame:
    """Newer batches, not reverted."""
    own_seq = batches.where(F.col("batch_id") == batch_id).agg(F.max("seq")).scalar()
    return batches.where((F.col("seq") > own_seq) & F.col("reverted_at").isNull())


def same_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: sizes, ids on one side only, ids seen more than once on the left."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    both = a.join(b, key, "full")

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    return both.agg(
        count(F.col("l").isNotNull() & F.col("r").isNotNull(), "in_both"),
        count(F.col("r").isNull(), "left_only"),
        count(F.col("l").isNull(), "right_only"),
        count(F.col("l") > 1, "repeated"),
    )
