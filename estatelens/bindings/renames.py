"""Free names, rewritten references, groups renamed after an audit: WIN-04, FN-12, SAM-14."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.operators import renaming, sampling, wiring
from . import audits
from . import tables as b
from .registry import query, with_views


@query(
    "free_names",
    "WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders), "
    "n AS (SELECT *, rn + (rn >= 2)::INT AS a FROM r), m AS (SELECT *, a + (a >= 5)::INT AS k FROM n) "
    "SELECT o_orderkey, o_orderpriority || '-' || CASE WHEN k < 10 THEN '0' ELSE '' END || k AS name FROM m",
)
def free_names(spark, folder):
    """A free name behind its priority for every order of a customer; 02 and 05 are taken."""
    rows = b.table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.concat("o_orderpriority", F.lit("-")).alias("stem"))
    taken = rows.select("o_custkey", "stem").distinct().select(
        "o_custkey", F.explode(F.array(F.concat("stem", F.lit("02")), F.concat("stem", F.lit("05")))).alias("name"))
    return sampling.next_free(rows, ["o_custkey"], "stem", taken, "o_orderkey", "name").select("o_orderkey", "name")


REFERENCE = "'{\"own\":\"/subscriptions/' || o_custkey || '/resourceGroups/' || %s || '/x\",\"other\":\"/subscriptions/0/resourceGroups/5-LOW/y\"}'"


@query(
    "rewritten_references",
    "SELECT o_orderkey, " + REFERENCE % "CASE o_orderpriority WHEN '5-LOW' THEN CASE WHEN o_custkey = 0 THEN '5-LOW' ELSE 'low-' || o_custkey END "
    "ELSE o_orderpriority END" + " AS json FROM orders",
)
def rewritten_references(spark, folder):
    """References of every order after the low groups of all customers but one got new names."""
    orders = b.table(spark, folder, "orders")
    json = F.concat(
        F.lit('{"own":"/subscriptions/'), "o_custkey", F.lit("/resourceGroups/"), "o_orderpriority",
        F.lit('/x","other":"/subscriptions/0/resourceGroups/5-LOW/y"}'))
    renames = b.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("subscription_id"), F.lit("5-LOW").alias("old_name"),
        F.when(F.col("c_custkey") == 0, "5-LOW").otherwise(F.concat(F.lit("low-"), "c_custkey")).alias("new_name"))
    return renaming.rewrite_column(orders.select("o_orderkey", json.alias("json")), "o_orderkey", "json", renames)


@query(
    "renamed_groups",
    with_views(
        b.DECLARED_GROUPS, audits.CLAIMED,
        "old AS (SELECT owner, token, kept, 'rg-fin-prod-' || token || '-1' || substr(resource_group, 1, 1) AS old_name FROM judged)",
        "moved AS (SELECT *, row_number() OVER (PARTITION BY owner, kept ORDER BY old_name) AS n FROM old "
        "WHERE token NOT IN ('shared', 'core') AND kept <> token)")
    + "SELECT owner AS subscription_id, old_name, 'rg-fin-prod-' || kept || '-0' || n AS new_name FROM moved",
)
def renamed_groups(spark, folder):
    """New names of the groups whose contents do not back their claim."""
    groups = audits.claimed_groups(spark, folder).select(
        F.col("owner").alias("subscription_id"), "token", "type_set",
        F.concat(F.lit("rg-fin-prod-"), "token", F.lit("-1"), F.substring("resource_group", 1, 1)).alias("name"))
    return renaming.confirmed_names(groups)


@query(
    "wired_partners",
    "SELECT count(*) AS n, 0::BIGINT AS strangers, CAST(count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey)) AS BIGINT) AS alone FROM orders",
)
def wired_partners(spark, folder):
    """Every order picks one of its own lines; orders without lines stay alone."""
    lines = b.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("subscription_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.lit("line").alias("type")).distinct()
    orders = b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("subscription_id"), F.col("o_orderkey").alias("id"))
    picked = wiring.pick_partner(orders, wiring.numbered_pool(lines, "line", 5), 5, "partner", "line")
    owner = F.split("line", "-")[0].cast("long")
    return picked.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(owner != F.col("id")).alias("strangers"), F.count_if(F.col("line").isNull()).alias("alone"))
