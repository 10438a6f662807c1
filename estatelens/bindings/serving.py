"""Filter, search, paging, cost, summary and integrity queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from estatelens.functions import periods, text
from estatelens.functions.jsonmaps import json_map
from estatelens.operators import (
    costs, dimensions, governance, integrity, listing, paging, predicates, serving, trigrams,
)
from estatelens.operators.histogram import value_counts
from estatelens.session import scratch_path
from estatelens.sources import bucketed, paged
from . import tables as b
from .registry import ORACLES, query, with_views

TODAY = dt.date(1998, 7, 15)
SINCE, UNTIL = "1997-08-01", "1998-07-15"


def served(spark, folder):
    """Estate rows as a list result shows them."""
    return b.estate_rows(spark, folder).select(
        "id", "name", "type", "subscription_id", "resource_group_name", "tags", "drift_deleted_at", "number")


# --- cost query: AGG-26, JON-05, FIL-11, AGG-27 ---------------------------------------

@query(
    "cost_by_service",
    with_views(b.BILLED)
    + f"SELECT service AS \"ServiceName\", round(sum(cost_amount), 2) AS total FROM costs JOIN billed USING (resource_id) "
    f"WHERE billing_period BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' GROUP BY 1",
)
def cost_by_service(spark, folder):
    """Cost of the last year by service."""
    found = costs.cost_query(
        b.cost_rows(spark, folder), b.billed_parts(spark, folder), "TheLastYear", TODAY,
        [("Dimension", "ServiceName")])
    return found.withColumn("total", F.round("total", 2))


@query(
    "cost_by_group_and_tag",
    with_views(b.BILLED)
    + "SELECT coalesce(resource_group, '') AS \"ResourceGroup\", coalesce(product, '(none)') AS product, round(sum(cost_amount), 2) AS total "
    "FROM costs JOIN billed USING (resource_id) WHERE billing_period BETWEEN DATE '1996-02-01' AND DATE '1997-03-31' "
    "AND lower(resource_group) = 'brand#13' GROUP BY 1, 2",
)
def cost_by_group_and_tag(spark, folder):
    found = costs.cost_query(
        b.cost_rows(spark, folder), b.billed_parts(spark, folder), "Custom", TODAY,
        [("Dimension", "ResourceGroup"), ("Tag", "product")], group="BRAND#13",
        custom=("1996-02-01", "1997-03-31T00:00:00Z"))
    return found.select(
        "ResourceGroup", F.coalesce("product", F.lit("(none)")).alias("product"), F.round("total", 2).alias("total"))


@query(
    "cost_of_owner_last_month",
    with_views(b.BILLED)
    + "SELECT round(sum(cost_amount), 2) AS total FROM costs JOIN billed USING (resource_id) "
    "WHERE billing_period BETWEEN DATE '1998-06-01' AND DATE '1998-06-30' AND subscription_id = '7'",
)
def cost_of_owner_last_month(spark, folder):
    found = costs.cost_query(
        b.cost_rows(spark, folder), b.billed_parts(spark, folder), "TheLastMonth", TODAY, owner="7")
    return found.select(F.round("total", 2).alias("total"))


@query(
    "cost_by_owner_month_to_date",
    with_views(b.BILLED)
    + "SELECT subscription_id AS \"SubscriptionId\", round(sum(cost_amount), 2) AS total FROM costs JOIN billed USING (resource_id) "
    "WHERE billing_period BETWEEN DATE '1998-07-01' AND DATE '1998-07-15' GROUP BY 1",
)
def cost_by_owner_month_to_date(spark, folder):
    """Every owner's cost: a table as long as there are owners, no single answer."""
    found = costs.cost_query(
        b.cost_rows(spark, folder), b.billed_parts(spark, folder), "MonthToDate", TODAY,
        [("Dimension", "SubscriptionId")], max_rows=None)
    return found.withColumn("total", F.round("total", 2))


@query(
    "cost_by_type",
    with_views(b.BILLED)
    + f"SELECT type AS \"ResourceType\", round(sum(cost_amount), 2) AS total FROM costs JOIN billed USING (resource_id) "
    f"WHERE billing_period BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' GROUP BY 1",
)
def cost_by_type(spark, folder):
    found = costs.cost_query(
        b.cost_rows(spark, folder), b.billed_parts(spark, folder), "TheLastYear", TODAY,
        [("Dimension", "ResourceType")])
    return found.withColumn("total", F.round("total", 2))


@query(
    "cost_facts",
    with_views(b.BILLED)
    + "SELECT type, resource_group, CAST(billing_period AS VARCHAR) AS period, count(*) AS n, round(sum(cost_amount), 2) AS cost "
    "FROM costs JOIN billed USING (resource_id) WHERE billing_period BETWEEN DATE '1996-01-01' AND DATE '1996-06-01' "
    "AND subscription_id = '7' GROUP BY ALL",
)
def cost_facts(spark, folder):
    facts = serving.cost_facts(
        b.cost_rows(spark, folder), b.billed_parts(spark, folder), dt.date(1996, 1, 1), dt.date(1996, 6, 1), "7")
    return facts.groupBy("type", "resource_group", F.col("billing_period").cast("string").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_amount"), 2).alias("cost"))


KEY_BYTES = 2000


@query(
    "bounded_document_keys",
    f"SELECT lang, count(*) AS n, CAST(count(*) FILTER (octet_length(encode(text)) > {KEY_BYTES}) AS BIGINT) AS too_long, "
    f"count(DISTINCT CASE WHEN octet_length(encode(text)) <= {KEY_BYTES} THEN text END) AS keys FROM documents GROUP BY 1",
)
def bounded_document_keys(spark, folder):
    key, over = costs.bounded_key(F.col("text"), KEY_BYTES)
    kept = b.table(spark, folder, "documents").groupBy("lang", key.alias("key"), over.alias("over")).agg(
        F.count(F.lit(1)).alias("n"))
    return kept.groupBy("lang").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("over"), F.col("n"))), F.lit(0)).alias("too_long"),
        F.count("key").alias("keys"))


# --- filters: FIL-01..13 --------------------------------------------------------------

@query(
    "filtered_by_tree",
    with_views(b.ESTATE)
    + "SELECT id FROM estate WHERE NOT hidden AND ((type = 'Microsoft.Web/sites' AND environment = 'production') "
    "OR (type = 'Microsoft.KeyVault/vaults' AND environment IS NOT NULL AND priority = '5-LOW'))",
)
def filtered_by_tree(spark, folder):
    tree = (
        "or",
        ("and", ("eq", "type", "Microsoft.Web/sites"), ("tag", "environment", "production")),
        ("and", ("eq", "type", "Microsoft.KeyVault/vaults"), ("tag_exists", "environment"), ("tag", "priority", "5-LOW")))
    return predicates.visible(served(spark, folder)).where(predicates.where_tree(tree)).select("id")


@query("visible_rows", with_views(b.ESTATE) + "SELECT type, count(*) AS n FROM estate WHERE NOT hidden GROUP BY 1")
def visible_rows(spark, folder):
    return value_counts(predicates.visible(served(spark, folder)), "type")


@query(
    "rows_in_group_any_case",
    with_views(b.ESTATE)
    + "SELECT id, name FROM estate WHERE NOT hidden AND lower(resource_group_name) = '2-high' AND subscription_id = '7'",
)
def rows_in_group_any_case(spark, folder):
    rows = predicates.visible(served(spark, folder)).where(F.col("subscription_id") == "7")
    return rows.where(predicates.same_text("resource_group_name", "2-High")).select("id", "name")


@query(
    "row_by_id_any_case",
    with_views(b.ESTATE)
    + "SELECT id, type FROM estate WHERE lower(id) = lower('/SUBSCRIPTIONS/' || (SELECT o_custkey FROM orders WHERE o_orderkey = 42) || "
    "'/resourcegroups/' || (SELECT o_orderpriority FROM orders WHERE o_orderkey = 42) || '/providers/microsoft.keyvault/vaults/res-42')",
)
def row_by_id_any_case(spark, folder):
    rows = served(spark, folder)
    wanted = rows.where(F.col("number") == 42).select(F.upper("id")).scalar()
    return rows.where(F.lower("id") == F.lower(wanted)).select("id", "type")


@query(
    "search_rows",
    with_views(b.ESTATE)
    + "SELECT id FROM estate JOIN customer ON o_custkey = c_custkey WHERE NOT hidden AND "
    "(contains(lower(name), 'es-12') OR contains(lower(type), 'es-12') OR contains(lower(c_name), 'es-12'))",
)
def search_rows(spark, folder):
    return predicates.search(
        predicates.visible(served(spark, folder)), b.estate_owners(spark, folder), "ES-12*").select("id")


@query(
    "search_by_owner_name",
    with_views(b.ESTATE)
    + "SELECT id FROM estate JOIN customer ON o_custkey = c_custkey WHERE "
    "(contains(lower(name), 'er#00000001') OR contains(lower(type), 'er#00000001') OR contains(lower(c_name), 'er#00000001'))",
)
def search_by_owner_name(spark, folder):
    return predicates.search(served(spark, folder), b.estate_owners(spark, folder), "er#00000001").select("id")


@query(
    "indexed_search",
    with_views(b.ESTATE)
    + "SELECT id FROM estate JOIN customer ON o_custkey = c_custkey WHERE NOT hidden AND "
    "(contains(lower(name), 'es-12') OR contains(lower(type), 'es-12') OR contains(lower(c_name), 'es-12'))",
)
def indexed_search(spark, folder):
    """The search through an index written beside the rows."""
    path, columns = scratch_path(spark, "search"), ["name", "type", "display_name"]
    rows = predicates.visible(served(spark, folder)).join(b.estate_owners(spark, folder).select("subscription_id", "display_name"), "subscription_id", "left")
    trigrams.write_index(rows.select("id", *columns), path, columns, "id")
    return trigrams.search(spark, path, "ES-12*", columns).select("id")


OWNED = "owned AS (SELECT v.*, e.subscription_id FROM violations v LEFT JOIN (SELECT name, subscription_id FROM estate) e ON v.resource_id = e.name)"


def owned_violations(spark, folder):
    owners = b.estate_rows(spark, folder).select(F.col("name").alias("id"), "subscription_id")
    return serving.violations_with_owner(b.violation_rows(spark, folder), owners)


@query(
    "violations_with_owner",
    with_views(b.ESTATE, b.VIOLATIONS, OWNED)
    + "SELECT id, violation_type, severity, coalesce(subscription_id, '(gone)') AS owner FROM owned",
)
def violations_with_owner(spark, folder):
    return owned_violations(spark, folder).select(
        "id", "violation_type", "severity", F.coalesce("subscription_id", F.lit("(gone)")).alias("owner"))


@query(
    "filtered_violations",
    with_views(b.ESTATE, b.VIOLATIONS, OWNED)
    + "SELECT id, resource_id FROM owned WHERE violation_type = 'ERROR' AND severity = 'Medium' AND subscription_id IS NOT NULL",
)
def filtered_violations(spark, folder):
    rows = owned_violations(spark, folder).where(predicates.violation_filter(code="error", severity="medium"))
    return rows.where(F.col("subscription_id").isNotNull()).select("id", "resource_id")


@query(
    "filtered_edges",
    with_views(b.EDGES)
    + "SELECT *, source_subscription <> target_subscription AS cross_subscription FROM edges "
    "WHERE (source_subscription = 3 OR target_subscription = 3) AND lower(dependency_type) = 'r'",
)
def filtered_edges(spark, folder):
    return predicates.edges(b.edge_rows(spark, folder), 3, "r")


ROLES = {"1-URGENT": "Owner", "2-HIGH": "Contributor", "3-MEDIUM": "Reader", "4-NOT SPECIFIED": "Reader", "5-LOW": "Owner"}
ASSIGNED = """
assigned AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS subscription_id, 'p-' || (o_orderkey % 400) AS principal_oid,
  CASE o_orderkey % 3 WHEN 0 THEN 'ServicePrincipal' WHEN 1 THEN 'User' ELSE 'Group' END AS principal_type,
  '/providers/Microsoft.Authorization/roleDefinitions/' || CASE o_orderpriority
    WHEN '2-HIGH' THEN 'b24988ac-6180-42a0-ab88-20f7382dd24c' WHEN '3-MEDIUM' THEN 'acdd72a7-3385-48ef-bd42-f606fba81ae7'
    WHEN '4-NOT SPECIFIED' THEN 'acdd72a7-3385-48ef-bd42-f606fba81ae7' ELSE '8e3af657-bb00-4899-acbc-f0f7f5db61aa' END AS role_definition_id,
  '/subscriptions/' || CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey END || CASE o_orderkey % 4 WHEN 0 THEN '' ELSE '/resourceGroups/' || o_orderpriority END AS scope
  FROM orders)
"""


def assignment_rows(spark, folder):
    key = F.col("o_orderkey")
    owner = F.col("o_custkey").cast("string")
    role = F.lit(None).cast("string")
    for priority, name in ROLES.items():
        role = F.when(F.col("o_orderpriority") == priority, governance.t.ROLE_PREFIX + governance.t.ROLES[name]).otherwise(role)
    at = F.when(key % 11 == 0, "-1").otherwise(owner)
    return b.table(spark, folder, "orders").select(
        key.cast("string").alias("assignment_id"), owner.alias("subscription_id"),
        F.concat(F.lit("p-"), key % 400).alias("principal_oid"),
        F.when(key % 3 == 0, "ServicePrincipal").when(key % 3 == 1, "User").otherwise("Group").alias("principal_type"),
        role.alias("role_definition_id"),
        F.concat(
            F.lit("/subscriptions/"), at,
            F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("/resourceGroups/"), "o_orderpriority"))).alias("scope"))


@query(
    "assignments_at_scope",
    with_views(ASSIGNED)
    + "SELECT CAST(o_orderkey AS VARCHAR) AS assignment_id, principal_oid FROM assigned "
    "WHERE subscription_id = '7' AND scope = '/subscriptions/7'",
)
def assignments_at_scope(spark, folder):
    return predicates.assignments(assignment_rows(spark, folder), "7", at_scope=True).select("assignment_id", "principal_oid")


@query(
    "assignment_listing",
    with_views(ASSIGNED)
    + "SELECT scope || '/providers/Microsoft.Authorization/roleAssignments/' || o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS name, "
    "'Microsoft.Authorization/roleAssignments' AS type, '/subscriptions/' || subscription_id || role_definition_id AS role_definition_id, "
    "principal_oid AS principal_id, principal_type, scope FROM assigned",
)
def assignment_listing(spark, folder):
    return predicates.assignment_rows(assignment_rows(spark, folder))


def sql_uuid(text):
    """The hex digits of a text's MD5 in the groups of a UUID."""
    cuts = ", '-', ".join(f"substr(md5({text}), {start}, {n})" for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat({cuts})"


AFTER = "10000000-0000-0000-0000-000000000000"
UUID_PAGE = f"""
page AS (SELECT {sql_uuid("CAST(o_orderkey AS VARCHAR)")} AS name, principal_oid AS principal_id, scope
  FROM assigned WHERE subscription_id = (SELECT CAST(min(o_custkey) AS VARCHAR) FROM orders)),
ahead AS (SELECT *, row_number() OVER (ORDER BY name) AS i, count(*) OVER () AS left_over FROM page WHERE name > '{AFTER}')
"""


@query(
    "assignment_page",
    with_views(ASSIGNED, UUID_PAGE)
    + "SELECT name, principal_id, scope, CASE WHEN left_over > 5 THEN (SELECT max(name) FROM ahead WHERE i <= 5) ELSE '' END AS next_after "
    "FROM ahead WHERE i <= 5",
)
def assignment_page(spark, folder):
    """The assignments of the first owner behind a UUID, five to a page."""
    rows = assignment_rows(spark, folder).withColumn("assignment_id", F.expr(sql_uuid("assignment_id")))
    owner = b.table(spark, folder, "orders").agg(F.min("o_custkey")).first()[0]
    return predicates.assignment_page(rows, str(owner), AFTER.upper(), 5).select(
        "name", "principal_id", "scope", F.coalesce("next_after", F.lit("")).alias("next_after"))


@query(
    "owner_listing",
    "SELECT '/subscriptions/' || c_custkey AS id, CAST(c_custkey AS VARCHAR) AS subscription_id, c_name AS display_name, "
    "CASE WHEN c_acctbal < 0 THEN 'Disabled' ELSE 'Enabled' END AS state, 'tenant-' || c_nationkey AS tenant_id, "
    "'RoleBased' AS authorization_source, 'Off' AS spending_limit FROM customer",
)
def owner_listing(spark, folder):
    owners = b.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("subscription_id"), F.col("c_name").alias("display_name"),
        F.when(F.col("c_acctbal") < 0, "Disabled").otherwise("Enabled").alias("state"),
        F.concat(F.lit("tenant-"), "c_nationkey").alias("tenant_id"), F.lit("RoleBased").alias("authorization_source"),
        F.lit("Off").alias("spending_limit"))
    return listing.owner_rows(owners)


@query(
    "group_listing",
    "SELECT DISTINCT '/subscriptions/' || o_custkey || '/resourceGroups/' || o_orderpriority AS id, o_orderpriority AS name, "
    "'Microsoft.Resources/resourceGroups' AS type, 'eastus' AS location, '{}' AS tags, '{\"provisioningState\":\"Succeeded\"}' AS properties FROM orders",
)
def group_listing(spark, folder):
    groups = b.estate_groups(spark, folder).withColumns({
        "location": F.lit("eastus"), "tags": F.lit("{}"), "provisioning_state": F.lit("Succeeded")})
    return listing.group_rows(groups)


@query(
    "resource_listing",
    with_views(b.BILLED)
    + "SELECT resource_id AS id, p_name AS name, CASE lower(type) WHEN 'microsoft.compute/disks' THEN 'Microsoft.Compute/disks' ELSE type END AS type, "
    "'eastus' AS location, '{}' AS tags, '(none)' AS sku, '(none)' AS kind, CASE p_size % 3 WHEN 0 THEN '{\"a\":1}' ELSE '{}' END AS properties "
    "FROM billed JOIN part ON p_partkey = resource_id",
)
def resource_listing(spark, folder):
    sizes = b.table(spark, folder, "part").select(F.col("p_partkey").alias("resource_id"), "p_name", "p_size")
    rows = b.billed_parts(spark, folder).drop("tags").join(sizes, "resource_id").select(
        F.col("resource_id").alias("id"), F.col("p_name").alias("name"), "type", F.lit("eastus").alias("location"),
        F.lit("{}").alias("tags"), F.lit(None).cast("string").alias("sku"), F.lit(None).cast("string").alias("kind"),
        F.when(F.col("p_size") % 3 == 0, '{"a":1}').when(F.col("p_size") % 3 == 1, "null").alias("properties"))
    return listing.resource_rows(rows).na.fill("(none)", ["sku", "kind"])


@query(
    "over_privileged",
    with_views(ASSIGNED)
    + "SELECT CAST(count(*) FILTER (principal_type = 'ServicePrincipal') AS BIGINT) AS owner_service_principals, "
    "CAST(count(*) FILTER (scope = '/subscriptions/' || subscription_id) AS BIGINT) AS owner_at_owner_scope "
    "FROM assigned WHERE role_definition_id LIKE '%8e3af657%'",
)
def over_privileged(spark, folder):
    return governance.over_privileged(assignment_rows(spark, folder))


@query(
    "scoped_read",
    with_views(b.ESTATE)
    + "SELECT id, type FROM estate WHERE NOT hidden AND subscription_id = '7' "
    "AND type IN ('Microsoft.Web/sites', 'Microsoft.KeyVault/vaults', 'Microsoft.Sql/servers')",
)
def scoped_read(spark, folder):
    return predicates.scoped_read(
        served(spark, folder), "7", ["Microsoft.Web/sites", "Microsoft.KeyVault/vaults", "Microsoft.Sql/servers"]
    ).select("id", "type")


@query(
    "canonical_namespaces",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Microsoft.' ELSE CASE p_partkey % 3 WHEN 1 THEN 'Microsoft.' ELSE 'Contoso.' END END "
    "|| p_brand || '/' || p_type AS type FROM part",
)
def canonical_namespaces(spark, folder):
    prefix = F.element_at(F.array(F.lit("MICROSOFT."), F.lit("microsoft."), F.lit("Contoso.")), (F.col("p_partkey") % 3 + 1).cast("int"))
    stored = F.concat(prefix, "p_brand", F.lit("/"), "p_type")
    return b.table(spark, folder, "part").select("p_partkey", text.canonical_namespace(stored).alias("type"))


@query(
    "spelled_types",
    with_views(b.BILLED)
    + "SELECT resource_id, CASE lower(type) WHEN 'microsoft.compute/disks' THEN 'Microsoft.Compute/disks' ELSE type END AS type FROM billed",
)
def spelled_types(spark, folder):
    return dimensions.with_spelling(b.billed_parts(spark, folder), "type", "spelled").select(
        "resource_id", F.col("spelled").alias("type"))


@query("services", with_views(b.BILLED) + "SELECT resource_id, service FROM billed")
def services(spark, folder):
    return dimensions.with_service(b.billed_parts(spark, folder), "type", "service").select("resource_id", "service")


@query(
    "typed_values",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'httpsOnly' WHEN 1 THEN 'diskSizeGB' ELSE 'name' END AS field, "
    "CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END "
    "WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '(null)' ELSE '\"' || p_name || '\"' END AS json FROM part",
)
def typed_values(spark, folder):
    kind = F.col("p_partkey") % 4
    field = F.when(kind == 0, "httpsOnly").when(kind == 1, "diskSizeGB").otherwise("name")
    label = (
        F.when(kind == 0, F.when(F.col("p_size") > 25, "true").otherwise("false"))
        .when(kind == 1, F.col("p_size").cast("string")).when(kind == 2, "null").otherwise(F.col("p_name")))
    return b.table(spark, folder, "part").select(
        "p_partkey", field.alias("field"),
        F.coalesce(text.typed_value(field, label), F.lit("(null)")).alias("json"))


@query(
    "resource_paths",
    "SELECT p_partkey, '/subscriptions/' || (p_partkey % 9) || '/resourceGroups/rg-' || p_size || '/providers/Microsoft.A/' || "
    "CASE p_partkey % 3 WHEN 0 THEN 'b/' || p_name WHEN 1 THEN 'b/top/c/' || p_name ELSE 'b/top/c/' || p_name || '/d/' || p_name END AS path FROM part",
)
def resource_paths(spark, folder):
    depth = F.col("p_partkey") % 3
    type_name = F.when(depth == 0, "microsoft.A/b").when(depth == 1, "microsoft.A/b/c").otherwise("microsoft.A/b/c/d")
    return b.table(spark, folder, "part").select(
        "p_partkey",
        text.resource_path(
            (F.col("p_partkey") % 9).cast("string"), F.concat(F.lit("rg-"), "p_size"), type_name, "p_name", F.lit("top")).alias("path"))


@query(
    "group_tokens",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '?' WHEN o_orderkey % 4 = 1 THEN 'web-app' "
    "WHEN o_orderkey % 4 = 2 THEN lower(o_orderstatus) ELSE '' END AS token FROM orders",
)
def group_tokens(spark, folder):
    kind, number = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    name = (
        F.when(kind == 0, F.concat(F.lit("plain-a-b-c-"), number))
        .when(kind == 1, F.concat(F.lit("rg-fin-prod-web-app-"), number))
        .when(kind == 2, F.concat_ws("-", F.lit("rg-hr-dev"), F.lower("o_orderstatus"), number))
        .otherwise(F.concat(F.lit("rg-hr-dev-"), number)))
    return b.table(spark, folder, "orders").select("o_orderkey", text.group_token(name).alias("token"))


@query(
    "ancestor_types",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ns/' || p_type || ',ns/' || p_type || '/' || p_brand || ',ns/' || p_type || '/' || p_brand || '/x' "
    "ELSE 'ns/' || p_type END AS types FROM part",
)
def ancestor_types(spark, folder):
    nested = F.concat(F.lit("ns/"), "p_type", F.lit("/"), "p_brand", F.lit("/x"))
    types = F.when(F.col("p_size") % 2 == 0, F.array(nested)).otherwise(F.array(F.concat(F.lit("ns/"), "p_type")))
    return b.table(spark, folder, "part").select(
        "p_partkey", F.array_join(text.with_ancestor_types(types), ",").alias("types"))


@query(
    "billing_periods",
    "WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS ref FROM orders) "
    "SELECT strftime(ref, '%Y-%m') AS ref, 'month' AS grain, CAST(CAST(unnest(generate_series(ref - INTERVAL 11 MONTH, ref, INTERVAL 1 MONTH)) AS DATE) AS VARCHAR) AS period FROM m "
    "UNION ALL SELECT strftime(ref, '%Y-%m'), 'day', CAST(CAST(unnest(generate_series(ref, ref + INTERVAL 19 DAY, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) FROM m",
)
def billing_periods(spark, folder):
    months = b.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d"))
    months = months.select(F.trunc("d", "month").alias("ref")).distinct()
    grains = F.explode(F.create_map(
        F.lit("month"), periods.month_periods("ref"), F.lit("day"), periods.day_periods("ref", 20))).alias("grain", "days")
    return (
        months.select(F.date_format("ref", "yyyy-MM").alias("ref"), grains)
        .select("ref", "grain", F.explode("days").alias("day"))
        .select("ref", "grain", F.col("day").cast("string").alias("period")))


# --- roll-ups and paging: JON-07, AGG-28, 29, PAG-01..05, SET-02, AGG-42 ---------------

@query(
    "owner_rollup",
    "WITH r AS (SELECT o_custkey AS k, count(*) AS c FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY 1), "
    "g AS (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS c FROM orders GROUP BY 1), "
    "v AS (SELECT o_custkey AS k, count(*) AS c FROM events JOIN orders ON o_orderkey = (event_id * 7) % 20011 GROUP BY 1) "
    "SELECT CAST(c_custkey AS VARCHAR) AS subscription_id, coalesce(r.c, 0) AS resource_count, coalesce(g.c, 0) AS group_count, "
    "coalesce(v.c, 0) AS violation_count FROM customer LEFT JOIN r ON r.k = c_custkey LEFT JOIN g ON g.k = c_custkey LEFT JOIN v ON v.k = c_custkey",
)
def owner_rollup(spark, folder):
    return serving.owner_rollup(b.estate_owners(spark, folder).select("subscription_id"), owner_metrics(spark, folder))


def owner_metrics(spark, folder):
    return {
        "resource_count": predicates.visible(served(spark, folder)),
        "group_count": b.estate_groups(spark, folder),
        "violation_count": owned_violations(spark, folder).where(F.col("subscription_id").isNotNull()),
    }


def stored_by(spark, key, tables):
    folder = scratch_path(spark, "bucketed")
    bucketed.write_bucketed(tables, folder, key)
    return bucketed.read_bucketed(spark, folder)


@query("stored_rollup", ORACLES["owner_rollup"])
def stored_rollup(spark, folder):
    """The roll-up from tables in buckets of owners."""
    metrics = {name: df.select("subscription_id") for name, df in owner_metrics(spark, folder).items()}
    parts = stored_by(spark, "subscription_id", {"owners": b.estate_owners(spark, folder).select("subscription_id"), **metrics})
    return bucketed.on_both(parts, lambda t: serving.owner_rollup(t["owners"], {m: t[m] for m in metrics}))


@query("stored_cost_facts", ORACLES["cost_facts"])
def stored_cost_facts(spark, folder):
    """Cost rows with their resource, from tables in buckets of resources."""
    parts = stored_by(spark, "resource_id", {"costs": b.cost_rows(spark, folder), "resources": b.billed_parts(spark, folder)})
    facts = bucketed.on_both(
        parts, lambda t: serving.cost_facts(t["costs"], t["resources"], dt.date(1996, 1, 1), dt.date(1996, 6, 1), "7"))
    return facts.groupBy("type", "resource_group", F.col("billing_period").cast("string").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_amount"), 2).alias("cost"))


@query("stored_violations", ORACLES["violations_with_owner"])
def stored_violations(spark, folder):
    """Violations with their owner, from tables in buckets of resources."""
    owners = b.estate_rows(spark, folder).select(F.col("name").alias("resource_id"), "subscription_id")
    parts = stored_by(spark, "resource_id", {"violations": b.violation_rows(spark, folder), "resources": owners})
    found = bucketed.on_both(
        parts, lambda t: serving.violations_with_owner(t["violations"], t["resources"].withColumnRenamed("resource_id", "id")))
    return found.select("id", "violation_type", "severity", F.coalesce("subscription_id", F.lit("(gone)")).alias("owner"))


SUMMARY = """
r AS (SELECT subscription_id AS k, count(*) AS c FROM estate WHERE NOT hidden GROUP BY 1),
g AS (SELECT subscription_id AS k, count(DISTINCT resource_group_name) AS c FROM estate GROUP BY 1),
v AS (SELECT subscription_id AS k, count(*) AS c FROM owned WHERE subscription_id IS NOT NULL GROUP BY 1),
roll AS (SELECT CAST(c_custkey AS VARCHAR) AS k, coalesce(r.c, 0) AS rc, coalesce(g.c, 0) AS gc, coalesce(v.c, 0) AS vc
  FROM customer LEFT JOIN r ON r.k = CAST(c_custkey AS VARCHAR) LEFT JOIN g ON g.k = CAST(c_custkey AS VARCHAR)
  LEFT JOIN v ON v.k = CAST(c_custkey AS VARCHAR)),
ranked AS (SELECT *, row_number() OVER (ORDER BY rc DESC, k) AS rank FROM roll QUALIFY rank <= 500),
types AS (SELECT type AS key, count(*) AS n FROM estate WHERE NOT hidden GROUP BY 1),
places AS (SELECT resource_group_name AS key, count(*) AS n FROM estate WHERE NOT hidden GROUP BY 1)
"""


@query(
    "estate_summary",
    with_views(b.ESTATE, b.VIOLATIONS, OWNED, SUMMARY)
    + """SELECT 'totals' AS section, 0::BIGINT AS rank, 'subscriptions' AS key, (SELECT count(*) FROM customer) AS n
UNION ALL SELECT 'totals', 0, 'resource_groups', (SELECT count(*) FROM (SELECT DISTINCT subscription_id, resource_group_name FROM estate))
UNION ALL SELECT 'totals', 0, 'resources', (SELECT count(*) FROM estate WHERE NOT hidden)
UNION ALL SELECT 'totals', 0, 'violations', (SELECT count(*) FROM violations)
UNION ALL SELECT 'totals', 0, 'dependencies', (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'by_type', row_number() OVER (ORDER BY n DESC, key), key, n FROM types
UNION ALL SELECT 'by_location', row_number() OVER (ORDER BY n DESC, key), key, n FROM places
UNION ALL SELECT 'owner_resource_count', rank, k, rc FROM ranked
UNION ALL SELECT 'owner_group_count', rank, k, gc FROM ranked
UNION ALL SELECT 'owner_violation_count', rank, k, vc FROM ranked""",
)
def estate_summary(spark, folder):
    seen = predicates.visible(served(spark, folder))
    tables = {
        "subscriptions": b.estate_owners(spark, folder),
        "resource_groups": b.estate_groups(spark, folder),
        "resources": seen,
        "violations": b.violation_rows(spark, folder),
        "dependencies": b.table(spark, folder, "lineitem"),
    }
    rows = seen.withColumn("location", F.col("resource_group_name"))
    return serving.summary(tables, rows, owner_metrics(spark, folder)).withColumn("rank", F.col("rank").cast("long"))


@query(
    "violation_page",
    with_views(b.ESTATE, b.VIOLATIONS, OWNED)
    + "SELECT id, severity, total, next_after FROM (SELECT id, severity, (SELECT count(*) FROM owned WHERE violation_type = 'CLICK') AS total, "
    "(SELECT max(id) FROM (SELECT id FROM owned WHERE violation_type = 'CLICK' AND id > 500 ORDER BY id LIMIT 25)) AS next_after "
    "FROM owned WHERE violation_type = 'CLICK' AND id > 500 ORDER BY id LIMIT 25)",
)
def violation_page(spark, folder):
    return paging.page_with_total(
        owned_violations(spark, folder), predicates.violation_filter(code="click"), "id", 500, 25
    ).select("id", "severity", "total", "next_after")


@query(
    "order_page",
    "SELECT o_orderkey, o_totalprice, (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 700 ORDER BY 1 LIMIT 100)) AS next_after "
    "FROM orders WHERE o_orderkey > 700 ORDER BY 1 LIMIT 100",
)
def order_page(spark, folder):
    rows = b.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return paging.page(rows, "o_orderkey", 700, 100)


@query(
    "text_key_page",
    with_views(b.ESTATE)
    + "SELECT id, (SELECT max(id) FROM (SELECT id FROM estate WHERE NOT hidden AND id > '/subscriptions/12/' ORDER BY id LIMIT 50)) AS next_after "
    "FROM estate WHERE NOT hidden AND id > '/subscriptions/12/' ORDER BY id LIMIT 50",
)
def text_key_page(spark, folder):
    return paging.page(predicates.visible(served(spark, folder)).select("id"), "id", "/subscriptions/12/", 50)


@query(
    "indexed_page",
    with_views(b.ESTATE)
    + "SELECT id, (SELECT max(id) FROM (SELECT id FROM estate WHERE NOT hidden AND id > '/subscriptions/12/' ORDER BY id LIMIT 50)) AS next_after, "
    "(SELECT count(*) FROM estate WHERE NOT hidden AND id > '/subscriptions/12/') AS behind "
    "FROM estate WHERE NOT hidden AND id > '/subscriptions/12/' ORDER BY id LIMIT 50",
)
def indexed_page(spark, folder):
    """The page of a table written in ranges of its key, with how many rows lie behind the cursor."""
    path, after = scratch_path(spark, "paged"), "/subscriptions/12/"
    paged.write_paged(predicates.visible(served(spark, folder)).select("id"), path, "id")
    behind = paged.rows_behind(spark, path, "id", after)
    return paged.paged(spark, path, "id", after, 50).withColumn("behind", F.lit(behind).cast("long"))


@query(
    "indexed_groups_preview",
    "SELECT name, subscription_id FROM (SELECT DISTINCT o_orderpriority AS name, CAST(o_custkey AS VARCHAR) AS subscription_id FROM orders) "
    "WHERE contains(lower(name), 'high') ORDER BY 1, 2 LIMIT 50",
)
def indexed_groups_preview(spark, folder):
    """The first matching groups, range by range of a table kept in their order."""
    path = scratch_path(spark, "paged")
    groups = b.estate_groups(spark, folder).select("name", "subscription_id", F.struct("name", "subscription_id").alias("place"))
    paged.write_paged(groups, path, "place")
    found = paged.first_matching(spark, path, "place", predicates.holds_term("name", "HIGH"), paging.PREVIEW_MATCHES)
    return found.select("name", "subscription_id")


@query(
    "owner_preview",
    "WITH r AS (SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY 1) "
    "SELECT CAST(c_custkey AS VARCHAR) AS subscription_id, coalesce(c, 0) AS resource_count FROM customer LEFT JOIN r ON k = c_custkey "
    "ORDER BY 2 DESC, 1 LIMIT 500",
)
def owner_preview(spark, folder):
    rollup = serving.owner_rollup(
        b.estate_owners(spark, folder).select("subscription_id"), {"resource_count": served(spark, folder)})
    return serving.owner_preview(rollup, "resource_count")


@query(
    "matching_groups_preview",
    "SELECT name, subscription_id FROM (SELECT DISTINCT o_orderpriority AS name, CAST(o_custkey AS VARCHAR) AS subscription_id FROM orders) "
    "WHERE contains(lower(name), 'high') ORDER BY 1, 2 LIMIT 50",
)
def matching_groups_preview(spark, folder):
    groups = b.estate_groups(spark, folder).where(predicates.holds_term("name", "HIGH")).select("name", "subscription_id")
    return paging.preview(groups, [F.asc("name"), F.asc("subscription_id")], paging.PREVIEW_MATCHES)


@query(
    "busiest_supplier",
    "WITH k AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) "
    "SELECT l_suppkey, k.n AS key_rows, l_returnflag, count(*) AS inner_rows FROM lineitem JOIN k USING (l_suppkey) "
    "GROUP BY 1, 2, 3 ORDER BY 4 DESC, 3 LIMIT 1",
)
def busiest_supplier(spark, folder):
    return serving.busiest(b.table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag")


@query(
    "id_coverage",
    "WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) "
    "SELECT CAST(count(*) FILTER (a.k IS NOT NULL AND o_orderkey IS NOT NULL) AS BIGINT) AS in_both, "
    "CAST(count(*) FILTER (o_orderkey IS NULL) AS BIGINT) AS left_only, CAST(count(*) FILTER (a.k IS NULL) AS BIGINT) AS right_only, "
    "CAST(count(*) FILTER (a.n > 1) AS BIGINT) AS repeated FROM a FULL JOIN orders ON a.k = o_orderkey",
)
def id_coverage(spark, folder):
    return integrity.same_ids(
        b.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k")),
        b.table(spark, folder, "orders").select(F.col("o_orderkey").alias("k")), "k")


@query(
    "count_vector",
    "SELECT 'customer' AS \"table\", count(*) AS n, count(DISTINCT c_custkey) AS expected, true AS ok FROM customer "
    "UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), false FROM orders "
    "UNION ALL SELECT 'supplier', count(*), 0, count(*) >= 1 FROM supplier",
)
def count_vector(spark, folder):
    def t(name):
        return b.table(spark, folder, name)

    def distinct(name, key):
        return t(name).agg(F.count_distinct(key).alias("n")).select(F.lit(name).alias("table"), "n")

    expected = distinct("customer", "c_custkey").union(distinct("orders", "o_custkey")).union(
        spark.range(1).select(F.lit("supplier").alias("table"), F.lit(0).cast("long").alias("n")))
    actual = serving.totals({name: t(name) for name in ("customer", "orders", "supplier")})
    return serving.compare_counts(actual, expected, {"supplier": 1})


@query(
    "estate_metadata",
    "SELECT 'tenant-' || min(o_custkey) AS tenant_id, 'demo' AS profile_name, CAST(sum(o_orderkey) AS BIGINT) AS seed FROM orders",
)
def estate_metadata(spark, folder):
    tenant = b.table(spark, folder, "orders").agg(
        F.concat(F.lit("tenant-"), F.min("o_custkey")).alias("tenant_id"), F.lit("demo").alias("profile_name"),
        F.to_json(F.struct(F.sum("o_orderkey").alias("seed"))).alias("scale_params"))
    return serving.estate_metadata(tenant)


# --- integrity: CHK-01, CHK-02, JON-09, JON-13 ----------------------------------------

# Rows that others refer to in vain are kept under a key of their own.
APART = 1_000_000_000
NODES = (
    f"nodes AS (SELECT 'part-' || (p_partkey + CASE WHEN p_size = 17 THEN {APART} ELSE 0 END) AS id FROM part "
    f"UNION ALL SELECT 'supplier-' || (s_suppkey + CASE WHEN s_nationkey = 4 THEN {APART} ELSE 0 END) FROM supplier)")


def moved(key, where):
    return F.col(key) + F.when(where, APART).otherwise(0)


def node_rows(spark, folder):
    parts = b.table(spark, folder, "part").select(F.concat(F.lit("part-"), moved("p_partkey", F.col("p_size") == 17)).alias("id"))
    return parts.union(b.table(spark, folder, "supplier").select(F.concat(F.lit("supplier-"), moved("s_suppkey", F.col("s_nationkey") == 4))))


@query(
    "dangling_edges",
    with_views(b.EDGES, NODES)
    + "SELECT * FROM edges WHERE source_resource_id NOT IN (SELECT id FROM nodes) OR target_resource_id NOT IN (SELECT id FROM nodes)",
)
def dangling_edges(spark, folder):
    return integrity.dangling(b.edge_rows(spark, folder), node_rows(spark, folder))


@query(
    "dangling_scopes",
    with_views(ASSIGNED)
    + "SELECT CAST(o_orderkey AS VARCHAR) AS assignment_id, 'scope' AS reason FROM assigned WHERE scope NOT IN ("
    "SELECT '/subscriptions/' || c_custkey FROM customer UNION ALL SELECT '/subscriptions/' || o_custkey || '/resourceGroups/' || o_orderpriority FROM orders) "
    f"UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'principal' FROM assigned WHERE principal_oid NOT IN (SELECT 'p-' || (c_custkey + CASE WHEN c_mktsegment = 'BUILDING' THEN {APART} ELSE 0 END) FROM customer)",
)
def dangling_scopes(spark, folder):
    principals = b.table(spark, folder, "customer").select(F.concat(F.lit("p-"), moved("c_custkey", F.col("c_mktsegment") == "BUILDING")).alias("oid"))
    return integrity.dangling_scopes(
        assignment_rows(spark, folder), principals, b.estate_owners(spark, folder), b.estate_groups(spark, folder),
        b.estate_rows(spark, folder)).select("assignment_id", "reason")


@query(
    "removable_rows",
    "SELECT '/c/' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_nationkey <> 3 "
    "UNION ALL SELECT '/c/' || o_custkey || '/o/' || o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) "
    "UNION ALL SELECT DISTINCT '/c/' || o_custkey || CASE WHEN l_quantity > 25 THEN '/o/' ELSE '/z/' END || o_orderkey || '/l/' || l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def removable_rows(spark, folder):
    """Lines of small quantity hang beside their order, so some orders have nothing below."""
    customers, orders = b.table(spark, folder, "customer"), b.table(spark, folder, "orders")
    order_path = F.concat(F.lit("/c/"), "o_custkey", F.lit("/o/"), "o_orderkey")
    lines = b.table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    place = F.when(F.col("l_quantity") > 25, "/o/").otherwise("/z/")
    line_path = F.concat(F.lit("/c/"), "o_custkey", place, "o_orderkey", F.lit("/l/"), "l_linenumber")
    rows = (
        customers.select(F.concat(F.lit("/c/"), "c_custkey").alias("id"))
        .union(orders.select(order_path))
        .union(lines.select(line_path).distinct()))
    references = [
        customers.where("c_nationkey = 3").select(F.concat(F.lit("/c/"), "c_custkey")),
        orders.where("o_orderstatus = 'F'").select(order_path),
    ]
    return integrity.removable(rows, references)


LOCKS = "SELECT o_custkey, o_orderpriority, 'n-' || (o_orderkey % 20) AS name FROM orders WHERE o_orderstatus = 'F'"


@query(
    "items_without_lock",
    "SELECT DISTINCT o_custkey, o_orderpriority, 'n-' || (o_orderkey % 20) AS name FROM orders WHERE o_orderstatus <> 'F' "
    f"EXCEPT {LOCKS}",
)
def items_without_lock(spark, folder):
    orders = b.table(spark, folder, "orders").withColumn("name", F.concat(F.lit("n-"), F.col("o_orderkey") % 20))
    scope = ["o_custkey", "o_orderpriority"]
    items = orders.where("o_orderstatus <> 'F'").select(*scope, "name").distinct()
    locks = orders.where("o_orderstatus = 'F'").withColumn("name", F.concat("name", F.lit("-lock")))
    return integrity.missing_sibling(items, locks, scope, "name").drop("expected_name")


@query(
    "referenced_ids",
    "SELECT DISTINCT 'nic-' || l_suppkey AS id FROM lineitem WHERE l_linenumber % 3 = 0 UNION SELECT DISTINCT 'disk-' || (l_partkey % 100) FROM lineitem WHERE l_linenumber % 3 = 0 "
    "UNION SELECT 'net-' || l_suppkey FROM lineitem WHERE l_linenumber % 3 = 1 UNION SELECT 'ip-' || l_suppkey FROM lineitem WHERE l_linenumber % 3 = 1 AND l_returnflag = 'R' "
    "UNION SELECT 'boss-' || l_linestatus FROM lineitem WHERE l_returnflag = 'A'",
)
def referenced_ids(spark, folder):
    lines = b.table(spark, folder, "lineitem")

    def ref(prefix, c):
        return F.concat(F.lit(f'{{"id":"{prefix}-'), c, F.lit('"}'))

    machine = F.concat(
        F.lit('{"networkProfile":{"networkInterfaces":['), ref("nic", F.col("l_suppkey")),
        F.lit(']},"storageProfile":{"osDisk":{"managedDisk":'), ref("disk", F.col("l_partkey") % 100), F.lit("}}}"))
    public = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(',"publicIPAddress":'), ref("ip", F.col("l_suppkey")))).otherwise("")
    interface = F.concat(
        F.lit('{"ipConfigurations":[{"properties":{"subnet":'), ref("net", F.col("l_suppkey")), public, F.lit("}}]}"))
    kind = F.col("l_linenumber") % 3
    rows = lines.select(
        F.when(kind == 0, machine).when(kind == 1, interface).otherwise("{}").alias("properties"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("boss-"), "l_linestatus")).alias("managed_by"))
    return integrity.referenced_ids(rows)


@query(
    "document_tag_fields",
    with_views(b.TAGGED_DOCUMENTS) + "SELECT lang AS country, count(*) AS n, count(quality) AS rated FROM doc_tags GROUP BY 1",
)
def document_tag_fields(spark, folder):
    rows = b.tagged_documents(spark, folder).withColumn("m", json_map("tags"))
    return rows.groupBy(F.element_at("m", "Country").alias("country")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.element_at("m", "Tier")).alias("rated"))
