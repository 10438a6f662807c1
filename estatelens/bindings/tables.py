"""Estate-shaped views over the given tables.

Each view is written twice: as DataFrame code and as a SQL common table expression, so a
query and its check read the same rows. Views join only what their columns need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.catalogues import types as t
from estatelens.functions.jsonmaps import empty_map
from estatelens.functions.text import group_path, resource_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- scan rows: one per order line ----------------------------------------------------

_FROM_ORDERS = {"resource_id", "subscription_id", "resource_group"}
_FROM_PART = {"resource_id", "type", "name", "kind", "properties"}
_FROM_NATION = {"location"}


def scan_rows(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Scan resources with the asked-for columns."""
    rows = table(spark, folder, "lineitem")
    wanted = set(columns)
    if wanted & _FROM_ORDERS:
        rows = rows.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if wanted & _FROM_PART:
        rows = rows.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if wanted & _FROM_NATION:
        rows = rows.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        rows = rows.join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    type_name = F.concat(F.lit("microsoft."), F.lower("p_type"), F.lit("/"), F.col("p_brand"))
    tags = F.to_json(F.struct(
        F.col("l_returnflag").alias("Environment"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("cc-"), F.col("l_suppkey") % 7)).alias("CostCenter"),
        F.concat(F.lit("user-"), F.col("l_suppkey")).alias("Owner"),
        F.when(F.col("l_quantity") > 45, F.lit("y")).alias("hidden-link:x"),
    ))
    exprs = {
        "resource_id": F.concat_ws(
            "/", F.lit("/subscriptions"), "o_custkey", F.lit("resourceGroups"), "o_orderpriority",
            F.lit("providers"), type_name, F.concat_ws("-", "l_orderkey", "l_linenumber")),
        "subscription_id": F.col("o_custkey").cast("string"),
        "resource_group": F.col("o_orderpriority"),
        "type": type_name,
        "name": F.concat_ws("-", F.translate("p_name", " ", "-"), F.col("l_linenumber")),
        "location": F.col("n_name"),
        "tags": F.when(F.col("l_linenumber") < 6, tags),
        "properties": F.to_json(F.struct(
            (F.col("p_size") % 8).alias("size"),
            F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("state"),
            F.col("l_suppkey").alias("secret"))),
        "sku": F.when(F.col("l_discount") < 0.05, F.to_json(F.struct(
            F.col("l_returnflag").alias("tier"), (F.col("l_quantity").cast("int") % 4).alias("family")))),
        "kind": F.when(F.col("p_size") > 25, F.col("l_linestatus")),
    }
    return rows.select(*[exprs[c].alias(c) for c in columns])


SCAN = """
scan AS (
  SELECT l.*, o_custkey, o_orderpriority, p_type, p_brand, p_name, p_size, n_name,
         CAST(o_custkey AS VARCHAR) AS subscription_id, o_orderpriority AS resource_group,
         'microsoft.' || lower(p_type) || '/' || p_brand AS type,
         'Microsoft.' || lower(p_type) || '/' || p_brand AS canonical,
         replace(p_name, ' ', '-') || '-' || l_linenumber AS name, n_name AS location
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""

SCAN_TAGS = """
tagged AS (
  SELECT 'microsoft.' || lower(p_type) || '/' || p_brand AS type, l_orderkey, l_linenumber,
         CAST(o_custkey AS VARCHAR) AS subscription_id, o_orderpriority AS resource_group,
         l_returnflag AS v1,
         CASE WHEN l_linestatus = 'F' THEN 'cc-' || (l_suppkey % 7) END AS v2,
         'user-' || l_suppkey AS v3, CASE WHEN l_quantity > 45 THEN 'y' END AS v4,
         l_linenumber < 6 AS has_tags
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
),
tag_pairs AS (
  SELECT type, 'Environment' AS key, v1 AS value FROM tagged WHERE has_tags
  UNION ALL SELECT type, 'CostCenter', v2 FROM tagged WHERE has_tags AND v2 IS NOT NULL
  UNION ALL SELECT type, 'Owner', v3 FROM tagged WHERE has_tags
  UNION ALL SELECT type, 'hidden-link:x', v4 FROM tagged WHERE has_tags AND v4 IS NOT NULL
)"""


def declared_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Five groups per customer, so some stay empty."""
    priorities = F.array(*[F.lit(p) for p in PRIORITIES])
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("subscription_id"),
        F.explode(priorities).alias("name"),
    )


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
DECLARED_GROUPS = """
declared AS (
  SELECT CAST(c_custkey AS VARCHAR) AS subscription_id, unnest(
    ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS name FROM customer
)"""


# --- estate rows: one per order -------------------------------------------------------

ESTATE_TYPES = (t.STORAGE, t.NSG, t.KEY_VAULT, t.AKS, t.SQL_SERVER, t.SQL_DATABASE, t.WEBSITE, t.VM)
ESTATE_TIERS = ("Free", "Basic", "Standard", "Premium", "Custom")


def pick_from(options: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + 1)


def estate_rows(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Estate resources with map columns, some of them hidden.

    They are several times as large as the orders they are made of; ``spread`` deals the
    orders out first, so that a few files of orders do not make a few long tasks.
    """
    key = F.col("o_orderkey")
    owner = F.col("o_custkey").cast("string")
    type_name = pick_from(ESTATE_TYPES, key % 8)
    tier = pick_from(ESTATE_TIERS, key % 5)
    stage = F.when(F.col("o_orderstatus") == "F", "production").when(F.col("o_orderstatus") == "O", "staging")
    tags = F.map_concat(
        F.when(stage.isNotNull(), F.create_map(F.lit("environment"), stage)).otherwise(empty_map()),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")),
    )
    properties = F.map_concat(
        F.create_map(F.lit("provisioningState"), F.lit("Succeeded")),
        F.when(key % 3 == 0, F.create_map(F.lit("minimumTlsVersion"), F.lit("TLS1_2"))).otherwise(empty_map()),
    )
    orders = table(spark, folder, "orders")
    if spread:
        orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return orders.select(
        resource_path(owner, "o_orderpriority", type_name, F.concat(F.lit("res-"), key)).alias("id"),
        owner.alias("subscription_id"),
        F.col("o_orderpriority").alias("resource_group_name"),
        F.concat(F.lit("res-"), key).alias("name"),
        type_name.alias("type"),
        tags.alias("tags"),
        F.when(key % 4 != 0, F.create_map(
            F.lit("tier"), tier, F.lit("name"), F.concat(tier, F.lit("_S1")))).alias("sku"),
        F.when(key % 8 == 6, F.lit("app")).alias("kind"),
        properties.alias("properties"),
        F.when(key % 97 == 0, F.col("o_orderdate").cast("timestamp")).alias("drift_deleted_at"),
        F.col("o_orderkey").alias("number"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("created"),
    )


ESTATE = """
estate AS (
  SELECT o_orderkey, o_custkey, CAST(o_custkey AS VARCHAR) AS subscription_id,
    o_orderpriority AS resource_group_name, 'res-' || o_orderkey AS name, type,
    '/subscriptions/' || o_custkey || '/resourceGroups/' || o_orderpriority || '/providers/' ||
      CASE WHEN type = 'Microsoft.Sql/servers/databases'
           THEN 'Microsoft.Sql/servers/res-' || o_orderkey || '/databases/res-' || o_orderkey
           ELSE type || '/res-' || o_orderkey END AS id,
    CASE o_orderstatus WHEN 'F' THEN 'production' WHEN 'O' THEN 'staging' END AS environment,
    o_orderpriority AS priority,
    CASE WHEN o_orderkey % 4 <> 0 THEN tier END AS tier,
    CASE WHEN o_orderkey % 8 = 6 THEN 'app' END AS kind,
    CASE WHEN o_orderkey % 3 = 0 THEN 'TLS1_2' END AS tls,
    o_orderkey % 97 = 0 AS hidden, o_totalprice, o_orderdate, o_orderstatus
  FROM (SELECT *,
    ['Microsoft.Storage/storageAccounts', 'Microsoft.Network/networkSecurityGroups',
     'Microsoft.KeyVault/vaults', 'Microsoft.ContainerService/managedClusters',
     'Microsoft.Sql/servers', 'Microsoft.Sql/servers/databases', 'Microsoft.Web/sites',
     'Microsoft.Compute/virtualMachines'][o_orderkey % 8 + 1] AS type,
    ['Free', 'Basic', 'Standard', 'Premium', 'Custom'][o_orderkey % 5 + 1] AS tier
    FROM orders)
)"""


def estate_owners(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("subscription_id"),
        F.col("c_name").alias("display_name"),
        F.col("c_mktsegment").alias("archetype"),
    )


def estate_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups that hold an order."""
    return (
        table(spark, folder, "orders")
        .select(F.col("o_custkey").cast("string").alias("subscription_id"), F.col("o_orderpriority").alias("name"))
        .distinct()
        .select(group_path("subscription_id", "name").alias("id"), "subscription_id", "name")
    )


def cost_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Cost facts: order lines billed to their part, by month of shipping."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("resource_id"),
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("billing_period"),
        F.col("l_extendedprice").alias("cost_amount"),
        F.col("l_suppkey").cast("string").alias("subscription_id"),
    )


PART_TYPES = {
    "ECONOMY": "Microsoft.Compute/virtualMachines",
    "SMALL": "Microsoft.Storage/storageAccounts",
    "MEDIUM": "microsoft.compute/DISKS",
    "LARGE": "Microsoft.Sql/servers",
    "STANDARD": "Contoso.Custom/widgets",
}


def billed_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as billed resources; their types partly known, partly not."""
    type_name = F.col("p_type")
    for p_type, known in PART_TYPES.items():
        type_name = F.when(F.col("p_type") == p_type, known).otherwise(type_name)
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("resource_id"),
        type_name.alias("type"),
        F.col("p_brand").alias("resource_group"),
        F.to_json(F.struct(
            F.when(F.col("p_size") > 10, F.col("p_name")).alias("product"),
        )).alias("tags"),
    )


BILLED = """
billed AS (
  SELECT p_partkey AS resource_id, p_brand AS resource_group,
    CASE p_type WHEN 'ECONOMY' THEN 'Microsoft.Compute/virtualMachines'
      WHEN 'SMALL' THEN 'Microsoft.Storage/storageAccounts' WHEN 'MEDIUM' THEN 'microsoft.compute/DISKS'
      WHEN 'LARGE' THEN 'Microsoft.Sql/servers' WHEN 'STANDARD' THEN 'Contoso.Custom/widgets'
      ELSE p_type END AS type,
    CASE p_type WHEN 'ECONOMY' THEN 'Virtual Machines' WHEN 'SMALL' THEN 'Storage'
      WHEN 'MEDIUM' THEN 'Storage' WHEN 'LARGE' THEN 'SQL Database'
      WHEN 'STANDARD' THEN 'Contoso.Custom' ELSE p_type END AS service,
    CASE WHEN p_size > 10 THEN p_name END AS product
  FROM part
),
costs AS (
  SELECT l_partkey AS resource_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS billing_period,
    l_extendedprice AS cost_amount, CAST(l_suppkey AS VARCHAR) AS subscription_id FROM lineitem
)"""


# --- edges, documents, events ---------------------------------------------------------

def edge_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as edges from a part to a supplier, owned by two nations."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    # Customers meet the narrow orders, which are then hashed, so that no task sorts lines.
    owned = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        lines.join(owned.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(F.lit("part-"), "l_partkey").alias("source_resource_id"),
            F.concat(F.lit("supplier-"), "l_suppkey").alias("target_resource_id"),
            F.col("c_nationkey").cast("long").alias("source_subscription"),
            F.col("s_nationkey").cast("long").alias("target_subscription"),
            F.col("l_returnflag").alias("dependency_type"),
            F.col("l_orderkey").alias("edge_order"),
            F.col("l_linenumber").cast("long").alias("edge_line"),
        )
    )


EDGES = """
edges AS (
  SELECT 'part-' || l_partkey AS source_resource_id, 'supplier-' || l_suppkey AS target_resource_id,
    CAST(c_nationkey AS BIGINT) AS source_subscription, CAST(s_nationkey AS BIGINT) AS target_subscription,
    l_returnflag AS dependency_type, l_orderkey AS edge_order, CAST(l_linenumber AS BIGINT) AS edge_line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
)"""


def tagged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their language, source and label as a tag object."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.to_json(F.struct(
            F.col("lang").alias("Country"), F.col("source").alias("project"),
            F.col("quality").alias("Tier"),
            F.when(F.col("lang") == "fr", F.col("source")).alias("customKey"),
        )).alias("tags"),
    )


TAGGED_DOCUMENTS = """
doc_tags AS (
  SELECT d.doc_id, lang, source, quality, CASE WHEN lang = 'fr' THEN source END AS custom
  FROM documents d LEFT JOIN labels USING (doc_id)
)"""


def violation_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as violations of customers; some name a customer that is gone."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("res-"), (F.col("event_id") * 7) % 20011).alias("resource_id"),
        F.upper("event_type").alias("violation_type"),
        F.when(F.col("value") > 50, "High").when(F.col("value") > 10, "Medium").otherwise("Low").alias("severity"),
    )


VIOLATIONS = """
violations AS (
  SELECT event_id AS id, 'res-' || ((event_id * 7) % 20011) AS resource_id,
    upper(event_type) AS violation_type,
    CASE WHEN value > 50 THEN 'High' WHEN value > 10 THEN 'Medium' ELSE 'Low' END AS severity
  FROM events
)"""


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Events as served requests."""
    return table(spark, folder, "events").select(
        "event_id", "ts", F.col("event_type").alias("route"), F.col("value").alias("latency"),
        (200 + (F.col("user_id") % 5) * 100).cast("int").alias("status"),
    )


REQUESTS = """
requests AS (
  SELECT event_id, ts, event_type AS route, value AS latency,
    CAST(200 + (user_id % 5) * 100 AS INTEGER) AS status FROM events
)"""
