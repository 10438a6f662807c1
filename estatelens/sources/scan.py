"""Scan tables: reading, normalising exported rows, projecting an estate back to a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from estatelens.catalogues.words import GENERIC_TAG_KEYS
from estatelens.functions.jsonmaps import filter_map_keys, null_if_empty

SCHEMAS = {
    "subscriptions": "scan_id string, subscription_id string, display_name string, state string, tags string",
    "resource_groups": "scan_id string, resource_group_id string, name string, location string, "
    "subscription_id string, tags string",
    "resources": "scan_id string, resource_id string, name string, type string, location string, "
    "resource_group string, subscription_id string, properties string, sku string, tags string, kind string",
    "findings": "scan_id string, resource_id string, finding_type string, category string, severity string",
    "resource_costs": "resource_id string, billing_month string, amortized_cost_eur double",
}
REQUIRED = ("subscriptions", "resources")
JSON_COLUMNS = ("properties", "sku", "tags")

EXPORTED = (
    "data array<struct<id: string, name: string, type: string, location: string, "
    "resourceGroup: string, subscriptionId: string, tags: map<string,string>, "
    "properties: string, sku: string, kind: string>>, skipToken string"
)


def load_scan(spark: SparkSession, folder: str, file_format: str = "parquet") -> dict[str, DataFrame]:
    """The five scan tables; an optional table that is not there is empty, not an error."""
    tables = {}
    for name, schema in SCHEMAS.items():
        path = f"{folder.rstrip('/')}/{name}.{file_format}"
        try:
            table = spark.read.schema(schema).format(file_format).load(path)
        except AnalysisException as missing:
            if name in REQUIRED or "PATH_NOT_FOUND" not in str(missing.getCondition()):
                raise
            table = spark.createDataFrame([], schema)
        for c in JSON_COLUMNS:
            if c in table.columns:
                table = table.withColumn(c, null_if_empty(c))
        tables[name] = table
    return tables


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    """Rows of exported JSON pages, one page per file."""
    pages = spark.read.schema(EXPORTED).json(path, multiLine=True)
    return pages.select(F.explode("data").alias("r")).select("r.*")


def normalize_rows(rows: DataFrame, scan_id: str = "export", generic=GENERIC_TAG_KEYS) -> DataFrame:
    """Exported camelCase rows as the eleven scan columns.

    Only generic tag keys are kept; an empty object becomes NULL.
    """
    def text(c: str) -> Column:
        return null_if_empty(c)

    return rows.select(
        F.lit(scan_id).alias("scan_id"), F.col("id").alias("resource_id"), "name", "type", "location",
        F.col("resourceGroup").alias("resource_group"), F.col("subscriptionId").alias("subscription_id"),
        text("properties").alias("properties"), text("sku").alias("sku"),
        F.to_json(filter_map_keys("tags", generic)).alias("tags"), "kind",
    )


def to_scan(estate: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Estate tables as scan tables: hidden rows left out, empty objects NULL, months as text."""
    seen = estate["resources"].where(F.col("drift_deleted_at").isNull())
    scan = F.lit("estate").alias("scan_id")
    return {
        "subscriptions": estate["subscriptions"].select(
            scan, "subscription_id", "display_name", "state", null_if_empty("tags").alias("tags")),
        "resource_groups": estate["resource_groups"].select(
            scan, F.col("id").alias("resource_group_id"), "name", "location", "subscription_id",
            null_if_empty("tags").alias("tags")),
        "resources": seen.select(
            scan, F.col("id").alias("resource_id"), "name", "type", "location",
            F.col("resource_group_name").alias("resource_group"), "subscription_id",
            *[null_if_empty(c).alias(c) for c in JSON_COLUMNS], "kind"),
        "resource_costs": estate["cost_records"].join(
            seen.select(F.col("id").alias("resource_id")), "resource_id", "left_semi"
        ).select(
            "resource_id", F.date_format("billing_period", "yyyy-MM").alias("billing_month"),
            F.col("cost_amount").alias("amortized_cost_eur")),
    }
