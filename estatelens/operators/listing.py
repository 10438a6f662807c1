"""Columns of list results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dimensions import with_spelling


def owner_rows(owners: DataFrame) -> DataFrame:
    """Subscriptions with their path, in order of id."""
    return owners.select(
        F.concat(F.lit("/subscriptions/"), "subscription_id").alias("id"), "subscription_id", "display_name", "state",
        "tenant_id", "authorization_source", "spending_limit",
    ).orderBy("subscription_id")


def group_rows(groups: DataFrame) -> DataFrame:
    """Resource groups with their state as a property."""
    return groups.select(
        "id", "name", F.lit("Microsoft.Resources/resourceGroups").alias("type"), "location", "tags",
        F.to_json(F.struct(F.col("provisioning_state").alias("provisioningState"))).alias("properties"))


def resource_rows(rows: DataFrame) -> DataFrame:
    """Resources under the documented spelling of their type; missing properties are empty."""
    properties = F.when(F.col("properties") != "null", F.col("properties"))
    return with_spelling(rows, "type", "__type").select(
        "id", "name", F.col("__type").alias("type"), "location", "tags", "sku", "kind",
        F.coalesce(properties, F.lit("{}")).alias("properties"))
