"""Estate tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from estatelens.operators.integrity import dangling, dangling_scopes

# Parents before children.
ORDER = (
    "tenant", "subscriptions", "resource_groups", "resources", "dependencies", "violations",
    "cost_records", "principals", "role_assignments", "drift_batches", "drift_records",
)
PARTITIONED = {"cost_records": ["billing_period"]}
BUCKETS = 64  # of owners, unless the writer names another number
LAYOUT = "layout"  # keeps the number of buckets beside the tables


class EstateError(ValueError):
    """The tables would break a reference, or a target is in the way."""


def check_references(tables: dict[str, DataFrame]) -> None:
    """Refuse edges without ends and assignments without scope or principal."""
    if "dependencies" in tables and not dangling(tables["dependencies"], tables["resources"]).isEmpty():
        raise EstateError("an edge has an end that is no resource")
    if "role_assignments" in tables and not dangling_scopes(
        tables["role_assignments"], tables["principals"], tables["subscriptions"],
        tables["resource_groups"], tables["resources"],
    ).isEmpty():
        raise EstateError("a role assignment has an unknown scope or principal")


def write_estate(tables: dict[str, DataFrame], folder: str, force: bool = False, buckets: int = BUCKETS) -> None:
    """Replace the whole estate; a target that holds rows is refused unless forced.

    Resources are partitioned by a hash of their owner into ``buckets``, which are split
    into ranges of owner and id, so reads of one owner skip the other buckets and, within
    the bucket, the files of other ranges; costs are partitioned by period.
    """
    spark = next(iter(tables.values())).sparkSession
    check_references(tables)
    if not force and any(_holds_rows(spark, f"{folder}/{name}") for name in tables):
        raise EstateError(f"{folder} already holds an estate")
    for name in ORDER:
        if name not in tables:
            continue
        df, partitions = tables[name], PARTITIONED.get(name, [])
        if name == "resources":
            df = df.withColumn("owner_bucket", F.pmod(F.xxhash64("subscription_id"), F.lit(buckets)).cast("int"))
            partitions = ["owner_bucket"]
            order = ["owner_bucket", "subscription_id", "id"]
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
            spark.createDataFrame([(name, buckets)], "table string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{LAYOUT}")
        elif partitions:
            # Adaptive execution splits a hot partition over several tasks and files, and
            # joins small ones.
            df = df.hint("rebalance", *[F.col(c) for c in partitions])
        df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{folder}/{name}")


def _holds_rows(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def read_estate(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    tables = {}
    for name in ORDER:
        try:
            tables[name] = spark.read.parquet(f"{folder}/{name}").drop("owner_bucket")
        except AnalysisException:
            continue
    return tables


def owner_rows(spark: SparkSession, folder: str, owner: str) -> DataFrame:
    """One owner's resources, reading only that owner's bucket."""
    buckets = spark.read.parquet(f"{folder}/{LAYOUT}").where(F.col("table") == "resources").first()["buckets"]
    rows = spark.read.parquet(f"{folder}/resources")
    bucket = F.pmod(F.xxhash64(F.lit(owner)), F.lit(buckets)).cast("int")
    return rows.where((F.col("owner_bucket") == bucket) & (F.col("subscription_id") == owner)).drop("owner_bucket")
