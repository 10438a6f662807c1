"""Tables stored in buckets of a shared key, so joins and groups on it need no shuffle.

Keys that hold more rows of a table than an even bucket would are kept apart, with their
rows from every table: a bucket is read by one task, which a hot key would make long. There
are at most ``buckets`` such keys for each table. What is built on the key is built on both
parts and put together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.session import settle

BUCKETS = 64
CONTENTS = "contents"  # written last: what has none is no store

Tables = dict[str, DataFrame]


def hot_keys(tables: Tables, key: str, buckets: int) -> DataFrame:
    """Keys with more than 1 / buckets of the rows of a table."""
    found = []
    for df in tables.values():
        counts = settle(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")))
        most = counts.agg(F.sum("n")).scalar() / F.lit(buckets)
        found.append(counts.where(F.col("n") > most).select(key))
    return settle(reduce(DataFrame.union, found).distinct())


def write_bucketed(tables: Tables, folder: str, key: str, buckets: int = BUCKETS) -> None:
    """Write the tables, which all have the column ``key`` of one type, below a new folder.

    Rows without a key go with the hot ones. The list of contents is written last, so a store
    whose writer was lost is not taken for one.
    """
    spark = next(iter(tables.values())).sparkSession
    hot = hot_keys(tables, key, buckets)
    contents = []
    for name, df in tables.items():
        even = df.where(F.col(key).isNotNull()).join(hot, key, "left_anti").select(*df.columns)
        apart = df.join(hot, key, "left_semi").select(*df.columns).unionByName(df.where(F.col(key).isNull()))
        apart.write.mode("overwrite").parquet(f"{folder}/{name}/hot")
        table = _catalogue_name()
        # one task writes one bucket, as one file
        placed = even.repartition(buckets, F.col(key))
        placed.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{folder}/{name}/even").mode("overwrite").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # the files stay
        contents.append((name, key, buckets, df._jdf.schema().toDDL()))
    spark.createDataFrame(contents, "name string, key string, buckets int, columns string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{CONTENTS}")


def _catalogue_name() -> str:
    return f"bucketed_{uuid.uuid4().hex}"


def read_bucketed(spark: SparkSession, folder: str) -> tuple[Tables, Tables]:
    """The even part, which knows its buckets, and the hot part; in any session."""
    even, hot = {}, {}
    for name, key, buckets, columns in spark.read.parquet(f"{folder}/{CONTENTS}").collect():  # one row a table
        table = _catalogue_name()
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
            f"INTO {buckets} BUCKETS LOCATION '{folder}/{name}/even'")
        even[name] = spark.table(table)
        hot[name] = spark.read.schema(even[name].schema).parquet(f"{folder}/{name}/hot")
    return even, hot


def on_both(parts: tuple[Tables, Tables], build: Callable[[Tables], DataFrame]) -> DataFrame:
    """What ``build`` makes of the tables, by joins and groups on the shared key, over all keys."""
    even, hot = parts
    return build(even).unionByName(build(hot))
