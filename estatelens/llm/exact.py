"""Exact deduplication over an extendible-hash index in shared files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.llm.common import SPACE, whole_text, with_row_id
from estatelens.session import scratch_path, settle

CAPACITY = 5_000  # entries a bucket may hold before it splits
MOST_BUCKETS = 65_536  # a table with more entries than fit into so many buckets gets larger buckets
SLICES_A_BUCKET = 5  # a bucket whose copies exceed twice its capacity is merged in slices of this part of it
FIRST_DEPTH = 4
MOST_DEPTH = 40


def normalised(text: str | Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(whole_text(text), SPACE + "+", "")


def _prefix(depth: str) -> Column:
    return F.expr(f"shiftrightunsigned(hash, 64 - {depth})")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(depth, bucket) of an extendible-hash directory over the entries' 64-bit hashes.

    The directory starts at 2 ** FIRST_DEPTH prefixes. While a bucket holds more than
    ``capacity`` entries the directory doubles and overfull buckets split by one more bit.
    Each round counts the entries of overfull buckets only. Entries with one and the same
    hash cannot be split; they stay a chain in one bucket, and MOST_DEPTH ends the doubling.
    """
    open_, depth, found = entries.select("hash"), FIRST_DEPTH, None
    while True:
        counts = settle(open_.groupBy(_prefix(str(depth)).alias("bucket")).agg(F.count("*").alias("n")))
        fits = (F.col("n") <= capacity) | F.lit(depth >= MOST_DEPTH)
        closed = counts.where(fits).select(F.lit(depth).alias("depth"), "bucket")
        found = closed if found is None else found.unionByName(closed)
        most = counts.where(~fits).agg(F.max("n")).first()[0]
        if most is None:
            return settle(found)
        full = counts.where(~fits).select("bucket")
        open_ = open_.join(full, _prefix(str(depth)) == full["bucket"], "left_semi")
        # the fullest bucket needs at least so many doublings; the others are split along with it
        depth = min(MOST_DEPTH, depth + max(1, math.ceil(math.log2(most / capacity))))


def sized_directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The directory with the number of slices in which a bucket's rows are merged.

    ``entries`` has one row per key with its number of rows, ``n``. A bucket holds at most
    ``capacity`` entries but any number of copies; where those are many, its owner is helped
    by as many tasks as there are slices.
    """
    capacity = max(capacity, -(-entries.count() // MOST_BUCKETS))
    buckets = directory(entries, capacity)
    filled = placed(entries, buckets).groupBy("depth", "bucket").agg(F.sum("n").alias("n"))
    slices = F.when(F.col("n") > 2 * capacity, F.ceil(F.col("n") / max(1, capacity // SLICES_A_BUCKET))).otherwise(1)
    return settle(filled.select("depth", "bucket", slices.cast("int").alias("slices")))


def placed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """The rows with the (depth, bucket) that the directory has for their hash, and its other columns."""
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())  # at most MOST_DEPTH numbers
    asked = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths or [FIRST_DEPTH]])))
    return asked.withColumn("bucket", _prefix("depth")).join(buckets, ["depth", "bucket"])


BUCKET = ["depth", "bucket"]


def _merged(texts: DataFrame, *place: str) -> DataFrame:
    """Equal texts of one place as one entry, compared byte by byte, with their rows counted and the best one named."""
    return texts.groupBy(*place, "hash", "text").agg(F.sum("n").alias("n"), F.min("best").alias("best"))


def _chained(merged: DataFrame, *place: str, digest) -> DataFrame:
    """The entries with their link among those of one hash, and how many texts share their key."""
    keyed = merged.withColumn("digest", digest(F.col("text")))
    in_chain = Window.partitionBy(*place, "hash").orderBy("digest", "text")
    same_key = Window.partitionBy(*place, "hash", "digest")
    return keyed.withColumn("link", F.row_number().over(in_chain)).withColumn("texts", F.count("*").over(same_key))


def written_index(texts: DataFrame, buckets: DataFrame, digest) -> str:
    """The path of the index: a folder of files for each bucket, with one entry for each different text.

    ``texts`` has (hash, text, n, best). Every text goes to the task that owns its bucket, which
    compares the bytes, merges copies and chains the entries of one hash. Where a bucket is
    merged in slices, what the slices keep meets at the owner. An entry holds its text only
    if others share its key; else the key alone tells it apart from now on.
    """
    spark = texts.sparkSession
    at = F.pmod(F.xxhash64("best"), F.col("slices")).alias("slice")
    slices = [*BUCKET, "slices", "slice"]
    sliced = placed(texts, buckets).select(*BUCKET, "slices", at, "hash", "text", "n", "best").repartition(*BUCKET, "slices", "slice")
    parts = _chained(_merged(sliced, *slices), *slices, digest=digest)
    kept = F.when((F.col("slices") > 1) | (F.col("texts") > 1), F.col("text")).alias("text")
    parts = settle(parts.select(*BUCKET, "slices", "hash", "digest", "link", "texts", kept, "n", "best"))
    whole = parts.where("slices = 1").drop("slices")
    halves = parts.where("slices > 1").repartition(*BUCKET)
    joined = _chained(_merged(halves, *BUCKET), *BUCKET, digest=digest)
    joined = joined.withColumn("text", F.when(F.col("texts") > 1, F.col("text")))
    path = scratch_path(spark, "extendible-index")
    whole.unionByName(joined).write.partitionBy(*BUCKET).parquet(path)
    return path


def read_index(spark: SparkSession, path: str, schema: T.StructType, only: list[tuple[int, int]] | None = None) -> DataFrame:
    """The entries of the index, or those of the (depth, bucket) pairs ``only``, whose files alone are opened."""
    paths = [path] if only is None else [f"{path}/depth={d}/bucket={b}" for d, b in only]
    return spark.read.schema(schema).option("basePath", path).parquet(*paths)


def index_schema(id_type: T.DataType) -> T.StructType:
    best = T.StructType([
        T.StructField("chars", T.IntegerType()), T.StructField("no_id", T.BooleanType()), T.StructField("id", id_type),
        T.StructField("__file", T.StringType()), T.StructField("__row", T.LongType())])
    plain = T._parse_datatype_string("hash long, digest string, link int, texts long, text string, n long")
    return T.StructType([*plain.fields, T.StructField("best", best), *T._parse_datatype_string("depth int, bucket long").fields])


def looked_up(rows: DataFrame, texts: DataFrame, buckets: DataFrame, index: DataFrame) -> DataFrame:
    """Each row with the entry of its text, sought in the bucket that the directory names.

    ``rows`` has keys without texts; where several texts share a key, the rows come from
    ``texts`` and their bytes are compared with the entries'.
    """
    key = [*BUCKET, "hash", "digest"]
    entries = index.withColumnRenamed("best", "kept_best").withColumnRenamed("n", "group_size")
    found = placed(rows, buckets).join(entries.where("texts = 1").drop("text", "texts"), key).select("best", "digest", "group_size", "kept_best")
    chains = entries.where("texts > 1")
    if chains.isEmpty():
        return found
    again = placed(texts, buckets).join(chains, [*BUCKET, "hash", "text"])
    return found.unionByName(again.select("best", "digest", "group_size", "kept_best"))


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(df: DataFrame, id_: str, text: str, hash_=_hash, digest=_digest, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``df`` with the group of equal normalised texts that it belongs to.

    Returns (id, keep_id, group_size, kept, text_sha256). Of a group, the row with the most
    code points in its original text stays, then the smallest id (null ids last), then any
    one of several equal rows. Null texts count as empty; all texts that are empty after
    normalisation form one group. Other columns are not read.

    The keys of all rows fill the directory of an extendible-hash index. The texts go to the
    tasks that own the buckets, are compared byte by byte there and become entries in the
    buckets' files; equal keys are not taken for equal texts. Each row then looks its entry
    up in its bucket. A bucket with very many copies is merged in slices first, so no task
    holds a large group. Rows without texts meet their entries by an ordinary join, in which
    the copies of one text share a key; they are slim, and adaptive execution splits them.
    """
    spark = df.sparkSession
    named = with_row_id(df.select(F.col(id_).alias("id"), whole_text(text).alias("text")))
    chars, id_now = F.char_length("row.text"), F.col("row.id")
    best = F.struct((-chars).alias("chars"), id_now.isNull().alias("no_id"), id_now.alias("id"), "__file", "__row").alias("best")
    texts = named.select(normalised("row.text").alias("text"), best)
    texts = texts.select(hash_(F.col("text")).alias("hash"), "text", F.lit(1).cast("long").alias("n"), "best")
    rows = settle(texts.select("hash", digest(F.col("text")).alias("digest"), "best"))

    buckets = sized_directory(settle(rows.groupBy("hash", "digest").agg(F.count("*").alias("n"))), capacity)
    path = written_index(texts, buckets, digest)
    index = read_index(spark, path, index_schema(df.schema[id_].dataType))
    same = (F.col("best.__file") == F.col("kept_best.__file")) & (F.col("best.__row") == F.col("kept_best.__row"))
    return looked_up(rows, texts, buckets, index).select(
        F.col("best.id").alias(id_), F.col("kept_best.id").alias("keep_id"), "group_size",
        same.alias("kept"), F.col("digest").alias("text_sha256"))


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
"""
