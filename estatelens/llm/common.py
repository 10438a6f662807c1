"""What several corpus operators share: tables, words, and exact running totals over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.session import settle

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str | Column) -> Column:
    """The text, with null counted as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def array_column(rows: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array of lists, one for each row; the rows are numpy arrays or lists of numbers."""
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    values = np.concatenate(rows) if len(rows) and offsets[-1] else np.zeros(0)
    return pa.ListArray.from_arrays(offsets, pa.array(values, type=kind, safe=False))


def in_slices(df: DataFrame, text: str, added: str, make: Callable[[list], list[pa.Array]], rows: int = 128) -> DataFrame:
    """The columns of ``df`` but ``text``, and the columns ``added`` (a schema) that ``make`` gives for a list of texts.

    Python workers take ``rows`` rows at a time and hand their results on, so results never
    pile up however much larger than the texts they are.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, *T._parse_datatype_string(added).fields])
    names = schema.fieldNames()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                new = make(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *new], names=names)

    return df.mapInArrow(each, schema)


def ranged(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The rows sorted by ``keys`` over all partitions, settled, with their place in ``position``.

    The place orders the whole table: its upper bits (from 33 on) number the range, the
    lower ones the row within it. The last sort key tells equal rows apart, so copies of one
    row never have to fit into one range. The rows are settled first, since cutting ranges
    reads them twice.
    """
    spread = settle(df).withColumn(position, F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*keys, position).sortWithinPartitions(*keys, position)
    return settle(spread.withColumn(position, F.monotonically_increasing_id()))


def running(df: DataFrame, keys: list[str], amounts: dict[str, str], within: list[str] | None = None) -> DataFrame:
    """Settled rows with exact running totals, in the order of ``keys``, of what lies before them.

    ``amounts`` maps each new column to the long column it adds up ("1" counts rows);
    ``within`` names leading keys at whose change the totals start anew. Every range is
    summed on its own, then the ranges' totals are carried forward, so a group may span any
    number of ranges. Equal input gives equal totals whatever the ranges are.
    """
    within = within or []
    rows = ranged(df, [*within, *keys], "_place")
    part = F.shiftright("_place", 33)
    value = lambda c: F.lit(1).cast("long") if c == "1" else F.col(c)
    rows = rows.withColumn("_part", part)
    sums = rows.groupBy("_part", *within).agg(*[F.sum(value(c)).alias(n) for n, c in amounts.items()])
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carried = sums.select(
        "_part", *[F.col(c).alias(f"_w_{c}") for c in within],
        *[F.coalesce(F.sum(n).over(before), zero).alias(f"_c_{n}") for n in amounts])
    inside = Window.partitionBy("_part", *within).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(value(c)).over(inside), zero).alias(n) for n, c in amounts.items()])
    on = rows["_part"] == carried["_part"]
    for c in within:
        on = on & rows[c].eqNullSafe(carried[f"_w_{c}"])
    joined = rows.join(carried, on)
    kept = [rows[c] for c in df.columns]
    return joined.select(*kept, *[(rows[n] + carried[f"_c_{n}"]).alias(n) for n in amounts])


ROW = ("__file", "__row")  # what names a row for good; a given column of such a name gives way


def with_row_id(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of the columns) with `__file` and `__row`, which name a row for good, also among repeated rows.

    A row read from a file is named by the file's whole path and its number there, which do
    not depend on how the read is split. That holds for a plain scan of files only: rows
    of any other frame (joined, exploded, drawn, made from data) are settled first. The
    given columns lie within ``row``, so no name of theirs can clash.
    """
    if not _is_scan(docs):
        docs = settle(docs)
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    meta = docs.metadataColumn("_metadata")
    return docs.select(given, meta["file_path"].alias("__file"), meta["row_index"].alias("__row"))


def _is_scan(df: DataFrame) -> bool:
    """Whether each row of the frame is one row of a file: columns chosen or renamed from one scan, rows perhaps filtered."""
    plan = getattr(df, "_jdf", None) and df._jdf.queryExecution().analyzed()
    if not plan or not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" and plan.metadataOutput().size() > 0 and "row_index" in str(plan.metadataOutput().apply(0).dataType().catalogString())
