"""Keyed tables with merge on read: change files lie on a base, and the newest row of a key wins.

A store is a folder of named tables. Each has a base, and change folders that hold only the
rows written since, in which a row marked ``__gone`` takes its key away. What belongs to a
version stands in a manifest, one line of JSON below ``versions``; it is written last, and
counts once its write is complete. So several tables change together or not at all: a writer
that is lost half-way leaves folders that no manifest names, and writes anew when it is
repeated. One writer at a time is the caller's duty; readers may read any version meanwhile.

A change replaces all rows of its key. Rows whose keys are new need not be merged with
anything: they are appended, and read beside the base. Keys are not null, which creating and
staging check by a count; a column whose name starts with two underscores is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estatelens.session import drop_path, is_there, list_folders

GONE = "__gone"
CHANGE = "__change"


@dataclass(frozen=True)
class Table:
    key: str
    schema: str  # as JSON
    base: str
    changes: tuple[str, ...] = ()  # from old to new
    appended: tuple[str, ...] = ()  # read beside the base


@dataclass(frozen=True)
class Version:
    path: str
    number: int
    tables: dict[str, Table]
    facts: dict = field(default_factory=dict)


def _fresh(number: int) -> str:
    return f"{number:08d}-{uuid.uuid4().hex}"


def _write_manifest(spark: SparkSession, version: Version) -> Version:
    tables = {name: [t.key, t.schema, t.base, list(t.changes), list(t.appended)] for name, t in version.tables.items()}
    line = json.dumps({"tables": tables, "facts": version.facts})
    target = f"{version.path}/versions/{_fresh(version.number)}"
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(target)
    return version


def _committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished versions, oldest first."""
    names = sorted(list_folders(spark, f"{path}/versions"))
    return [n for n in names if is_there(spark, f"{path}/versions/{n}/_SUCCESS")]


def _read_manifest(spark: SparkSession, path: str, name: str) -> Version:
    held = json.loads(spark.read.text(f"{path}/versions/{name}").first()[0])
    tables = {n: Table(key, schema, base, *map(tuple, layers)) for n, (key, schema, base, *layers) in held["tables"].items()}
    return Version(path, int(name.split("-")[0]), tables, held["facts"])


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest finished version, or the one of that number."""
    names = [n for n in _committed(spark, path) if number is None or int(n.split("-")[0]) == number]
    if not names:
        raise ValueError(f"no finished version of {path}" + ("" if number is None else f" has number {number}"))
    return _read_manifest(spark, path, names[-1])


def _refuse_null_keys(spark: SparkSession, folder: str, key: str) -> None:
    if not spark.read.parquet(folder).where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is null in some rows")


def create(
    path: str, tables: dict[str, tuple[DataFrame, str]], facts: Callable[[dict[str, DataFrame]], dict] | None = None,
) -> Version:
    """Write the tables, each given with its key, as the bases of a new store; ``facts`` are told of the tables as written."""
    made, written = {}, {}
    for name, (df, key) in tables.items():
        reserved = [c for c in df.columns if c.startswith("__")]
        if reserved:
            raise ValueError(f"columns {reserved} have reserved names")
        base = f"{name}/base-{_fresh(0)}"
        df.write.parquet(f"{path}/{base}")
        _refuse_null_keys(df.sparkSession, f"{path}/{base}", key)
        made[name] = Table(key, df.schema.json(), base)
        written[name] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{base}")
    spark = next(iter(tables.values()))[0].sparkSession
    return _write_manifest(spark, Version(path, 0, made, facts(written) if facts else {}))


def _schema(table: Table) -> StructType:
    return StructType.fromJson(json.loads(table.schema))


def _all_changes(spark: SparkSession, at: Version, name: str) -> DataFrame:
    table = at.tables[name]
    schema = _schema(table).add(GONE, "boolean").add(CHANGE, "string")
    root = f"{at.path}/{name}/changes"
    return spark.read.schema(schema).option("basePath", root).parquet(*[f"{at.path}/{c}" for c in table.changes])


def newest_changes(spark: SparkSession, at: Version, name: str) -> DataFrame:
    """The newest change of each changed key, with ``__gone``. Only change files are read.

    Rows are sorted once, by key and change, where aggregates of whole rows would sort them
    before and after they move. Columns nobody reads are not moved.
    """
    table = at.tables[name]
    held = _all_changes(spark, at, name)
    if len(table.changes) == 1:
        return held.drop(CHANGE)
    newest_first = Window.partitionBy(table.key).orderBy(F.col(CHANGE).desc())
    # The row with none before it; a rank of 1 would make Spark sort the rows before they move as well.
    return held.withColumn("__newer", F.lag(CHANGE).over(newest_first)).where(F.col("__newer").isNull()).drop("__newer", CHANGE)


def read(spark: SparkSession, at: Version, name: str) -> DataFrame:
    """The table as of a version: base rows whose key no change names, and the newest changes.

    Changes are slim beside the base, so Spark sends them to the base's tasks where their
    size allows it and the base does not move; else both are shuffled once by the key.
    """
    table = at.tables[name]
    schema = _schema(table)
    base = spark.read.schema(schema).parquet(*[f"{at.path}/{part}" for part in (table.base, *table.appended)])
    if not table.changes:
        return base
    newest = newest_changes(spark, at, name)
    kept = base.join(_all_changes(spark, at, name).select(table.key), table.key, "left_anti")
    return kept.select(*schema.names).unionByName(newest.where(~F.col(GONE)).select(*schema.names))


def stage(at: Version, name: str, changes: DataFrame) -> tuple[str, DataFrame]:
    """Write changed rows for the next version; gives their folder, and the rows as written.

    ``changes`` has the table's columns, one row for a key; it may have ``__gone``, and any
    further columns, which a reader of the table does not see. Nothing counts before `commit`.
    """
    spark = changes.sparkSession
    folder = f"{name}/changes/{CHANGE}={_fresh(at.number + 1)}"
    marked = changes if GONE in changes.columns else changes.withColumn(GONE, F.lit(False))
    marked.write.parquet(f"{at.path}/{folder}")
    _refuse_null_keys(spark, f"{at.path}/{folder}", at.tables[name].key)
    return folder, spark.read.schema(marked.schema).parquet(f"{at.path}/{folder}")


def stage_new(at: Version, name: str, rows: DataFrame) -> str:
    """Write rows for the next version whose keys are new to the table and told apart, which is the caller's duty."""
    folder = f"{name}/appended-{_fresh(at.number + 1)}"
    rows.select(*_schema(at.tables[name]).names).write.parquet(f"{at.path}/{folder}")
    _refuse_null_keys(rows.sparkSession, f"{at.path}/{folder}", at.tables[name].key)
    return folder


def commit(
    spark: SparkSession, at: Version, staged: dict[str, str], facts: dict | None = None, new: dict[str, str] | None = None,
) -> Version:
    """The version after ``at``, with the staged folders on top, those of ``new`` beside the base, and ``facts`` put in."""
    newest = version(spark, at.path).number
    if newest != at.number:
        raise ValueError(f"version {newest} was written since version {at.number} was read")
    tables = dict(at.tables)
    for name, folder in staged.items():
        tables[name] = replace(tables[name], changes=(*tables[name].changes, folder))
    for name, folder in (new or {}).items():
        tables[name] = replace(tables[name], appended=(*tables[name].appended, folder))
    return _write_manifest(spark, Version(at.path, at.number + 1, tables, {**at.facts, **(facts or {})}))


def compact(spark: SparkSession, at: Version, name: str) -> Version:
    """A version whose base holds what ``at`` reads, without changes on top."""
    base = f"{name}/base-{_fresh(at.number + 1)}"
    read(spark, at, name).write.parquet(f"{at.path}/{base}")
    tables = {**at.tables, name: replace(at.tables[name], base=base, changes=(), appended=())}
    return commit(spark, replace(at, tables=tables), {})


def drop_unused(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete what the last ``keep`` versions do not name: old versions and unfinished writes.

    Manifests go first, so no version is ever found whose files are gone.
    """
    names = _committed(spark, path)[-keep:]
    kept = [_read_manifest(spark, path, n) for n in names]
    for name in list_folders(spark, f"{path}/versions"):
        if name not in names:
            drop_path(spark, f"{path}/versions/{name}")
    named = {f for v in kept for t in v.tables.values() for f in (t.base, *t.changes, *t.appended)}
    for name in {n for v in kept for n in v.tables}:
        held = [f"{name}/{f}" for f in list_folders(spark, f"{path}/{name}") if f != "changes"]
        held += [f"{name}/changes/{f}" for f in list_folders(spark, f"{path}/{name}/changes")]
        for folder in held:
            if folder not in named:
                drop_path(spark, f"{path}/{folder}")
