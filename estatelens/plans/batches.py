"""Change batches on a store that merges on read: a batch writes the rows it changes and no others.

The store (`sources.overlay`) holds the tables resources, batches and records. A batch lays
its changed rows, its records and its own row on top in one version; a revert lays the
restored rows on top. The fingerprint of what can be seen is kept with the version as a
count and sums; a batch moves them by the old and new digests of its rows, so the state is
not read again to know it. Eligible rows are still sought in the whole state.

A batch that is repeated after it was lost half-way writes anew; one that is repeated after
it was done changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.operators import drift, fingerprint
from estatelens.operators.drift import HIDE_PATH, CHANGES, Change
from estatelens.session import settle
from estatelens.sources import overlay
from estatelens.sources.overlay import GONE, Version

RECORDS = (
    "resource_id string, subscription_id string, drift_code string, field_path string, before string, "
    "after string, record_id long, batch_id string, metadata string"
)
BATCHES = (
    "batch_id string, drift_type string, seed long, options string, applied_at timestamp, reverted_at timestamp, "
    "parent_fingerprint string, result_fingerprint string, seq long"
)
WAS, NOW = "__was", "__now"


def open_store(state: DataFrame, path: str) -> Version:
    """A store whose base is ``state``; ids are not null and told apart."""
    spark = state.sparkSession

    def sums(written: dict[str, DataFrame]) -> dict:
        rows = written["resources"]
        row = rows.agg(*[
            c.cast("string").alias(f"s{i}") for i, c in enumerate(fingerprint.piece_sums(drift.visible_digest(rows)))]).first()
        return {"sums": list(map(int, row))}

    return overlay.create(path, {
        "resources": (state, "id"),
        "batches": (spark.createDataFrame([], BATCHES), "batch_id"),
        "records": (spark.createDataFrame([], RECORDS), "record_id"),
    }, sums)


def kept_fingerprint(at: Version) -> str:
    """The fingerprint of what can be seen, from the kept sums."""
    return fingerprint.digest_of(at.facts["sums"])


def _lay(
    spark: SparkSession, at: Version, staged: dict[str, str], changed: DataFrame, made_batch, new: dict[str, str] | None = None,
) -> Version:
    """Commit staged rows of resources with the batch row that ``made_batch`` gives for their sums, and ``new`` rows of others."""
    now = F.when(~F.col(GONE), drift.visible_digest(changed))
    sums = fingerprint.moved_sums(at.facts["sums"], changed.withColumn(NOW, now), WAS, NOW)
    folder, _ = overlay.stage(at, "batches", made_batch(sums))
    return overlay.commit(spark, at, {**staged, "batches": folder}, {"sums": sums}, new)


def _done_already(batches: DataFrame, batch_id: str, kind: str, seed: int, options: str) -> bool:
    held = batches.where(F.col("batch_id") == batch_id).select("drift_type", "seed", "options").take(1)
    if held and tuple(held[0]) != (kind, seed, options):
        raise ValueError(f"batch {batch_id} was made with other options")
    return bool(held)


def apply_batch(
    spark: SparkSession, path: str, batch_id: str, kind: str, applied_at: Column, codes=None, types=None,
    intensity: float = 1.0, seed: int = 0, references: list[DataFrame] | None = None, disappear: int = 0,
    groups: DataFrame | None = None, appear: int = 0, changes: tuple[Change, ...] = CHANGES,
) -> Version:
    """`drift.apply_changes` on a store: the same rows, records and fingerprints.

    The id of a row that comes must be new: a change replaces whatever has its id.
    """
    at = overlay.version(spark, path)
    state, batches, records = (overlay.read(spark, at, t) for t in ("resources", "batches", "records"))
    options = drift.options_text(intensity, types, codes, disappear, appear)
    if _done_already(batches, batch_id, kind, seed, options):
        return at
    seen = state.where(F.col(HIDE_PATH).isNull()).withColumn(WAS, drift.visible_digest(state))
    rows = drift.changed_rows(seen, kind, codes, types, intensity, seed, changes, "id", touched_only=not disappear)
    if disappear:
        gone = settle(drift.disappearing(seen, references or [], disappear, seed).select("id"))
        rows = rows.join(gone.withColumn("__leaves", F.lit(True)), "id", "left")
        rows = rows.withColumn(HIDE_PATH, F.when(F.col("__leaves"), applied_at).otherwise(F.col(HIDE_PATH)))
        touched = rows.where((F.size("__deltas") > 0) | F.col("__leaves"))
    else:
        touched = rows.withColumn("__leaves", F.lit(False))
    if appear and groups is not None:
        minted = drift.appearing(groups, appear, seed)
        minted = minted.select(*[c for c in state.columns if c in minted.columns], F.lit(True).alias("__comes"))
        touched = touched.unionByName(minted, allowMissingColumns=True)
    else:
        touched = touched.withColumn("__comes", F.lit(False))
    folder, written = overlay.stage(at, "resources", touched)
    deltas = written.select(F.col("id").alias("resource_id"), "subscription_id", F.inline("__deltas"))
    deltas = deltas.unionByName(drift.lost_deltas(written.where("__leaves"), len(changes)))
    deltas = deltas.unionByName(drift.minted_deltas(written.where("__comes"), len(changes) + 1))
    # They are numbered behind all that are there, so no record is ever replaced.
    logged = overlay.stage_new(at, "records", drift.logged_records(deltas, records, batch_id, kind))

    def batch(sums: list[int]) -> DataFrame:
        fresh = spark.range(1).select(
            F.lit(batch_id).alias("batch_id"), F.lit(kind).alias("drift_type"),
            F.lit(seed).cast("long").alias("seed"), F.lit(options).alias("options"), applied_at.alias("applied_at"),
            F.lit(None).cast("timestamp").alias("reverted_at"),
            F.lit(kept_fingerprint(at)).alias("parent_fingerprint"),
            F.lit(fingerprint.digest_of(sums)).alias("result_fingerprint"))
        return drift.next_seq(batches, fresh, ["applied_at", "batch_id"])

    return _lay(spark, at, {"resources": folder}, written, batch, {"records": logged})


def revert_batch(spark: SparkSession, path: str, batch_id: str, reverted_at: Column) -> Version:
    """`drift.revert` on a store: the touched rows are restored and laid on top, those that came are taken away."""
    at = overlay.version(spark, path)
    state, batches, records = (overlay.read(spark, at, t) for t in ("resources", "batches", "records"))
    drift.check_revert(batches, records, batch_id)
    restored = drift.restore(state, records, batch_id, marked=GONE, kept={WAS: drift.visible_digest(state)})
    folder, written = overlay.stage(at, "resources", restored)

    def batch(_: list[int]) -> DataFrame:
        return batches.where(F.col("batch_id") == batch_id).withColumn("reverted_at", reverted_at)

    return _lay(spark, at, {"resources": folder}, written, batch)


def written_rows(spark: SparkSession, at: Version) -> int:
    """How many rows of resources the last change folder of a version holds."""
    changes = at.tables["resources"].changes
    return spark.read.parquet(f"{at.path}/{changes[-1]}").count() if changes else 0
