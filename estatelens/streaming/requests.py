"""Served requests as a stream.

Every micro-batch is written as its own folder below the sink's root, under the batch's
number and replacing what an earlier attempt left there; a batch that is run again after
a failure therefore changes nothing. Nothing is kept on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.operators import latencies
from estatelens.operators.requests import RING, newest
from estatelens.session import drop_path, is_file, list_folders

MERGE_EVERY = 16  # batches

# --- fixed values: must equal the reference's for right results ---------------------
LATENESS = "300 seconds"
BUCKET = "1 second"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files as a stream; the path names a folder of files or one file."""
    schema = spark.read.parquet(path).schema
    folder, pattern = path, "*.parquet"
    if is_file(spark, path):
        folder, _, pattern = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


class Sink:
    """Where a streaming query keeps its batches and its progress.

    The root is the caller's: a later process that names the same root goes on where the
    last one stopped.
    """

    def __init__(self, spark: SparkSession, root: str, merge_every: int = MERGE_EVERY):
        self.spark, self.root, self.merge_every = spark, root.rstrip("/"), merge_every

    def batch_path(self, batch: int) -> str:
        return f"{self.root}/rows/batch={batch}"

    def _drop_before(self, batch: int) -> None:
        for name in list_folders(self.spark, f"{self.root}/rows"):
            if name.startswith("batch=") and int(name.removeprefix("batch=")) < batch:
                drop_path(self.spark, f"{self.root}/rows/{name}")

    def _drain(self, stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None]) -> "Sink":
        """Process everything there is now, going on from the last run's progress."""
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{self.root}/progress")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
        return self

    def replace(self, stream: DataFrame, mode: str = "complete", merge: Callable[[DataFrame, int], DataFrame] | None = None) -> "Sink":
        """Keep one table: every batch writes it anew, read by `latest`.

        When batch n runs, n - 1 is done, so all before it goes and n can be run again.
        """
        def write(rows: DataFrame, batch: int) -> None:
            self._drop_before(batch - 1)
            kept = rows if merge is None else merge(rows, batch)
            kept.write.mode("overwrite").parquet(self.batch_path(batch))

        return self._drain(stream, mode, write)

    def update(self, stream: DataFrame, keys: list[str]) -> "Sink":
        """Keep the last version of every key, read by `updated`.

        Batches hold what changed. Each ``merge_every``-th one also takes in all before it,
        which are dropped when the next batch runs: the merged one is done by then.
        """
        def write(rows: DataFrame, batch: int) -> None:
            if batch and (batch - 1) % self.merge_every == 0:
                self._drop_before(batch - 1)
            if batch and batch % self.merge_every == 0:
                older = self.batches().where(F.col("batch") < batch)
                rows = self._last(older.unionByName(rows.withColumn("batch", F.lit(batch))), keys)
            rows.write.mode("overwrite").parquet(self.batch_path(batch))

        return self._drain(stream, "update", write)

    def batches(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def latest(self) -> DataFrame:
        """The table as the last batch left it."""
        rows = self.batches()
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")

    @staticmethod
    def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
        values = [c for c in rows.columns if c not in (*keys, "batch")]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
        return last.select(*keys, "v.*")

    def updated(self, keys: list[str]) -> DataFrame:
        """The last version of every key."""
        return self._last(self.batches(), keys)


def running_totals(events: DataFrame, *keys: str) -> DataFrame:
    """Exact counts since the beginning; no event is ever too late."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def latency_windows(
    events: DataFrame, ts: str, latency: str, size: str = BUCKET, lateness: str = LATENESS
) -> DataFrame:
    """Exact count and maximum and approximate p50 and p95 per tumbling window.

    Events of windows older than the lateness are left out.
    """
    timed = events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", lateness)
    stats = timed.groupBy(F.window("__at", size).alias("w")).agg(
        F.count(F.lit(1)).alias("count"),
        F.max(latency).alias("max"),
        F.percentile_approx(latency, [0.5, 0.95], 10000).alias("approx"),
    )
    return stats.select(
        F.col("w.start").alias("window_start"), "count", "max",
        F.col("approx")[0].alias("p50"), F.col("approx")[1].alias("p95"),
    )


def latency_histograms(
    events: DataFrame, ts: str, latency: str, size: str = BUCKET, lateness: str = LATENESS
) -> DataFrame:
    """(window_start, slot, n, max): the mergeable histogram of each tumbling window.

    The state is one count for each slot of a window that is not empty. Windows can be
    merged into longer ones after the stream, with percentiles within the slots' bounds.
    """
    timed = events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", lateness)
    found = latencies.histogram(timed, [F.window("__at", size).alias("w")], latency)
    return found.select(F.col("w.start").alias("window_start"), "slot", "n", "max")


def keep_ring(sink: Sink, events: DataFrame, n: int = RING) -> DataFrame:
    """The newest ``n`` events seen so far, merged batch by batch; never more than 2n rows."""
    def merge(rows: DataFrame, batch: int) -> DataFrame:
        if batch > 0:
            rows = rows.unionByName(sink.spark.read.parquet(sink.batch_path(batch - 1)))
        return newest(rows, n)

    return sink.replace(events, "append", merge).latest()


def numbered_ring(ring: DataFrame, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The ring with positions, newest first; its size bounds the one-partition window."""
    order = Window.orderBy(F.desc(ts), F.desc(id_col))
    return ring.withColumn("position", F.row_number().over(order))
