"""Statistics over served requests (ts, route, status, latency)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions.periods import status_class, window_cutoff
from .quantiles import counted_values, interpolated_of, nearest_rank_of

# --- fixed values: must equal the reference's for right results ---------------------
RING = 2000
BUCKETS = 300
BUCKET_SECONDS = 1


def newest(df: DataFrame, n: int = RING, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The last ``n`` events, newest first."""
    return df.orderBy(F.desc(ts), F.desc(id_col)).limit(n)


def request_totals(df: DataFrame, *keys: str) -> DataFrame:
    """Exact counts per (status, route) or any other keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def recent_latency(df: DataFrame, latency: str, n: int = RING) -> DataFrame:
    """p50, p95 and max over the newest ``n`` events; zeros when there are none.

    At most ``n`` rows are left, so the percentiles need no further care.
    """
    ring = newest(df, n)
    return ring.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {latency})"), F.lit(0.0)).alias("p50"),
        F.coalesce(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {latency})"), F.lit(0.0)).alias("p95"),
        F.coalesce(F.max(latency), F.lit(0.0)).alias("max"),
    )


def bucket(ts: str, seconds: int) -> Column:
    """Number of the time bucket since the epoch."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def latency_series(df: DataFrame, ts: str, latency: str, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Exact count, p50, p95 and max per non-empty bucket."""
    placed = df.select(bucket(ts, seconds).alias("bucket"), F.col(latency).alias("latency"))
    values = counted_values(placed, ["bucket"], "latency")
    ranks = nearest_rank_of(values, ["bucket"], {"p50": 0.5, "p95": 0.95, "max": 1.0})
    counts = values.groupBy("bucket").agg(F.sum("__k").alias("count"))
    return counts.join(ranks.drop("n"), "bucket", "left")


def history(
    series: DataFrame, newest_bucket: Column | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """The last ``buckets`` buckets without gaps: count 0 and NULL percentiles where empty."""
    end = newest_bucket if newest_bucket is not None else series.agg(F.max("bucket")).scalar()
    spark = series.sparkSession
    every = spark.range(1).select(
        F.explode(F.sequence(end - (buckets - 1), end)).alias("bucket")
    )
    # ``buckets`` rows, so the broadcast is bounded.
    return (
        F.broadcast(every).join(series, "bucket", "left").na.fill(0, ["count"])
    )


def drilldown(
    df: DataFrame, ts: str, latency: str, now: Column, window: str = "all",
    status: str | None = None, classes: set[str] = frozenset(), route: str | None = None,
    route_col: str = "route", seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Latency series of the events that pass a status, route and window filter."""
    rows = df
    cutoff = window_cutoff(now, window)
    if cutoff is not None:
        rows = rows.where(F.col(ts) >= cutoff)
    if classes:
        rows = rows.where(status_class(status).isin(*sorted(classes)))
    if route is not None:
        rows = rows.where(F.col(route_col) == route)
    return latency_series(rows, ts, latency, seconds)


def sample_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """p50, p95, p99 by linear interpolation, with min, max and mean."""
    groups = by or []
    values = counted_values(df, groups, value)
    ranks = interpolated_of(values, groups, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    known = F.when(F.col("__v").isNotNull(), F.col("__k"))
    stats = values.groupBy(*groups).agg(
        F.min("__v").alias("min"), F.max("__v").alias("max"), (F.sum(F.col("__v") * F.col("__k")) / F.sum(known)).alias("mean"))
    if groups:
        return stats.join(ranks.drop("n"), groups, "left")
    return stats.select(*[ranks.select(p).scalar().alias(p) for p in ("p50", "p95", "p99")], "*")
