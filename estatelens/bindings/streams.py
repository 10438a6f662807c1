"""Request statistics, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.functions.periods import status_class
from estatelens.operators import latencies, requests as r
from estatelens.session import scratch_path, settle
from estatelens.streaming import requests as streaming
from . import tables as b
from .registry import query, with_views

HOUR = 3600


# --- batch: AGG-30..33, WIN-02, FN-19 ---------------------------------------------------

@query(
    "newest_requests",
    with_views(b.REQUESTS) + "SELECT event_id, route, latency FROM requests ORDER BY ts DESC, event_id DESC LIMIT 2000",
)
def newest_requests(spark, folder):
    return r.newest(b.requests(spark, folder)).select("event_id", "route", "latency")


@query("request_totals", with_views(b.REQUESTS) + "SELECT status, route, count(*) AS n FROM requests GROUP BY 1, 2")
def request_totals(spark, folder):
    return r.request_totals(b.requests(spark, folder), "status", "route")


@query(
    "recent_latency",
    with_views(b.REQUESTS, "ring AS (SELECT latency FROM requests ORDER BY ts DESC, event_id DESC LIMIT 2000)")
    + "SELECT count(*) AS n, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, max(latency) AS max FROM ring",
)
def recent_latency(spark, folder):
    return r.recent_latency(b.requests(spark, folder), "latency")


SERIES = """
series AS (SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS bucket, count(*) AS count,
  quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, max(latency) AS max FROM requests GROUP BY 1)
"""


@query("latency_series", with_views(b.REQUESTS, SERIES) + "SELECT * FROM series")
def latency_series(spark, folder):
    return r.latency_series(b.requests(spark, folder), "ts", "latency", HOUR)


@query(
    "latency_history",
    with_views(b.REQUESTS, SERIES.replace("3600000000", "60000000"))
    + "SELECT h.bucket, coalesce(count, 0) AS count, coalesce(p50, -1) AS p50, coalesce(p95, -1) AS p95, coalesce(max, -1) AS max "
    "FROM (SELECT unnest(generate_series((SELECT max(bucket) FROM series) - 299, (SELECT max(bucket) FROM series))) AS bucket) h LEFT JOIN series USING (bucket)",
)
def latency_history(spark, folder):
    found = r.history(r.latency_series(b.requests(spark, folder), "ts", "latency", 60))
    return found.na.fill(-1.0, ["p50", "p95", "max"])


@query(
    "latency_drilldown",
    with_views(
        b.REQUESTS,
        "kept AS (SELECT * FROM requests WHERE ts >= (SELECT max(ts) FROM requests) - INTERVAL 900 SECOND "
        "OR (status >= 500 AND route = 'error'))")
    + "SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS bucket, count(*) AS count, quantile_disc(latency, 0.5) AS p50, "
    "quantile_disc(latency, 0.95) AS p95, max(latency) AS max, 'errors' AS part FROM requests WHERE status >= 500 AND route = 'error' GROUP BY 1 "
    "UNION ALL SELECT CAST(floor(epoch_us(ts) / 60000000) AS BIGINT), count(*), quantile_disc(latency, 0.5), quantile_disc(latency, 0.95), max(latency), 'recent' "
    "FROM requests WHERE ts >= (SELECT max(ts) FROM requests) - INTERVAL 900 SECOND GROUP BY 1",
)
def latency_drilldown(spark, folder):
    rows = b.requests(spark, folder)
    now = rows.agg(F.max("ts")).scalar()
    errors = r.drilldown(rows, "ts", "latency", now, status="status", classes={"5xx"}, route="error", seconds=HOUR)
    recent = r.drilldown(rows, "ts", "latency", now, window="15m", seconds=60)
    return errors.withColumn("part", F.lit("errors")).unionByName(recent.withColumn("part", F.lit("recent")))


@query(
    "status_classes",
    with_views(b.REQUESTS)
    + "SELECT CAST(greatest(2, least(5, CAST(floor((status - 150) / 100) AS INT))) AS VARCHAR) || 'xx' AS class, count(*) AS n FROM requests GROUP BY 1",
)
def status_classes(spark, folder):
    rows = b.requests(spark, folder)
    return rows.groupBy(status_class(F.col("status") - 150).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "latency_summary",
    with_views(b.REQUESTS)
    + "SELECT route, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, "
    "round(quantile_cont(latency, 0.99), 6) AS p99, min(latency) AS min, max(latency) AS max, round(avg(latency), 6) AS mean FROM requests GROUP BY 1",
)
def latency_summary(spark, folder):
    found = r.sample_summary(b.requests(spark, folder), "latency", ["route"])
    return found.select(
        "route", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "min", "max", F.round("mean", 6).alias("mean"))


@query(
    "price_summary",
    "SELECT round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, "
    "round(quantile_cont(l_extendedprice, 0.99), 6) AS p99, min(l_extendedprice) AS min, max(l_extendedprice) AS max, "
    "round(avg(l_extendedprice), 4) AS mean FROM lineitem",
)
def price_summary(spark, folder):
    found = r.sample_summary(b.table(spark, folder, "lineitem"), "l_extendedprice")
    return found.select(
        *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "min", "max", F.round("mean", 4).alias("mean"))


# --- streaming: STR-01..05 --------------------------------------------------------------

def event_stream(spark, folder):
    return streaming.read_events(spark, f"{folder}/events.parquet").select(
        "event_id", "ts", F.col("event_type").alias("route"), F.col("value").alias("latency"),
        (200 + (F.col("user_id") % 5) * 100).cast("int").alias("status"))


@query("streamed_totals", with_views(b.REQUESTS) + "SELECT status, route, count(*) AS n FROM requests GROUP BY 1, 2")
def streamed_totals(spark, folder):
    sink = streaming.Sink(spark, scratch_path(spark, "totals"))
    return sink.replace(streaming.running_totals(event_stream(spark, folder), "status", "route")).latest()


@query(
    "streamed_windows",
    with_views(b.REQUESTS)
    + "SELECT CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS second, count(*) AS count, max(latency) AS max FROM requests GROUP BY 1",
)
def streamed_windows(spark, folder):
    sink = streaming.Sink(spark, scratch_path(spark, "windows"))
    sink.update(streaming.latency_windows(event_stream(spark, folder), "ts", "latency"), ["window_start"])
    return sink.updated(["window_start"]).select(
        F.unix_seconds("window_start").alias("second"), "count", "max")


@query(
    "streamed_late_requests",
    with_views(
        b.REQUESTS,
        "early AS (SELECT * FROM requests WHERE event_id % 2 = 0), mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 300 SECOND AS wm FROM early)",
        "kept AS (SELECT * FROM early UNION ALL SELECT * FROM requests WHERE event_id % 2 = 1 AND date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT wm FROM mark))")
    + "SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, count(*) AS count, max(latency) AS max FROM kept GROUP BY 1",
)
def streamed_late_requests(spark, folder):
    """Two arrivals, the second of them mostly too late for its windows."""
    arrivals = scratch_path(spark, "arrivals")
    rows, sink = b.requests(spark, folder), streaming.Sink(spark, scratch_path(spark, "late"))
    for parity in (0, 1):
        rows.where(F.col("event_id") % 2 == parity).write.mode("append").parquet(arrivals)
        stream = streaming.read_events(spark, arrivals)
        sink.update(streaming.latency_windows(stream, "ts", "latency", "1 hour"), ["window_start"])
    return sink.updated(["window_start"]).select(
        (F.unix_seconds("window_start") / HOUR).cast("long").alias("hour"), "count", "max")


@query(
    "streamed_ring",
    with_views(b.REQUESTS)
    + "SELECT event_id, route, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS position FROM requests "
    "QUALIFY position <= 2000",
)
def streamed_ring(spark, folder):
    ring = streaming.keep_ring(streaming.Sink(spark, scratch_path(spark, "ring")), event_stream(spark, folder))
    return streaming.numbered_ring(ring).select("event_id", "route", F.col("position").cast("long").alias("position"))


@query(
    "streamed_history",
    with_views(b.REQUESTS, "s AS (SELECT CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS bucket, count(*) AS c, max(latency) AS m FROM requests GROUP BY 1)")
    + "SELECT h.bucket, coalesce(c, 0) AS count, coalesce(m, -1) AS max FROM (SELECT unnest(generate_series((SELECT max(bucket) FROM s) - 299, (SELECT max(bucket) FROM s))) AS bucket) h "
    "LEFT JOIN s USING (bucket)",
)
def streamed_history(spark, folder):
    windows = streamed_windows(spark, folder).withColumnRenamed("second", "bucket")
    return r.history(windows).na.fill(-1.0, ["max"])


def slot_ends(value: str) -> str:
    """SQL for the bounds of the slot of a value of 0 or more: seven leading bits of thousandths."""
    n = f"CAST(floor({value} * 1000.0::DOUBLE) AS BIGINT)"
    shift = f"CAST(greatest(length(bin({n})) - 7, 0) AS BIGINT)"
    return f"(({n} >> {shift}) << {shift}) / 1000.0::DOUBLE AS {value}_low, ((({n} >> {shift}) + 1) << {shift}) / 1000.0::DOUBLE AS {value}_high"


WANTED = {"p50": 0.5, "p95": 0.95}
MINUTES = """
exact AS (SELECT CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS bucket, count(*) AS count, max(latency) AS max,
  quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95 FROM requests GROUP BY 1),
minutes AS (SELECT bucket, count, max, """ + slot_ends("p50") + ", " + slot_ends("p95") + " FROM exact)"


def streamed_seconds(spark, folder):
    sink = streaming.Sink(spark, scratch_path(spark, "histograms"))
    sink.update(streaming.latency_histograms(event_stream(spark, folder), "ts", "latency"), ["window_start", "slot"])
    return sink.updated(["window_start", "slot"])


def minute_percentiles(spark, folder):
    minute = F.floor(F.unix_seconds("window_start") / 60).cast("bigint").alias("bucket")
    return latencies.percentiles(latencies.merged(streamed_seconds(spark, folder), [minute]), ["bucket"], WANTED)


@query("streamed_minute_percentiles", with_views(b.REQUESTS, MINUTES) + "SELECT * FROM minutes")
def streamed_minute_percentiles(spark, folder):
    """Seconds' histograms from the stream, merged into minutes; the SQL takes the slots of the exact percentiles."""
    return minute_percentiles(spark, folder)


@query(
    "streamed_percentile_history",
    with_views(b.REQUESTS, MINUTES)
    + "SELECT h.bucket, coalesce(count, 0) AS count, coalesce(max, -1) AS max, coalesce(p95_low, -1) AS p95_low, coalesce(p95_high, -1) AS p95_high "
    "FROM (SELECT unnest(generate_series((SELECT max(bucket) FROM minutes) - 299, (SELECT max(bucket) FROM minutes))) AS bucket) h LEFT JOIN minutes USING (bucket)",
)
def streamed_percentile_history(spark, folder):
    found = r.history(settle(minute_percentiles(spark, folder).drop("p50_low", "p50_high")))
    return found.na.fill(-1.0, ["max", "p95_low", "p95_high"])
