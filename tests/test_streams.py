"""Late data, restarts and rings."""

from pyspark.sql import functions as F

from estatelens.streaming import requests as streaming
from estatelens.session import list_folders, scratch_path


def arrive(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, at long, route string, latency double").select(
        "event_id", F.timestamp_seconds("at").alias("ts"), "route", "latency").coalesce(1).write.mode("append").parquet(path)


def test_late_events_leave_the_windows_but_not_the_totals(spark):
    path = scratch_path(spark, "arrivals")
    windows, totals = (streaming.Sink(spark, scratch_path(spark, n)) for n in ("w", "t"))
    for rows in ([(1, 1000, "a", 5.0), (2, 1000, "a", 9.0), (3, 2000, "b", 1.0)],
                 [(4, 1650, "a", 7.0), (5, 1750, "a", 2.0), (6, 2000, "b", 8.0)]):
        arrive(spark, path, rows)
        events = streaming.read_events(spark, path)
        windows.update(streaming.latency_windows(events, "ts", "latency"), ["window_start"])
        totals.replace(streaming.running_totals(events, "route"))
    got = {r.s: (r["count"], r["max"]) for r in windows.updated(["window_start"]).withColumn("s", F.unix_seconds("window_start")).collect()}
    # 1650 is more than 300 s behind 2000 and comes too late; 1750 does not.
    assert got == {1000: (2, 9.0), 2000: (2, 8.0), 1750: (1, 2.0)}
    assert {r.route: r.n for r in totals.latest().collect()} == {"a": 4, "b": 2}


def test_ring_keeps_the_newest_over_batches(spark):
    path = scratch_path(spark, "arrivals")
    sink = streaming.Sink(spark, scratch_path(spark, "ring"))
    for start in (0, 50, 20):
        arrive(spark, path, [(start + i, start + i, "a", 1.0) for i in range(10)])
        ring = streaming.keep_ring(sink, streaming.read_events(spark, path), 12)
    assert sorted(r.event_id for r in ring.collect()) == [28, 29, *range(50, 60)]


def test_another_session_goes_on_from_the_same_root(spark):
    path, root = scratch_path(spark, "arrivals"), scratch_path(spark, "going-on")
    for i in range(7):
        session = spark.newSession()
        arrive(session, path, [(10 * i + j, 1000 + i + j, "a", float(i)) for j in range(2)])
        events = streaming.read_events(session, path)
        sums = streaming.Sink(session, f"{root}/sums", merge_every=2)
        sums.update(events.groupBy("ts").agg(F.count("*").alias("n"), F.max("latency").alias("max")), ["ts"])
        totals = streaming.Sink(session, f"{root}/totals").replace(streaming.running_totals(events, "route"))
        assert [r.n for r in totals.latest().collect()] == [2 * i + 2]
    got = {r.s: (r.n, r.max) for r in sums.updated(["ts"]).withColumn("s", F.unix_seconds("ts")).collect()}
    assert got == {1000: (1, 0.0), 1007: (1, 6.0), **{1000 + i: (2, float(i)) for i in range(1, 7)}}
    # merged batches and replaced tables are gone
    assert len(list_folders(spark, f"{root}/sums/rows")) <= 3
    assert len(list_folders(spark, f"{root}/totals/rows")) == 2
