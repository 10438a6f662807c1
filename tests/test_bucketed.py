"""Joins and groups on stored buckets, hot keys among them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from estatelens.operators import latencies, serving
from estatelens.session import scratch_path
from estatelens.sources import bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_owners_roll_up_without_a_shuffle(spark):
    rnd = random.Random(5)
    owners = [(str(i),) for i in range(200)] + [(None,)]
    facts = {
        "many": [(str(rnd.randrange(250)),) for _ in range(3000)] + [("7",)] * 2000 + [(None,)] * 50,
        "few": [(str(rnd.randrange(10)),) for _ in range(40)],
        "none": [],
    }
    tables = {n: spark.createDataFrame(rows, "subscription_id string") for n, rows in {"owners": owners, **facts}.items()}
    folder = scratch_path(spark, "bucketed-test")
    bucketed.write_bucketed(tables, folder, "subscription_id", 16)
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    other.conf.set("spark.sql.adaptive.enabled", "false")
    even, hot = bucketed.read_bucketed(other, folder)
    assert {r[0] for r in hot["many"].distinct().collect()} >= {"7", None} and "7" not in {r[0] for r in even["many"].collect()}
    build = lambda t: serving.owner_rollup(t["owners"], {n: t[n] for n in facts})
    assert "Exchange" not in plan(build(even)) and "SortMergeJoin" in plan(build(even))
    got = {r[0]: tuple(r)[1:] for r in bucketed.on_both((even, hot), build).collect()}
    assert got == {o: tuple(sum(f[0] == o and o is not None for f in rows) for rows in facts.values()) for (o,) in owners}


def test_equal_ids_join_without_a_shuffle(spark):
    spark = spark.newSession()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    left = spark.range(500).select((F.col("id") % 90).alias("k"), F.col("id").alias("a")).unionByName(
        spark.range(400).select(F.lit(3).cast("long").alias("k"), F.col("id").alias("a")))
    right = spark.range(80).select(F.col("id").alias("k"), F.lit("x").alias("c"))
    folder = scratch_path(spark, "bucketed-test")
    bucketed.write_bucketed({"left": left, "right": right}, folder, "k", 8)
    parts = bucketed.read_bucketed(spark, folder)
    assert "Exchange" not in plan(parts[0]["left"].join(parts[0]["right"], "k"))
    got = bucketed.on_both(parts, lambda t: t["left"].join(t["right"], "k"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_a_lost_writer_leaves_no_store(spark, monkeypatch):
    folder = scratch_path(spark, "bucketed-test")
    tables = {"left": spark.range(10).withColumnRenamed("id", "k")}
    with monkeypatch.context() as m:
        m.setattr(bucketed, "CONTENTS", "rows/of/no/contents")
        bucketed.write_bucketed(tables, folder, "k", 4)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|contents"):
        bucketed.read_bucketed(spark, folder)
    bucketed.write_bucketed(tables, folder, "k", 4)
    assert bucketed.on_both(bucketed.read_bucketed(spark, folder), lambda t: t["left"]).count() == 10


def test_merged_histograms_hold_the_exact_percentiles(spark):
    rnd = random.Random(8)
    draw = (lambda: rnd.expovariate(0.01), lambda: 0.0, lambda: rnd.uniform(0, 0.2), lambda: 10.0 ** rnd.randint(-3, 12), lambda: -rnd.expovariate(0.1))
    rows = [(i % 3, i % 17, draw[rnd.randrange(5)]()) for i in range(4000)] + [(0, 1, None), (1, 2, math.nan), (4, 0, None)]
    df = spark.createDataFrame(rows, "hour int, minute int, latency double")
    whole = latencies.histogram(df, ["hour"], "latency")
    parts = latencies.merged(latencies.histogram(df, ["hour", "minute"], "latency"), ["hour"])
    counts = lambda h: {(r["hour"], r["slot"]): r["n"] for r in h.collect()}
    assert counts(whole) == counts(parts)
    wanted = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for r in latencies.percentiles(parts, ["hour"], wanted).collect():
        values = sorted(v for h, _, v in rows if h == r["hour"] and v is not None and not math.isnan(v))
        assert r["count"] == sum(h == r["hour"] for h, _, _ in rows)
        for name, p in wanted.items():
            low, high = r[f"{name}_low"], r[f"{name}_high"]
            if not values:
                assert low is None and high is None
                continue
            exact = values[math.ceil(p * len(values)) - 1]
            # one step, or a sixty-fourth of the value; a step's own rounding aside
            assert low - 1e-9 * abs(low) <= exact <= high + 1e-9 * abs(high)
            assert high - low <= max(0.001, min(abs(low), abs(high)) / 64) * (1 + 1e-9)
