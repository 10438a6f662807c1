"""Kernels against brute force, and their independence of partitioning."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from estatelens.functions import keyed, rewriting, text
from estatelens.functions.periods import timeframe_range
from estatelens.operators import histogram, paging, pairs, predicates, quantiles, ranking, sampling


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    rows = [(f"g{rng.randrange(4)}", float(rng.choice([0.0, -1.5, 3.25]) + rng.randrange(-50, 900) / 8)) for _ in range(3000)]
    rows += [("hot", float(i % 700)) for i in range(4000)] + [("one", 4.0)]
    return spark.createDataFrame(rows, "g string, v double"), rows


def test_nearest_rank_equals_sorting(values):
    df, rows = values
    found = {r.g: r for r in quantiles.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g in {r[0] for r in rows}:
        ordered = sorted(v for k, v in rows if k == g)
        for name, p in (("p50", 50), ("p95", 95)):
            rank = -(-p * len(ordered) // 100)
            assert found[g][name] == ordered[max(1, rank) - 1]


def test_interpolation_equals_inclusive_quantiles(values):
    df, rows = values
    found = {r.g: r for r in quantiles.interpolated(df, ["g"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    for g in {r[0] for r in rows} - {"one"}:
        cuts = statistics.quantiles([v for k, v in rows if k == g], n=100, method="inclusive")
        assert found[g].p50 == pytest.approx(cuts[49])
        assert found[g].p99 == pytest.approx(cuts[98])
    assert found["one"].p50 == found["one"].p99 == 4.0


def test_bucketed_rank_is_the_rank(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 3000, "hot").otherwise("cold")).withColumn(
        "b", F.floor(F.col("id") / 37).cast("int"))
    ranked = ranking.rank_in_buckets(df, ["g"], "b", [F.asc("id")])
    wrong = ranked.where(F.col("rank") != F.when(F.col("g") == "hot", F.col("id") + 1).otherwise(F.col("id") - 2999))
    assert wrong.isEmpty()


def test_exact_sample_depends_on_seed_and_key_only(spark):
    df = spark.range(20000).withColumn("g", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    quotas = spark.createDataFrame([("a", 17), ("b", 4000)], "g string, quota long")

    def draw(parts, seed=3):
        return {r.id for r in ranking.sample_exactly(df.repartition(parts), quotas, ["g"], ["id"], seed).collect()}

    first = draw(1)
    assert first == draw(8)
    assert first != draw(8, seed=4)
    assert sum(i % 3 == 0 for i in first) == 17 and len(first) == 4017


def test_top_n_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "k string, n int")
    top, rest = ranking.split_top(df, 2, [F.desc("n"), F.asc("k")], "k")
    assert [(r.k, r["rank"]) for r in top.orderBy("rank").collect()] == [("c", 1), ("a", 2)]
    assert [r.k for r in rest.collect()] == ["b"]


@pytest.mark.parametrize("bad", [4, 0, -1, 5.0, "5", None, True])
def test_floor_is_refused_not_clamped(spark, bad):
    df = spark.createDataFrame([("a", 9)], "k string, n int")
    with pytest.raises(histogram.PrivacyFloorError):
        histogram.drop_small(df, bad)


def test_fold_keeps_the_total_and_null_is_a_label(spark):
    df = spark.createDataFrame([("a", 9), ("b", 2), ("c", 1), (None, 7)], "k string, n int")
    folded = {r.k: r.n for r in histogram.fold_other(df, "k", 5).collect()}
    assert folded == {"a": 9, "__other__": 3, "None": 7}


def test_pairs_with_a_floor_equal_pairs_filtered(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(60), f"t{min(rng.randrange(12), rng.randrange(12))}") for _ in range(600)]
    df = spark.createDataFrame(rows, "g int, t string")
    plain = {(r.a, r.b): r.n for r in pairs.pair_counts(df, ["g"], "t").collect()}
    brute = {}
    members = {}
    for g, t in rows:
        members.setdefault(g, set()).add(t)
    for held in members.values():
        for a in held:
            for b in held:
                if a < b:
                    brute[a, b] = brute.get((a, b), 0) + 1
    assert plain == brute
    floored = {(r.a, r.b): r.n for r in pairs.pair_counts(df, ["g"], "t", 9).collect()}
    assert floored == {k: n for k, n in brute.items() if n >= 9}


@pytest.mark.parametrize("top", [1, 7, 1000])
def test_pages_concatenate_to_the_whole(spark, top):
    df = spark.range(23).select((F.col("id") * 3).alias("k"))
    seen, after = [], None
    while True:
        rows = paging.page(df, "k", after, top).collect()
        seen += [r.k for r in rows]
        after = rows[-1].next_after if rows else None
        if after is None:
            break
    assert seen == [i * 3 for i in range(23)]


def test_top_is_clamped():
    assert [paging.clamp_top(x) for x in (None, 0, -4, 5, 10**6)] == [100, 1, 1, 5, 1000]


def test_search_guards():
    for bad in ("", "  ", "***", "x" * 201):
        with pytest.raises(ValueError):
            predicates.normalise_term(bad)
    with pytest.raises(ValueError):
        predicates.violation_filter(severity="urgent")
    with pytest.raises(ValueError):
        predicates.where_tree(("xor", ("eq", "a", 1)))


def test_search_takes_wildcards_literally(spark):
    rows = spark.createDataFrame([("1", "a%b", "t", "o"), ("2", "aXb", "t", "o")], "id string, name string, type string, subscription_id string")
    parents = spark.createDataFrame([("o", "plain")], "subscription_id string, display_name string")
    assert [r.id for r in predicates.search(rows, parents, "A%B").collect()] == ["1"]


def test_timeframes():
    import datetime as dt

    day = dt.date(2024, 1, 15)
    assert timeframe_range("TheLastMonth", day) == (dt.date(2023, 12, 1), dt.date(2023, 12, 31))
    assert timeframe_range("TheLastYear", day) == (dt.date(2023, 2, 1), day)
    assert timeframe_range("WeekToDate", day) == (dt.date(2024, 1, 1), day)
    for name, custom in (("Decade", None), ("Custom", None), ("Custom", ("2024-02-31", "2024-03-01"))):
        with pytest.raises(ValueError):
            timeframe_range(name, day, custom)


def test_choice_follows_the_weights(spark):
    hist = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1), ("__other__", 5.0)], "label string, weight double")
    drawn = sampling.choose(spark.range(40000), hist, [], keyed.uniform(1, "t", "id"), "x").groupBy("x").count().collect()
    shares = {r.x: r["count"] / 40000 for r in drawn}
    assert set(shares) == {"a", "b", "c"}
    assert shares["a"] == pytest.approx(0.7, abs=0.01) and shares["c"] == pytest.approx(0.1, abs=0.01)


def test_all_zero_weights_count_as_equal(spark):
    hist = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "label string, weight double")
    drawn = sampling.choose(spark.range(4000), hist, [], keyed.uniform(1, "t", "id"), "x").groupBy("x").count().collect()
    assert all(abs(r["count"] - 2000) < 150 for r in drawn) and len(drawn) == 2


def test_long_histograms_use_the_same_join(spark):
    hist = spark.range(3000).select(F.format_string("l%05d", "id").alias("label"), F.lit(1.0).alias("weight"))
    drawn = sampling.choose(spark.range(6000), hist, [], keyed.uniform(2, "t", "id"), "x")
    assert drawn.where(F.col("x").isNull()).isEmpty()
    assert drawn.select("x").distinct().count() > 2300


def test_draws_have_the_right_moments(spark):
    df = spark.range(60000).select(
        keyed.normal(7, "n", "id").alias("z"),
        sampling.gamma(F.lit(2.5), F.lit(4.0), 7, "g", "id").alias("g"),
        sampling.gamma(F.lit(0.5), F.lit(2.0), 7, "h", "id").alias("h"))
    r = df.agg(F.avg("z").alias("z"), F.stddev("z").alias("s"), F.avg("g").alias("g"), F.variance("g").alias("gv"),
               F.avg("h").alias("h")).first()
    assert r.z == pytest.approx(0, abs=0.02) and r.s == pytest.approx(1, abs=0.02)
    assert r.g == pytest.approx(10, rel=0.02) and r.gv == pytest.approx(40, rel=0.05)
    assert r.h == pytest.approx(1, rel=0.03)


def test_trim_takes_the_largest_groups_and_spares_references(spark):
    rows = spark.range(100).withColumn("g", F.when(F.col("id") < 70, "big").when(F.col("id") < 90, "mid").otherwise("low"))
    referenced = rows.where("id < 10").select("id")
    kept = sampling.trim(rows, ["g"], "id", 45, 3, referenced)
    sizes = {r.g: r["count"] for r in kept.groupBy("g").count().collect()}
    assert sizes == {"big": 25, "mid": 20, "low": 10}
    assert kept.where("id < 10").count() == 10


def test_padding_goes_round_by_size(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 0), ("d", 1)], "g string, size long")
    quotas = {r.g: r.quota for r in sampling.pad_quotas(sizes, ["g"], 7, 1).collect()}
    assert quotas == {"a": 3, "b": 2, "d": 2}


def test_next_free_skips_taken_numbers_and_widens(spark):
    names = spark.createDataFrame([("o", "s-", i) for i in range(99)], "o string, stem string, k int")
    taken = spark.createDataFrame([("o", "s-02"), ("o", "s-5"), ("p", "s-01")], "o string, name string")
    got = sorted(r.name for r in sampling.next_free(names, ["o"], "stem", taken, "k", "name").collect())
    assert len(got) == len(set(got)) == 99
    assert "s-02" not in got and "s-01" in got and "s-05" in got and "s-100" in got


def test_references_are_rewritten_once(spark):
    text_ = '{"a":"/subscriptions/1/resourceGroups/x/p","b":"/subscriptions/2/resourceGroups/x/q","c":"/subscriptions/1/resourceGroups/y/"}'
    df = spark.createDataFrame([(text_, {"1/x": "y", "1/y": "z"}), ("none", {})], "t string, m map<string,string>")
    got = [r[0] for r in df.select(rewriting.rewrite_refs("t", "m")).collect()]
    assert got[0] == text_.replace("/1/resourceGroups/y", "/1/resourceGroups/z").replace("/1/resourceGroups/x", "/1/resourceGroups/y")
    assert got[1] == "none"


def test_names_and_types(spark):
    names = ["vm-prod-01", "", "a..b", "x-0123456789abcdef0123", "eastus_*"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(text.classify_name("n")).collect()]
    assert got == [["word", "env", "int"], None, ["word", "word"], None, ["region", "__other__"]]
    assert df.limit(1).select(text.resource_path(F.lit("s"), F.lit("g"), F.lit("microsoft.A/b/c"), "n")).first()[0] == (
        "/subscriptions/s/resourceGroups/g/providers/Microsoft.A/b/vm-prod-01/c/vm-prod-01")


def test_nothing_is_drawn_twice_for_one_key(spark):
    df = spark.range(1000).select(keyed.keyed_uuid(1, "u", "id").alias("u"))
    assert df.distinct().count() == 1000
    assert df.where(~F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).isEmpty()


def test_resizing_reaches_the_band_both_ways(spark):
    assert sampling.resize_plan(1000, 1000) == sampling.resize_plan(1049, 1000) == sampling.resize_plan(1000, 0) == (0, 0)
    assert sampling.resize_plan(2000, 1000) == (960, 0)
    assert sampling.resize_plan(500, 1000) == (0, 460)
    rows = spark.range(300).withColumn("g", F.col("id") % 7).withColumn("__key", F.col("id"))
    assert sampling.trim(rows, ["g"], "__key", 100, 1).count() == 200


def test_one_stem_holds_all_names(spark):
    names = spark.range(3000).select(F.lit("o").alias("o"), F.lit("vm-").alias("stem"), F.col("id").alias("k"))
    held = [n for n in range(1, 4000) if n % 7 in (1, 2) or 500 < n < 900]
    taken = spark.createDataFrame([("o", f"vm-{n:02d}") for n in held] + [("o", "vm-3"), ("p", "vm-03"), ("o", "db-03")], "o string, name string")
    got = [(r.k, r.name) for r in sampling.next_free(names, ["o"], "stem", taken, "k", "name").collect()]
    free = (n for n in range(1, 10000) if n not in set(held))
    assert sorted(got) == [(k, f"vm-{n:02d}") for k, n in zip(range(3000), free)]


def test_close_values_fill_many_ranges(spark):
    """Times of one day, which differ in the last digits only."""
    values = [1.7e9 + (i * 37 % 5000) / 10 for i in range(5000)]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("none", None)], "g string, v double")
    # Small ranges are joined at run time, which would leave one of so few rows.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = quantiles.counted_values(df, ["g"], "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert counts.groupBy("__b").count().agg(F.max("count")).first()[0] < 5000
    found = {r.g: r for r in quantiles.nearest_rank_of(counts, ["g"], {"p50": 0.5, "p95": 0.95}).collect()}
    assert set(found) == {"g"} and (found["g"].n, found["g"].p50, found["g"].p95) == (5000, sorted(values)[2499], sorted(values)[4749])


def test_ranges_are_ranked_where_they_are_sorted(spark):
    rows = [(g, i) for g in (None, "a", "b") for i in (None, *range(40))]
    df = spark.createDataFrame(rows, "g string, i long").repartition(5, "i")
    first = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)
    whole = ranking.rank_in_ranges(df, [], ["g", "i"])
    assert [tuple(r) for r in whole.orderBy("rank").collect()] == [(*r, n) for n, r in enumerate(sorted(rows, key=first), 1)]
    grouped = sorted(map(tuple, ranking.rank_in_ranges(df, ["g"], ["i"]).collect()), key=first)
    assert grouped == [(*r, n % 41 + 1) for n, r in enumerate(sorted(rows, key=first))]
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "strategy=broadcast" in plan  # the rows neither move nor are sorted again
