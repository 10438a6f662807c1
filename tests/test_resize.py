"""Resizing by largest remainders, against the same in plain integers."""

import random

import pytest
from pyspark.sql import functions as F

from estatelens.operators import sampling


def dealt(sizes, total):
    whole = sum(sizes.values())
    floors = {g: n * total // whole for g, n in sizes.items()}
    first = sorted(sizes, key=lambda g: (-(sizes[g] * total % whole), g))[:total - sum(floors.values())]
    return {g: f + (g in first) for g, f in floors.items()}


@pytest.mark.parametrize("total", [0, 1, 17, 1000, 10 ** 15])
def test_quotas_are_those_of_largest_remainders(spark, total):
    rng = random.Random(total)
    sizes = {f"g{i}": rng.choice([1, 2, 2, 3, 50, 10 ** 9]) for i in range(60)}
    df = spark.createDataFrame([*sizes.items(), ("none", 0)], "g string, size long")
    got = {r.g: r.quota for r in sampling.apportioned(df, ["g"], total).collect()}
    assert got == dealt(sizes, total) and sum(got.values()) == total
    assert sampling.apportioned(df.where("false"), ["g"], total).count() == 0


def test_a_trimmed_table_keeps_its_mix_and_what_is_referred_to(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") < 1200, "hot").when(F.col("id") < 1800, "b").otherwise("c").alias("g"))
    referenced = rows.where("id % 10 = 0")
    kept, added = sampling.resized(rows, ["g"], "id", 1000, 3, referenced)
    counts = {r.g: r["count"] for r in kept.groupBy("g").count().collect()}
    assert sum(counts.values()) == 1040 and counts == {"hot": 624, "b": 312, "c": 104}
    assert kept.join(referenced, "id", "left_semi").count() == 200 and added.agg(F.sum("quota")).first()[0] == 0
    same = sorted(r.id for r in sampling.resized(rows.repartition(5), ["g"], "id", 1000, 3, referenced)[0].collect())
    assert same == sorted(r.id for r in kept.collect())
    all_held, _ = sampling.resized(rows, ["g"], "id", 1000, 3, rows)
    assert all_held.count() == 2000
