"""Rows with something below them, against comparing all paths."""

import random

import pytest
from pyspark.sql import functions as F

from estatelens.operators import integrity


def above(a, b):
    return a != "" and b.startswith(a + "/")


def paths(seed, n):
    rng = random.Random(seed)
    parts = ["", "a", "b", "a-x", "a!", "a\u0000x", "a\u0001", "\u0000", "\u0001", "é", "日本", "z" * 40]
    return ["/".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_path_order_puts_what_is_below_directly_behind(spark, seed):
    ids = sorted(set(paths(seed, 400)))
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: r.p for r in df.select("id", integrity.path_order("id").alias("p")).collect()}
    order = sorted(ids, key=lambda i: got[i].encode())
    assert len(set(got.values())) == len(ids)
    for at, one in enumerate(order):
        below = [i for i in ids if i.startswith(one + "/")]
        assert set(order[at + 1:at + 1 + len(below)]) == set(below)


@pytest.mark.parametrize("parts", [1, 7])
def test_removable_rows_equal_comparing_all_paths(spark, parts):
    # Small ranges stay apart, so successors are carried from one to another.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 1)
    spark.conf.set("spark.sql.shuffle.partitions", "4" if parts == 1 else "60")
    try:
        check_removable(spark, parts)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def check_removable(spark, parts):
    ids = paths(5, 500) + ["/hot"] * 50 + [f"/hot/{i}" for i in range(120)] + ["", "/"]
    rows = spark.createDataFrame([(i, n) for n, i in enumerate(ids)] + [(None, -1)], "id string, n int").repartition(parts)
    referenced = random.Random(6).sample(ids, 40) + ["/nowhere/x", None]
    references = [spark.createDataFrame([(i,) for i in referenced], "target string")]
    got = sorted(r.n for r in integrity.removable(rows, references).collect())
    want = [-1] + [n for n, i in enumerate(ids) if i not in referenced and not any(above(i, j) for j in ids)]
    assert got == want
    below = {r.id for r in integrity.with_something_below(rows).collect()}
    assert below == {i for i in ids if any(above(i, j) for j in ids)}


def test_no_rows(spark):
    none = spark.createDataFrame([], "id string")
    assert integrity.removable(none, [none]).count() == 0
    one = spark.createDataFrame([("/a",), (None,)], "id string")
    assert integrity.removable(one, []).count() == 2
