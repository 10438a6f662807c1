"""Owner clusters from a weighted coreset."""

import random

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from estatelens.operators import clusters


def cost(rows, columns):
    """The squared distances of standardised features from their cluster's mean."""
    x = np.array([[r[c] for c in columns] for r in rows], dtype=float)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    label = np.array([r["cluster"] for r in rows])
    return sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in set(label))


def spread_owners(spark, n):
    rnd = random.Random(3)
    middles = [(0, 0, 0), (9, 1, 2), (2, 8, 7), (30, 30, 1)]
    rows = [(f"o{i}", *(m + rnd.gauss(0, 1) for m in middles[i % 3])) for i in range(n)]
    rows += [(f"far{i}", *(m + rnd.gauss(0, 1) for m in middles[3])) for i in range(n // 50)]
    return spark.createDataFrame(rows, "o string, a double, b double, c double")


def test_coreset_costs_nearly_as_little_as_all_owners(spark):
    owners, columns = spread_owners(spark, 6000).cache(), ["a", "b", "c"]
    whole = cost(clusters.cluster_owners(owners, "o", columns, 4).collect(), columns)
    small = clusters.cluster_owners(owners, "o", columns, 4, size=800)
    assert small.count() == owners.count()
    assert cost(small.collect(), columns) <= 1.01 * whole
    again = clusters.cluster_owners(owners.repartition(7), "o", columns, 4, size=800)
    assert {r.o: r.cluster for r in again.collect()} == {r.o: r.cluster for r in small.collect()}


def test_weights_stand_for_all_owners(spark):
    rows = [(f"o{i}", [float(i % 5 - 2), 40.0 if i == 17 else 0.0]) for i in range(5000)]
    points = spark.createDataFrame(rows, "o string, x array<double>").select("o", array_to_vector("x").alias("x"))
    drawn = clusters.coreset(points, "o", "x", 1000).collect()
    assert 850 < len(drawn) < 1150 and "o17" in {r.o for r in drawn}
    assert abs(sum(r.weight for r in drawn) - 5000) < 400 and min(r.weight for r in drawn) >= 1
    everyone = clusters.coreset(points, "o", "x", 10_000)
    assert everyone.count() == 5000 and everyone.agg(F.max("weight")).first()[0] == 1.0
    assert clusters.coreset(points.limit(0), "o", "x").count() == 0


def test_clusters_of_a_few_owners_are_the_best_there_are(spark):
    rnd = random.Random(9)
    columns = ["a", "b"]
    rows = [(f"o{i}", rnd.uniform(0, 1) + 2 * (i % 2), rnd.uniform(0, 3)) for i in range(9)]
    found = clusters.cluster_owners(spark.createDataFrame(rows, "o string, a double, b double"), "o", columns, 2).collect()
    every = []
    for mask in range(1, 2 ** 8):
        every.append(cost([{"a": a, "b": b, "cluster": mask >> i & 1} for i, (_, a, b) in enumerate(rows)], columns))
    assert cost(found, columns) <= min(every) * (1 + 1e-9)
