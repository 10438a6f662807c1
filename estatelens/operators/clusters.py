"""Owner archetypes by k-means over per-owner features."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.catalogues import words
from estatelens.functions.keyed import uniform
from estatelens.session import settle
from .histogram import check_floor, location_shares
from .joins import scalar

DEFAULT_K = 5
RESTARTS = 10
PARALLEL_STARTS = 5
OWNERS_PER_PARTITION = 50_000
CORESET = 50_000  # owners expected in the coreset at most


def coreset(points: DataFrame, owner: str, x: str, size: int = CORESET, seed: int = 42) -> DataFrame:
    """(owner, x, weight): owners that stand for all owners in a fit of clusters.

    An owner's chance is half an even share of ``size`` and half its share of the squared
    distances from the mean, which is 0 for standardised features, so far owners are nearly
    sure to be in; its weight is one over its chance. Weighted costs are right on average
    for any centres. The draw depends on seed and owner only. Up to ``size`` / 2 owners
    all are in, with weight 1.
    """
    square = F.aggregate(F.transform(vector_to_array(x), lambda v: v * v), F.lit(0.0), lambda a, v: a + v)
    # Sums of squares in whole millionths do not depend on the order in which they are added up.
    far = points.select(owner, x, F.floor(square * 1e6).cast("decimal(38,0)").alias("__far"))
    n, total = far.agg(F.count(F.lit(1)), F.sum("__far")).first()
    share = F.lit(0.5 / max(n, 1)) + F.col("__far").cast("double") / F.lit(2.0 * float(total or 1))
    drawn = far.withColumn("__chance", F.least(F.lit(1.0), F.lit(float(size)) * share))
    drawn = drawn.where(uniform(seed, "coreset", owner) < F.col("__chance"))
    return drawn.select(owner, x, (F.lit(1.0) / F.col("__chance")).alias("weight"))


def cluster_owners(
    features: DataFrame, owner: str, columns: list[str], k: int = DEFAULT_K, seed: int = 42, size: int = CORESET
) -> DataFrame:
    """Each owner with its cluster: standardised features, best of ten starts by cost.

    The starts run on a weighted coreset of the owners, about ``size`` of them however many
    there are; one pass over all owners then gives each its cluster.
    """
    # Scaling, drawing and the last pass read the features, so their lineage is cut once.
    settled = settle(features)
    n = settled.count()
    k = max(1, min(int(k), n))
    wide = Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
    ]).fit(settled).transform(settled)
    if k == 1:
        return settled.withColumn("cluster", F.lit(0))
    # Starting points are drawn per partition, so the layout is made a function of the
    # owners alone.
    parts = 8 + min(n, size) // OWNERS_PER_PARTITION
    vectors = (
        coreset(wide, owner, "__x", size, seed).repartition(parts, owner).sortWithinPartitions(owner)
        .select("__x", "weight").persist()
    )
    def fit(start: int):
        return KMeans(k=k, seed=seed + start, featuresCol="__x", predictionCol="cluster", weightCol="weight").fit(vectors)

    # The starts are independent jobs, so a few of them run side by side.
    with ThreadPoolExecutor(PARALLEL_STARTS) as pool:
        fits = list(pool.map(inheritable_thread_target(features.sparkSession)(fit), range(RESTARTS)))
    # Starts that end in the same clusters differ in the last digits of their cost only;
    # the first of them is taken, so the numbering does not depend on those digits.
    costs = [float(f"{m.summary.trainingCost:.9e}") for m in fits]
    best = fits[costs.index(min(costs))]
    vectors.unpersist()
    return best.transform(wide).drop("__raw", "__x")


def archetypes(
    clustered: DataFrame, k: int, min_size: int, location_columns: list[str], prefix: str = "loc__"
) -> tuple[DataFrame, DataFrame]:
    """Exactly ``k`` archetypes with weight and statistics, and their location shares.

    A cluster nobody fell into keeps a row of zeros and only the folded location.
    """
    check_floor(min_size)
    spark = clustered.sparkSession
    ids = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    total = scalar(clustered.agg(F.count(F.lit(1))))
    stats = clustered.groupBy("cluster").agg(
        (F.count(F.lit(1)) / total).alias("weight"),
        *[
            f(F.col(c).cast("double")).alias(f"{c}_{name}")
            for c in ("rg_count", "resource_count")
            for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
        ],
        F.avg("tag_density").alias("tag_density_mean"),
        F.stddev_pop("tag_density").alias("tag_density_std"),
    )
    label = F.concat(F.lit("archetype-"), F.col("cluster").cast("string"))
    summary = ids.join(stats, "cluster", "left").na.fill(0.0).withColumn("id", label)
    pairs = F.array(*[
        F.struct(F.lit(c[len(prefix):]).alias("location"), F.col(f"`{c}`").alias("n"))
        for c in location_columns
    ])
    counts = (
        clustered.select("cluster", F.explode(pairs).alias("p"))
        .groupBy("cluster", "p.location")
        .agg(F.sum("p.n").alias("n"))
        .where(F.col("n") > 0)
    )
    found = location_shares(counts, min_size, ["cluster"])
    bare = ids.join(found, "cluster", "left_anti").select(
        "cluster", F.lit(words.OTHER).alias("location"), F.lit(1.0).alias("share")
    )
    return summary, found.unionByName(bare).withColumn("id", label)
