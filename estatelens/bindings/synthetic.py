"""Seeded draws over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from estatelens.functions.keyed import bernoulli, keyed_uuid, normal, normal_count, skewed_count, uniform
from estatelens.functions.periods import month_periods
from estatelens.operators import sampling
from . import tables as b
from .registry import query, with_views

SEED = 42


def sql_uniform(purpose, key, seed=SEED):
    """The draw of `keyed.uniform` in SQL."""
    return f"((CAST('0x' || substr(md5('{seed}:{purpose}:' || {key}), 1, 15) AS UBIGINT) // 128) / 9007199254740992.0::DOUBLE)"


def sql_normal(purpose, key):
    return (
        f"(sqrt(-2 * ln(1 - {sql_uniform(purpose + '/radius', key)})) * cos({2 * math.pi!r}::DOUBLE * {sql_uniform(purpose + '/angle', key)}))")


# --- single draws over the given tables: SAM-01..05, SAM-09 -----------------------------

@query(
    "drawn_locations",
    with_views(
        b.SCAN, "h AS (SELECT o_orderpriority AS p, location AS label, count(*) AS w FROM scan GROUP BY 1, 2)",
        "c AS (SELECT p, label, sum(w) OVER (PARTITION BY p ORDER BY label) / sum(w) OVER (PARTITION BY p) AS high FROM h)",
        f"d AS (SELECT o_orderkey, o_orderpriority AS p, {sql_uniform('place', 'o_orderkey')} AS u FROM orders)",
        "drawn AS (SELECT o_orderkey, d.p, arg_min(label, high) AS location FROM d LEFT JOIN c ON c.p = d.p AND high > u GROUP BY 1, 2)")
    + "SELECT p AS o_orderpriority, location, count(*) AS n FROM drawn GROUP BY 1, 2",
)
def drawn_locations(spark, folder):
    """A location for every order, drawn from the suppliers' nations per priority."""
    hist = b.scan_rows(spark, folder, "resource_group", "location").groupBy(
        F.col("resource_group").alias("o_orderpriority"), F.col("location").alias("label")).agg(F.count(F.lit(1)).alias("weight"))
    rows = sampling.choose(
        b.table(spark, folder, "orders"), hist, ["o_orderpriority"], uniform(SEED, "place", "o_orderkey"), "location")
    return rows.groupBy("o_orderpriority", "location").agg(F.count(F.lit(1)).alias("n"))


@query(
    "drawn_counts",
    # The lognormal draw of mean 20 and deviation 40 has a log-variance of ln 5.
    f"WITH z AS (SELECT o_orderpriority, {sql_normal('z', 'o_orderkey')} AS z, {sql_uniform('flip', 'o_orderkey')} AS u FROM orders) "
    "SELECT o_orderpriority, round(avg(greatest(0, least(60, round_even(20 + 4 * z, 0)))), 4) AS a, "
    "round(avg(greatest(0, round_even(exp(ln(20) - ln(5) / 2 + sqrt(ln(5)) * z), 0))), 4) AS c, "
    "round(avg((u < 0.25)::INT), 4) AS p FROM z GROUP BY 1",
)
def drawn_counts(spark, folder):
    """Normal, lognormal and Bernoulli draws for every order, with their averages."""
    z = normal(SEED, "z", "o_orderkey")
    rows = b.table(spark, folder, "orders").select(
        "o_orderpriority", normal_count(F.lit(20.0), F.lit(4.0), z, 0, 60).alias("a"),
        skewed_count(F.lit(20.0), F.lit(40.0), z).alias("c"), bernoulli(0.25, SEED, "flip", "o_orderkey").cast("int").alias("p"))
    return rows.groupBy("o_orderpriority").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("a", "c", "p")])


@query(
    "drawn_cost_rows",
    with_views(b.ESTATE)
    + "SELECT type, 12 * count(*) AS n, true AS positive FROM estate WHERE type IN ('Microsoft.Web/sites', 'Microsoft.KeyVault/vaults') GROUP BY 1",
)
def drawn_cost_rows(spark, folder):
    """Twelve months of cost for the types with a fit; the others get none."""
    fits = b.estate_rows(spark, folder).where(
        F.col("type").isin("Microsoft.Web/sites", "Microsoft.KeyVault/vaults")
    ).groupBy("type").agg(F.avg(F.log("amount")).alias("mu"), F.stddev_pop(F.log("amount")).alias("sigma"))
    shaped = fits.select(
        "type", "mu", "sigma", F.when(F.col("type") == "Microsoft.KeyVault/vaults", 2.5).alias("shape"), F.lit(10.0).alias("scale"))
    rows = b.estate_rows(spark, folder).select("id", "subscription_id", "type")
    facts = sampling.cost_facts(rows, shaped, month_periods(F.lit("2024-01-01").cast("date")), SEED)
    return facts.join(rows.select(F.col("id").alias("resource_id"), "type"), "resource_id").groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("cost_amount") > 0).alias("positive"))


@query(
    "trimmed_rows",
    "SELECT count(*) - least(2000, count(*) FILTER (o_orderstatus <> 'F')) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS referenced FROM orders",
)
def trimmed_rows(spark, folder):
    """Two thousand orders fewer, none of them referenced, the largest customers first."""
    orders = b.table(spark, folder, "orders")
    referenced = orders.where("o_orderstatus = 'F'")
    kept = sampling.trim(orders, ["o_custkey"], "o_orderkey", 2000, SEED, referenced)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("referenced"))


@query(
    "padding_quotas",
    "WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) SELECT size, CAST(2 * count(*) AS BIGINT) AS at_least, count(*) AS groups FROM s GROUP BY 1",
)
def padding_quotas(spark, folder):
    """Two rows and a bit for every customer with orders; the bit goes to the largest."""
    sizes = b.table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"))
    deficit = sizes.count() * 2 + 100
    quotas = sampling.pad_quotas(sizes, ["o_custkey"], deficit, SEED)
    return quotas.join(sizes, "o_custkey").groupBy("size").agg(
        F.sum(F.least(F.col("quota"), F.lit(2))).alias("at_least"), F.count(F.lit(1)).alias("groups"))


def sql_apportioned(source, total):
    """Largest remainders over (g, size) of ``source``."""
    return (
        f"SELECT g, f + (row_number() OVER (ORDER BY r DESC, g) <= t - sum(f) OVER ())::BIGINT AS quota FROM ("
        f"SELECT g, ({total}) AS t, CAST(size AS HUGEINT) * ({total}) // (SELECT sum(size) FROM {source}) AS f, "
        f"CAST(size AS HUGEINT) * ({total}) % (SELECT sum(size) FROM {source}) AS r FROM {source})")


GONE = f"(SELECT CAST(count(*) - round_even(round_even(count(*) * 0.7, 0) * {1 + sampling.AIM}, 0) AS BIGINT) FROM orders)"
SHORT = f"(SELECT CAST(round_even(round_even(count(*) * 1.3, 0) * {1 - sampling.AIM}, 0) - count(*) AS BIGINT) FROM orders)"


@query(
    "resized_groups",
    "WITH every AS (SELECT o_custkey AS g, count(*) AS size FROM orders GROUP BY 1), "
    "spare AS (SELECT o_custkey AS g, count(*) AS size FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), "
    f"cut AS ({sql_apportioned('spare', GONE)}), added AS ({sql_apportioned('every', SHORT)}) "
    "SELECT g AS o_custkey, CAST(size - coalesce(cut.quota, 0) AS BIGINT) AS kept, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_custkey = g AND o_orderstatus = 'F') AS referenced, "
    "CAST(coalesce(added.quota, 0) AS BIGINT) AS added, true AS near_less, true AS near_more "
    "FROM every LEFT JOIN cut USING (g) LEFT JOIN added USING (g)",
)
def resized_groups(spark, folder):
    """Each customer's orders in a table of 70 % and in one of 130 % of the rows; referenced orders all stay."""
    orders = b.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    n = orders.count()
    less, more = round(n * 0.7), round(n * 1.3)
    kept, _ = sampling.resized(orders, ["o_custkey"], "o_orderkey", less, SEED, orders.where("o_orderstatus = 'F'"))
    _, quotas = sampling.resized(orders, ["o_custkey"], "o_orderkey", more, SEED)
    counts = orders.groupBy("o_custkey").agg(F.lit(0).cast("long").alias("none")).join(kept.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("kept"), F.count_if(F.col("o_orderstatus") == "F").alias("referenced")), "o_custkey", "left")
    found = counts.join(quotas, "o_custkey", "left").select(
        "o_custkey", *[F.coalesce(c, "none").alias(a) for c, a in (("kept", "kept"), ("referenced", "referenced"), ("quota", "added"))])
    sums = found.agg(F.sum("kept").alias("k"), F.sum("added").alias("a"))
    near = lambda total, target: total.between(target * 0.95, target * 1.05)
    return found.withColumns({
        "near_less": near(sums.select("k").scalar(), less), "near_more": near(sums.select("a").scalar() + n, more)})


@query(
    "drawn_ids",
    f"WITH d AS (SELECT o_orderkey, sha256('{SEED}:resource:' || o_orderkey) AS h FROM orders) "
    "SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || "
    "substr('89ab', CAST(CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id, "
    "true AS shaped, true AS told_apart FROM d",
)
def drawn_ids(spark, folder):
    """A seeded id of version 4 and its variant for every order, each different from the others."""
    rows = b.table(spark, folder, "orders").select("o_orderkey", keyed_uuid(SEED, "resource", "o_orderkey").alias("id"))
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return rows.withColumns({"shaped": F.col("id").rlike(shape), "told_apart": repeated == 1})
