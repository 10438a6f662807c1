"""Keyed sampling: weighted choices, expansion, resizing, cost draws.

Every draw is a function of the seed and a row key, so the same rows come out whatever
the partitioning, and again after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.catalogues import words
from estatelens.functions.keyed import key_hash, normal, uniform
from estatelens.session import settle
from .joins import beside, join_same, scalar
from .ranking import keyed_rank, rank_in_buckets, rank_in_ranges, sample_exactly

SLOTS = 256
GAMMA_TRIES = 64

# --- fixed values: must equal the reference's for right results ---------------------
TOLERANCE = 0.05
AIM = 0.04


def cumulative(hist: DataFrame, by: list[str], label: str, weight: str, keep_other: bool = False) -> DataFrame:
    """Upper end of each label's share of [0, 1), labels in order.

    The folded labels are never drawn; weights that are all zero count as equal.
    """
    sentinels = [words.MISC] if keep_other else [words.OTHER, words.MISC]
    clean = hist.where(~F.col(label).isin(*sentinels)).groupBy(*by, label).agg(F.sum(weight).alias("__w"))
    group = Window.partitionBy(*by)
    upto = group.orderBy(label).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("__w").over(group)
    share = F.when(total > 0, F.col("__w") / total).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(group))
    shared = clean.withColumn("__share", share)
    upper = F.sum("__share").over(upto)
    last = F.row_number().over(group.orderBy(F.desc(label))) == 1
    return shared.select(
        *by, label,
        F.greatest(F.lit(0.0), upper - F.col("__share")).alias("low"),
        F.when(last, F.lit(1.0)).otherwise(upper).alias("high"),
    )


def choose(
    df: DataFrame, hist: DataFrame, by: list[str], u: Column, out: str, label: str = "label",
    weight: str = "weight", keep_other: bool = False,
) -> DataFrame:
    """Draw one label per row from its group's histogram; NULL where there is none.

    [0, 1) is cut into slots and each slot lists the labels that reach into it, so rows
    meet labels by an equality join on (group, slot), however long the histogram is.
    """
    spans = cumulative(hist, by, label, weight, keep_other)
    first = F.least(F.floor(F.col("low") * SLOTS), F.lit(SLOTS - 1)).cast("int")
    last = F.least(F.floor(F.col("high") * SLOTS), F.lit(SLOTS - 1)).cast("int")
    slots = (
        spans.withColumn("__slot", F.explode(F.sequence(first, last)))
        .groupBy(*by, "__slot")
        .agg(F.sort_array(F.collect_list(F.struct("high", F.col(label).alias("label")))).alias("__spans"))
    )
    drawn = df.withColumn("__u", u).withColumn("__slot", F.floor(F.col("__u") * SLOTS).cast("int"))
    joined = join_same(drawn, slots, [*by, "__slot"], "left")
    ahead = F.filter("__spans", lambda s: s["high"] > F.col("__u"))
    picked = F.coalesce(F.get(ahead, F.lit(0)), F.element_at("__spans", -1))["label"]
    return joined.withColumn(out, picked).drop("__u", "__slot", "__spans")


def expand(df: DataFrame, count: str, position: str) -> DataFrame:
    """``count`` children per parent, numbered from 1; none for a count of 0."""
    return df.where(F.col(count) > 0).withColumn(
        position, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long")))
    )


def gamma(shape: Column, scale: Column, seed: int, purpose: str, *key) -> Column:
    """Gamma draw by the Marsaglia-Tsang method, tries keyed by their number.

    A try succeeds in more than 95 of 100 cases, and later ones are only evaluated where
    the earlier ones failed; that all of them fail is less likely than 1e-80. A rejected
    value is never used. Shapes below 1 are drawn one higher and scaled down.
    """
    low = shape < 1
    k = F.when(low, shape + 1).otherwise(shape)
    d = k - F.lit(1.0 / 3.0)
    c = F.lit(1.0) / F.sqrt(F.lit(9.0) * d)

    def attempt(number: Column) -> Column:
        z = normal(seed, f"{purpose}/gamma", number, *key)
        cube = F.pow(F.lit(1.0) + c * z, F.lit(3.0))
        u = F.lit(1.0) - uniform(seed, f"{purpose}/accept", number, *key)
        fits = (cube > 0) & (F.log(u) < z * z / 2 + d - d * cube + d * F.log(F.greatest(cube, F.lit(1e-300))))
        return F.when(fits, d * cube)

    later = F.sequence(F.lit(1), F.lit(GAMMA_TRIES))
    none = F.lit(None).cast("double")
    value = F.coalesce(attempt(F.lit(0)), F.aggregate(later, none, lambda got, i: F.coalesce(got, attempt(i))))
    boost = F.when(low, F.pow(F.lit(1.0) - uniform(seed, f"{purpose}/boost", *key), F.lit(1.0) / shape)).otherwise(1.0)
    return value * boost * scale


def cost_facts(
    resources: DataFrame, fits: DataFrame, periods: Column, seed: int, key: str = "id",
    owner: str = "subscription_id", default_type: str = "__default__",
) -> DataFrame:
    """One cost row per resource and period; no rows for a type without a fit.

    ``fits`` has type, mu and sigma, or shape and scale, for lognormal and gamma types; a
    row for ``__default__`` serves every other type. ``periods`` is an array of dates.
    """
    columns = {c: F.col(c) if c in fits.columns else F.lit(None).cast("double") for c in ("mu", "sigma", "shape", "scale")}
    table = fits.select("type", *[c.alias(f"__{n}") for n, c in columns.items()])
    known = table.where(F.col("type") != default_type).withColumn("__known", F.lit(True))
    default = table.where(F.col("type") == default_type).drop("type")
    rows = resources.select(key, owner, "type").join(known, "type", "left")
    mapped = rows.where(F.col("__known"))
    if not default.isEmpty():
        others = rows.where(F.col("__known").isNull()).select(key, owner, "type")
        mapped = mapped.drop("__known").unionByName(beside(others, default))
    monthly = mapped.withColumn("billing_period", F.explode(periods))
    who = (key, F.col("billing_period").cast("string"))
    lognormal = F.exp(F.col("__mu") + F.col("__sigma") * normal(seed, "cost", *who))
    amount = F.when(F.col("__shape").isNotNull(), gamma(F.col("__shape"), F.col("__scale"), seed, "cost", *who)).otherwise(lognormal)
    return monthly.select(
        F.col(key).alias("resource_id"), owner, "billing_period",
        F.greatest(F.lit(0.0), amount).alias("cost_amount"), F.lit("USD").alias("currency"))


def trim(rows: DataFrame, group: list[str], key: str, excess: int, seed: int, referenced: DataFrame | None = None) -> DataFrame:
    """``rows`` without ``excess`` of those nobody refers to, largest groups first.

    A row's level is its group's size less its rank in the group, so cutting the highest
    levels wears the largest groups down evenly; all rows are placed in one pass.
    """
    if excess <= 0:
        return rows
    free = rows if referenced is None else rows.join(referenced.select(key), key, "left_anti")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__size"))
    ranked = keyed_rank(free.select(*group, key), group, [key], seed, "trim", "__rank")
    # Levels fall from the largest size; negated they rise, as the bucket must.
    placed = join_same(ranked, sizes, group).withColumn("__level", F.col("__rank") - F.col("__size") - 1)
    order = [F.asc("__level"), F.asc("__hash"), F.asc(key)]
    victims = rank_in_buckets(
        placed.withColumn("__hash", key_hash(seed, "victim", key)), [], "__level", order, "__nth"
    ).where(F.col("__nth") <= excess)
    return rows.join(victims.select(key), key, "left_anti")


def pad_quotas(sizes: DataFrame, group: list[str], deficit: int, seed: int) -> DataFrame:
    """How many rows each non-empty group gets to make up a deficit, in turn by size."""
    ranked = rank_in_buckets(
        sizes.where(F.col("size") > 0).withColumn("__neg", -F.col("size"))
        .withColumn("__hash", key_hash(seed, "pad", *group)),
        [], "__neg", [F.asc("__neg"), F.asc("__hash"), *[F.asc(g) for g in group]], "__turn")
    n = scalar(sizes.where(F.col("size") > 0).agg(F.count(F.lit(1))))
    extra = F.when(F.col("__turn") <= F.lit(deficit) % n, 1).otherwise(0)
    return ranked.select(*group, (F.floor(F.lit(deficit) / n) + extra).cast("long").alias("quota")).where(F.col("quota") > 0)


def resize_plan(total: int, target: int) -> tuple[int, int]:
    """(rows to trim, rows to add) that bring a total within 5 % of its target."""
    if target <= 0 or target * (1 - TOLERANCE) <= total <= target * (1 + TOLERANCE):
        return 0, 0
    if total > target:
        return total - round(target * (1 + AIM)), 0
    return 0, round(target * (1 - AIM)) - total


def apportioned(sizes: DataFrame, group: list[str], total: int, size: str = "size") -> DataFrame:
    """``quota`` of each group with a size: shares of ``total`` by size, largest remainders rounded up.

    Quotas sum to ``total`` and differ from the exact share by less than one; ties go to the
    first group. Shares are whole numbers of 38 digits, and remainders are ranked in ranges,
    so the groups may be many.
    """
    held = sizes.where(F.col(size) > 0)
    whole = scalar(held.agg(F.sum(size).cast("decimal(19,0)")))
    shares = settle(held.withColumn("__dealt", F.col(size).cast("decimal(18,0)") * F.lit(total).cast("decimal(18,0)")).select(
        *group, F.call_function("div", "__dealt", whole).cast("long").alias("__floor"), (-(F.col("__dealt") % whole)).alias("__rest")))
    left = scalar(shares.agg(F.lit(total) - F.sum("__floor")))
    ranked = rank_in_ranges(shares, [], ["__rest", *group], "__nth")
    quota = F.col("__floor") + (F.col("__nth") <= left).cast("long")
    return ranked.select(*group, quota.alias("quota"))


def resized(rows: DataFrame, group: list[str], key: str, target: int, seed: int, referenced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows trimmed to within 5 % above ``target``, and the rows each group is to get where they are too few.

    Both are dealt by size, so the mix of groups stays: trimming takes rows that nobody
    refers to, in proportion to how many of them a group has. Where fewer are free than
    must go, all free ones go and the total stays above.
    """
    total = rows.count()
    excess, deficit = resize_plan(total, target)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    if not excess:
        return rows, apportioned(sizes, group, deficit)
    free = rows if referenced is None else rows.join(referenced.select(key), key, "left_anti")
    spare = free.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    quotas = apportioned(spare, group, min(excess, free.count()))
    victims = sample_exactly(free.select(*group, key), quotas, group, [key], seed, "resize")
    return rows.join(victims.select(key), key, "left_anti"), apportioned(sizes, group, 0)


def next_free(names: DataFrame, scope: list[str], stem: str, taken: DataFrame, key: str, out: str) -> DataFrame:
    """Give each row the first unused number behind its stem, two digits or more.

    ``taken`` has the scope columns and ``name``; ``key`` tells the rows of a stem apart
    and orders them. The j-th used number u has u - j free ones below it, so a row in
    place n stands behind the used ones with u - j < n: put in line with them, its rank is
    its number. Ranks are counted in ranges, so one stem may hold all rows.
    """
    spot = [*scope, stem]
    asked = rank_in_ranges(names, spot, [key], "__nth")
    number = F.regexp_extract("name", "^(.*-)([0-9]+)$", 2)
    used = taken.select(
        *scope, F.regexp_extract("name", "^(.*-)([0-9]+)$", 1).alias(stem), number.try_cast("long").alias("__number"), "name"
    ).where(F.col("__number") > 0)
    # Only numbers written the way they would be written here can collide.
    used = used.where(F.col("name") == F.concat(F.col(stem), _padded(F.col("__number")))).select(*spot, "__number").distinct()
    used = rank_in_ranges(used, spot, ["__number"], "__j").select(
        *spot, (F.col("__number") - F.col("__j")).alias("__at"), F.col("__number").alias("__tie"), F.lit(True).alias("__used"))
    line = asked.withColumns({"__at": F.col("__nth"), "__tie": F.lit(0).cast("long"), "__used": F.lit(False)}).unionByName(
        used, allowMissingColumns=True)
    placed = rank_in_ranges(line, spot, ["__at", "__used", "__tie"], "__number").where(~F.col("__used"))
    return placed.withColumn(out, F.concat(F.col(stem), _padded(F.col("__number")))).select(*names.columns, out)


def _padded(number: Column) -> Column:
    text = number.cast("string")
    return F.when(number < 10, F.concat(F.lit("0"), text)).otherwise(text)
