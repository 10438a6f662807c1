"""Counting, folding and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.catalogues import words
from estatelens.functions import jsonmaps, text
from estatelens.operators import (
    costs, findings, histogram, names, pairs, quantiles, ranking, shapes, tags, templates, topology,
)
from estatelens.operators.integrity import complete_groups, complete_parents
from estatelens.operators.serving import totals
from . import tables as b
from .registry import query, with_views

MIN = 5
FOLD_AT = 400


def share(c: str = "share"):
    return F.round(c, 9).alias(c)


# --- AGG-01, 07..11 -------------------------------------------------------------------

@query("type_counts", with_views(b.SCAN) + "SELECT type, count(*) AS n FROM scan GROUP BY type")
def type_counts(spark, folder):
    return histogram.value_counts(b.scan_rows(spark, folder, "type"), "type").orderBy(F.desc("n"))


@query(
    "source_totals",
    "SELECT 'subscriptions' AS source, count(*) AS n FROM customer UNION ALL "
    "SELECT 'groups', 5 * count(*) FROM customer UNION ALL SELECT 'resources', count(*) FROM lineitem",
)
def source_totals(spark, folder):
    return totals({
        "subscriptions": b.table(spark, folder, "customer"),
        "groups": b.declared_groups(spark, folder),
        "resources": b.table(spark, folder, "lineitem"),
    }).withColumnRenamed("table", "source")


@query(
    "types_above_floor",
    with_views(b.SCAN) + f"SELECT type, count(*) AS n FROM scan GROUP BY type HAVING count(*) >= {FOLD_AT}",
)
def types_above_floor(spark, folder):
    return histogram.drop_small(type_counts(spark, folder), FOLD_AT)


@query(
    "folded_types",
    with_views(b.SCAN, "c AS (SELECT type, count(*) AS n FROM scan GROUP BY type)")
    + f"SELECT CASE WHEN n < {FOLD_AT} THEN '__other__' ELSE type END AS type, CAST(sum(n) AS BIGINT) AS n "
    "FROM c GROUP BY 1",
)
def folded_types(spark, folder):
    return histogram.fold_other(type_counts(spark, folder), "type", FOLD_AT)


@query(
    "type_shares",
    with_views(b.SCAN) + "SELECT type, round(count(*) / (SELECT count(*) FROM scan), 9) AS share FROM scan GROUP BY type",
)
def type_shares(spark, folder):
    return histogram.shares(type_counts(spark, folder)).select("type", share())


@query(
    "location_shares_by_owner",
    with_views(
        b.SCAN, "c AS (SELECT resource_group, location, count(*) AS n FROM scan GROUP BY 1, 2)")
    + "SELECT resource_group, location, round(n / sum(n) OVER (PARTITION BY resource_group), 9) AS share FROM c",
)
def location_shares_by_owner(spark, folder):
    rows = b.scan_rows(spark, folder, "resource_group", "location")
    counts = histogram.value_counts(rows, "resource_group", "location")
    return histogram.shares(counts, ["resource_group"]).select("resource_group", "location", share())


@query(
    "type_frequencies",
    with_views(b.SCAN, f"c AS (SELECT canonical, count(*) AS n FROM scan GROUP BY 1 HAVING count(*) >= {FOLD_AT})")
    + "SELECT canonical AS type, round(n / (SELECT sum(n) FROM c), 9) AS share FROM c",
)
def type_frequencies(spark, folder):
    return histogram.type_frequencies(type_counts(spark, folder), FOLD_AT).select("type", share())


LOCATION_FLOOR = 2400


@query(
    "location_distribution",
    with_views(
        b.SCAN, "c AS (SELECT location, count(*) AS n FROM scan GROUP BY 1)",
        f"f AS (SELECT CASE WHEN n < {LOCATION_FLOOR} THEN '__other__' ELSE location END AS location, sum(n) AS n FROM c GROUP BY 1)")
    + "SELECT location, round(n / (SELECT sum(n) FROM f), 9) AS share FROM f",
)
def location_distribution(spark, folder):
    counts = histogram.value_counts(b.scan_rows(spark, folder, "location"), "location")
    return histogram.location_shares(counts, LOCATION_FLOOR).select("location", share())


@query(
    "location_pivot",
    with_views(b.SCAN)
    + "SELECT subscription_id, "
    + ", ".join(
        f"CAST(count(*) FILTER (location = 'NATION_{i}') AS BIGINT) AS \"loc__NATION_{i}\"" for i in range(25))
    + " FROM scan GROUP BY subscription_id",
)
def location_pivot(spark, folder):
    rows = b.scan_rows(spark, folder, "subscription_id", "location")
    return histogram.pivot_counts(rows, "subscription_id", "location", [f"NATION_{i}" for i in range(25)])


# --- tags: AGG-02, 04..06, 12..14, 16..18 ---------------------------------------------

@query(
    "owner_features",
    with_views(b.SCAN_TAGS)
    + "SELECT subscription_id, count(*) AS resource_count, count(DISTINCT resource_group) AS rg_count, "
    "round(avg(CASE WHEN has_tags THEN 2 + (v2 IS NOT NULL)::INT + (v4 IS NOT NULL)::INT ELSE 0 END), 9) AS tag_density "
    "FROM tagged GROUP BY 1",
)
def owner_features(spark, folder):
    rows = b.scan_rows(spark, folder, "subscription_id", "resource_group", "tags")
    return tags.owner_features(rows).withColumn("tag_density", F.round("tag_density", 9))


@query("tag_key_counts", with_views(b.SCAN_TAGS) + "SELECT key, count(*) AS n FROM tag_pairs GROUP BY 1")
def tag_key_counts(spark, folder):
    return histogram.key_counts(b.scan_rows(spark, folder, "tags"), "tags")


@query(
    "event_property_histogram",
    "SELECT event_type, k AS field, json_extract_string(props, k) AS value, count(*) AS n "
    "FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1, 2, 3",
)
def event_property_histogram(spark, folder):
    return histogram.json_histogram(b.table(spark, folder, "events"), "props", ["event_type"])


@query("tag_value_counts", with_views(b.SCAN_TAGS) + "SELECT key, value, count(*) AS n FROM tag_pairs GROUP BY 1, 2")
def tag_value_counts(spark, folder):
    return tags.tag_value_counts(b.scan_rows(spark, folder, "tags"))


@query(
    "tag_coverage",
    with_views(b.SCAN_TAGS)
    + "SELECT type, count(*) AS total, CAST(count(*) FILTER (has_tags) AS BIGINT) AS tagged FROM tagged GROUP BY 1",
)
def tag_coverage(spark, folder):
    return tags.tag_coverage(b.scan_rows(spark, folder, "type", "tags"))


@query(
    "tag_key_frequencies",
    with_views(b.SCAN_TAGS)
    + "SELECT key, round(least(1, count(*) / (SELECT count(*) FROM lineitem)), 9) AS share FROM tag_pairs "
    "WHERE key NOT LIKE 'hidden-link:%' GROUP BY 1",
)
def tag_key_frequencies(spark, folder):
    rows = b.scan_rows(spark, folder, "tags")
    total = b.table(spark, folder, "lineitem").agg(F.count(F.lit(1))).scalar()
    return tags.key_frequencies(histogram.key_counts(rows, "tags"), total).select("key", share())


VALUE_FLOOR = 4000


@query(
    "tag_value_shares",
    with_views(
        b.SCAN_TAGS, "c AS (SELECT key, value, count(*) AS n FROM tag_pairs WHERE key IN ('Environment', 'CostCenter') GROUP BY 1, 2)",
        f"f AS (SELECT key, CASE WHEN n < {VALUE_FLOOR} THEN '__other__' ELSE value END AS value, sum(n) AS n FROM c GROUP BY 1, 2)")
    + "SELECT key, value, round(n / sum(n) OVER (PARTITION BY key), 9) AS share FROM f",
)
def tag_value_shares(spark, folder):
    counts = tags.tag_value_counts(b.scan_rows(spark, folder, "tags"), keys=words.VALUE_TAG_KEYS)
    return tags.value_shares(counts, VALUE_FLOOR).select("key", "value", share())


@query(
    "tag_value_cardinality",
    with_views(b.SCAN_TAGS, "c AS (SELECT key, value, count(*) AS n FROM tag_pairs GROUP BY 1, 2)")
    + f"SELECT key, CAST(count(*) FILTER (n >= {VALUE_FLOOR}) AS BIGINT) AS cardinality FROM c "
    "WHERE key NOT LIKE 'hidden-link:%' GROUP BY 1",
)
def tag_value_cardinality(spark, folder):
    return tags.value_cardinality(tag_value_counts(spark, folder), VALUE_FLOOR)


@query(
    "untagged_rates",
    with_views(b.SCAN_TAGS)
    + "SELECT 'Microsoft.' || substr(type, 11) AS type, round(1 - avg(has_tags::INT), 9) AS rate FROM tagged GROUP BY 1",
)
def untagged_rates(spark, folder):
    return tags.untagged_rates(tag_coverage(spark, folder)).select("type", share("rate"))


TAG_KEYS = "list_sort(list_filter(['Environment', CASE WHEN v2 IS NOT NULL THEN 'CostCenter' END, 'Owner', CASE WHEN v4 IS NOT NULL THEN 'hidden-link:x' END], lambda x: x IS NOT NULL))"
TAG_KEY_PAIRS = (
    f"keyed AS (SELECT row_number() OVER () AS i, {TAG_KEYS} AS ks FROM tagged WHERE has_tags), "
    "k AS (SELECT i, unnest(ks) AS k FROM keyed), "
    "pairs AS (SELECT x.k AS a, y.k AS b, count(*) AS n FROM k x JOIN k y ON x.i = y.i AND x.k < y.k GROUP BY 1, 2)"
)


@query("tag_key_pairs", with_views(b.SCAN_TAGS, TAG_KEY_PAIRS) + "SELECT a, b, n FROM pairs")
def tag_key_pairs(spark, folder):
    return pairs.key_pair_counts(b.scan_rows(spark, folder, "tags"), "tags")


@query(
    "tag_key_cooccurrence",
    with_views(
        b.SCAN_TAGS, TAG_KEY_PAIRS,
        "d AS (SELECT a AS source, b AS target, n FROM pairs WHERE a NOT LIKE 'hidden%' AND b NOT LIKE 'hidden%' "
        "UNION ALL SELECT b, a, n FROM pairs WHERE a NOT LIKE 'hidden%' AND b NOT LIKE 'hidden%')")
    + "SELECT source, target, round(n / sum(n) OVER (PARTITION BY source), 9) AS share FROM d",
)
def tag_key_cooccurrence(spark, folder):
    return pairs.key_cooccurrence(tag_key_pairs(spark, folder), MIN).select("source", "target", share())


SHAPE_FIELDS = {
    "Microsoft.parts/economy": ("size", "state"),
    "Microsoft.parts/large": ("size",),
    "Microsoft.parts/promo": ("state",),
    "Microsoft.parts/small": ("size", "state"),
}


@query(
    "type_shapes",
    with_views(
        """r AS (
  SELECT 'Microsoft.parts/' || lower(p_type) AS type, CAST(p_size % 8 AS VARCHAR) AS size,
    CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS state,
    CASE WHEN l_discount < 0.05 THEN l_returnflag END AS tier,
    CASE WHEN l_discount < 0.05 THEN CAST(CAST(floor(l_quantity) AS INT) % 4 AS VARCHAR) END AS family,
    CASE WHEN p_size > 25 THEN l_linestatus END AS kind
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
        "tops AS (SELECT type FROM r GROUP BY type ORDER BY count(*) DESC, type LIMIT 4)",
        """long AS (
  SELECT type, 'properties' AS part, 'size' AS field, size AS value FROM r
    WHERE type IN ('Microsoft.parts/economy', 'Microsoft.parts/large', 'Microsoft.parts/small')
  UNION ALL SELECT type, 'properties', 'state', state FROM r WHERE state IS NOT NULL
    AND type IN ('Microsoft.parts/economy', 'Microsoft.parts/promo', 'Microsoft.parts/small')
  UNION ALL SELECT type, 'sku', 'tier', tier FROM r WHERE tier IS NOT NULL
  UNION ALL SELECT type, 'sku', 'family', family FROM r WHERE family IS NOT NULL
  UNION ALL SELECT type, 'kind', 'kind', kind FROM r WHERE kind IS NOT NULL)""",
        "c AS (SELECT part, type, field, value, count(*) AS n FROM long WHERE type IN (SELECT type FROM tops) GROUP BY 1, 2, 3, 4)",
        "f AS (SELECT part, type, field, CASE WHEN n < 1200 THEN '__other__' ELSE value END AS value, sum(n) AS n FROM c GROUP BY 1, 2, 3, 4)")
    + "SELECT part, type, field, value, round(n / sum(n) OVER (PARTITION BY part, type, field), 9) AS share FROM f",
)
def type_shapes(spark, folder):
    rows = b.scan_rows(spark, folder, "type", "properties", "sku", "kind")
    rows = rows.withColumn("type", F.concat(F.lit("microsoft.parts/"), F.regexp_extract("type", "\\.([^/]+)/", 1)))
    frequencies = histogram.type_frequencies(histogram.value_counts(rows, "type"), MIN)
    return shapes.type_shapes(rows, frequencies, 1200, SHAPE_FIELDS, ("tier", "family"), 4).select(
        "part", "type", "field", "value", share())


# --- groups: JON-02, JON-03, AGG-15, 20, 21 -------------------------------------------

GROUP_SETS = """
res AS (SELECT subscription_id AS owner, lower(resource_group) AS g, list_sort(list(DISTINCT type)) AS type_set,
  count(*) AS resource_count, min(resource_group) AS name FROM scan GROUP BY 1, 2),
decl AS (SELECT subscription_id AS owner, lower(name) AS g, min(name) AS name FROM declared GROUP BY 1, 2),
sets AS (SELECT coalesce(res.owner, decl.owner) AS owner, coalesce(res.name, decl.name) AS resource_group,
  coalesce(type_set, []) AS type_set, coalesce(resource_count, 0) AS resource_count
  FROM decl FULL JOIN res ON decl.owner = res.owner AND decl.g = res.g)
"""


def group_sets(spark, folder):
    rows = b.scan_rows(spark, folder, "subscription_id", "resource_group", "type")
    return templates.group_type_sets(rows, b.declared_groups(spark, folder))


@query(
    "group_type_sets",
    with_views(b.SCAN, b.DECLARED_GROUPS, GROUP_SETS)
    + "SELECT owner, resource_group, array_to_string(type_set, ',') AS types, CAST(resource_count AS BIGINT) AS resource_count FROM sets",
)
def group_type_sets(spark, folder):
    return group_sets(spark, folder).select(
        "owner", "resource_group", F.array_join("type_set", ",").alias("types"), "resource_count")


TYPE_PAIRS = (
    "m AS (SELECT DISTINCT subscription_id, resource_group, p_type AS type FROM scan), "
    "pairs AS (SELECT x.type AS a, y.type AS b, count(*) AS n FROM m x JOIN m y USING (subscription_id, resource_group) "
    "WHERE x.type < y.type GROUP BY 1, 2)"
)
GROUP = ["subscription_id", "resource_group"]


def part_kinds(spark, folder):
    rows = b.scan_rows(spark, folder, "subscription_id", "resource_group", "type")
    return rows.withColumn("type", F.upper(F.regexp_extract("type", "\\.([^/]+)/", 1)))


@query("type_pairs", with_views(b.SCAN, TYPE_PAIRS) + "SELECT a, b, n FROM pairs")
def type_pairs(spark, folder):
    return pairs.pair_counts(part_kinds(spark, folder), GROUP, "type")


@query(
    "type_pairs_above_floor",
    with_views(
        b.SCAN, "m AS (SELECT DISTINCT subscription_id, resource_group, type FROM scan)",
        "pairs AS (SELECT x.type AS a, y.type AS b, count(*) AS n FROM m x JOIN m y USING (subscription_id, resource_group) "
        "WHERE x.type < y.type GROUP BY 1, 2)") + "SELECT a, b, n FROM pairs WHERE n >= 12",
)
def type_pairs_above_floor(spark, folder):
    rows = b.scan_rows(spark, folder, "subscription_id", "resource_group", "type")
    return pairs.pair_counts(rows, GROUP, "type", 12)


@query(
    "type_cooccurrence",
    with_views(
        b.SCAN, TYPE_PAIRS, "k AS (SELECT * FROM pairs WHERE n >= 5)",
        "d AS (SELECT a AS source, b AS target, n FROM k UNION ALL SELECT b, a, n FROM k)")
    + "SELECT source, target, round(n / sum(n) OVER (PARTITION BY source), 9) AS share FROM d",
)
def type_cooccurrence(spark, folder):
    return pairs.cooccurrence(type_pairs(spark, folder), MIN).select("source", "target", share())


@query(
    "line_price_stats",
    "SELECT p_brand, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, "
    "min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def line_price_stats(spark, folder):
    rows = b.table(spark, folder, "lineitem").join(
        b.table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return quantiles.distribution(rows, ["p_brand"], "l_extendedprice").select(
        "p_brand", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max")


KIND_SETS = """
res AS (SELECT subscription_id AS owner, resource_group AS g, list_sort(list(DISTINCT p_type)) AS comp, count(*) AS rc
  FROM scan GROUP BY 1, 2),
sets AS (SELECT coalesce(comp, []) AS comp, coalesce(rc, 0) AS rc FROM declared d
  FULL JOIN res ON d.subscription_id = res.owner AND d.name = res.g),
comps AS (SELECT comp, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, comp) AS r FROM sets GROUP BY 1),
fate AS (SELECT comp, n, r, (r <= 12 AND n >= 100 AND len(comp) > 0) AS alone,
  row_number() OVER (PARTITION BY (r <= 12 AND n >= 100 AND len(comp) > 0) ORDER BY r) - 1 AS i FROM comps),
placed AS (SELECT sets.*, alone, i FROM sets JOIN fate USING (comp))
"""


def kind_sets(spark, folder):
    return templates.group_type_sets(part_kinds(spark, folder), b.declared_groups(spark, folder))


@query(
    "group_templates",
    with_views(b.SCAN, b.DECLARED_GROUPS, KIND_SETS)
    + """SELECT 'template-' || i AS id, round(count(*) / (SELECT count(*) FROM sets), 9) AS weight,
  array_to_string(comp, ',') AS types, round(avg(rc), 6) AS mean, round(stddev_pop(rc), 6) AS std,
  CAST(min(rc) AS DOUBLE) AS min, CAST(max(rc) AS DOUBLE) AS max, -1.0::DOUBLE AS empty_share
FROM placed WHERE alone GROUP BY i, comp
UNION ALL
SELECT '__misc__', round(count(*) / (SELECT count(*) FROM sets), 9), '__misc__',
  round(avg(rc) FILTER (rc > 0), 6), round(stddev_pop(rc) FILTER (rc > 0), 6),
  CAST(min(rc) FILTER (rc > 0) AS DOUBLE), CAST(max(rc) FILTER (rc > 0) AS DOUBLE),
  round(avg((rc = 0)::INT), 9) FROM placed WHERE NOT alone""",
)
def group_templates(spark, folder):
    found, _ = templates.templates(kind_sets(spark, folder), 100, 12)
    return found.select(
        "id", F.round("weight", 9).alias("weight"), F.array_join("type_set", ",").alias("types"),
        F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max",
        F.round(F.coalesce("empty_share", F.lit(-1.0)), 9).alias("empty_share"))


@query(
    "folded_template_types",
    with_views(
        b.SCAN, b.DECLARED_GROUPS, KIND_SETS,
        "mass AS (SELECT unnest(comp) AS type, rc / len(comp) AS m FROM placed WHERE NOT alone AND len(comp) > 0)")
    + "SELECT type, round(sum(m) / (SELECT sum(m) FROM mass), 9) AS share FROM mass GROUP BY 1",
)
def folded_template_types(spark, folder):
    _, mass = templates.templates(kind_sets(spark, folder), 100, 12)
    return mass.select("type", share())


@query(
    "leading_types",
    with_views(b.SCAN)
    + "SELECT type, n, rank FROM (SELECT type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, type) AS rank "
    "FROM scan GROUP BY 1) WHERE rank <= 15",
)
def leading_types(spark, folder):
    top = ranking.top_n(type_counts(spark, folder), words.TOP_TYPES, [F.desc("n"), F.asc("type")])
    return top.withColumn("rank", F.col("rank").cast("long"))


# --- names: AGG-19, FN-04 -------------------------------------------------------------

CLASSES = """
CASE WHEN regexp_matches(tok, '^[0-9]+$') THEN 'int'
 WHEN lower(tok) IN ('prod', 'dev', 'test', 'uat', 'qa', 'stage') THEN 'env'
 WHEN regexp_matches(tok, '^[A-Za-z][A-Za-z0-9]*$') THEN 'word' ELSE '__other__' END"""
NAME_CLASSES = f"""
toks AS (SELECT id, name, list_filter(regexp_split_to_array(name, '[-_./]+'), lambda x: x <> '') AS ts FROM named),
flat AS (SELECT id, unnest(ts) AS tok, unnest(range(len(ts))) AS pos FROM toks WHERE len(ts) > 0
  AND len(list_filter(ts, lambda x: regexp_matches(x, '(?i)[0-9a-f]{{20,}}'))) = 0),
classed AS (SELECT id, pos, {CLASSES} AS cls FROM flat),
seqs AS (SELECT id, string_agg('<' || cls || '>', '-' ORDER BY pos) AS pattern FROM classed GROUP BY id)
"""
NAMED = """
named AS (SELECT 'p' || p_partkey AS id, replace(p_name, ' ', '_') || '.' || p_size || CASE WHEN p_size % 7 = 0 THEN '-prod' ELSE '' END
    || CASE WHEN p_size = 11 THEN '-0123456789abcdef0123456789' ELSE '' END AS name FROM part
  UNION ALL SELECT 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)"""


def named_rows(spark, folder):
    size = F.col("p_size")
    parts = b.table(spark, folder, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("id"),
        F.concat(
            F.translate("p_name", " ", "_"), F.lit("."), size,
            F.when(size % 7 == 0, "-prod").otherwise(""),
            F.when(size == 11, "-0123456789abcdef0123456789").otherwise(""),
        ).alias("name"))
    customers = b.table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey"), "c_name")
    suppliers = b.table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), "s_name")
    return parts.union(customers).union(suppliers)


@query(
    "name_classes",
    with_views(NAMED, NAME_CLASSES) + "SELECT named.id AS id, coalesce(pattern, '') AS pattern FROM named LEFT JOIN seqs USING (id)",
)
def name_classes(spark, folder):
    classes = text.classify_name("name")
    return named_rows(spark, folder).select("id", F.coalesce(text.name_pattern(classes), F.lit("")).alias("pattern"))


@query(
    "name_patterns",
    with_views(
        NAMED, NAME_CLASSES, "c AS (SELECT pattern, count(*) AS n FROM seqs GROUP BY 1)",
        "f AS (SELECT CASE WHEN n < 5 THEN '__other__' ELSE pattern END AS pattern, sum(n) AS n FROM c GROUP BY 1)")
    + "SELECT pattern, round(n / (SELECT sum(n) FROM f), 9) AS share FROM f",
)
def name_patterns(spark, folder):
    patterns, _ = names.name_patterns(named_rows(spark, folder), "name", MIN)
    return patterns.select("pattern", share())


@query(
    "name_positions",
    with_views(
        NAMED, NAME_CLASSES, "c AS (SELECT pos, cls, count(*) AS n FROM classed GROUP BY 1, 2)",
        "f AS (SELECT pos, CASE WHEN n < 5 THEN '__other__' ELSE cls END AS cls, sum(n) AS n FROM c GROUP BY 1, 2)")
    + "SELECT CAST(pos AS BIGINT) AS position, cls AS token_class, round(n / sum(n) OVER (PARTITION BY pos), 9) AS share FROM f",
)
def name_positions(spark, folder):
    _, positions = names.name_patterns(named_rows(spark, folder), "name", MIN)
    return positions.select(F.col("position").cast("long").alias("position"), "token_class", share())


# --- costs: JON-01, AGG-22 ------------------------------------------------------------

SAMPLES = """
bills AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'PART-' ELSE 'part-' END || l_partkey AS resource_id,
  strftime(l_shipdate, '%Y-%m') AS billing_month, l_extendedprice * (CASE WHEN l_returnflag = 'R' AND l_quantity < 9 THEN -1 ELSE 1 END) AS amount FROM lineitem),
samples AS (SELECT p_brand AS type, sum(amount) AS monthly_cost FROM bills JOIN part ON lower(resource_id) = 'part-' || p_partkey
  GROUP BY resource_id, billing_month, p_brand)
"""


def cost_samples_frame(spark, folder):
    lines = b.table(spark, folder, "lineitem")
    prefix = F.when(F.col("l_linenumber") % 2 == 0, "PART-").otherwise("part-")
    refund = (F.col("l_returnflag") == "R") & (F.col("l_quantity") < 9)
    bills = lines.select(
        F.concat(prefix, F.col("l_partkey")).alias("resource_id"),
        F.date_format("l_shipdate", "yyyy-MM").alias("billing_month"),
        (F.col("l_extendedprice") * F.when(refund, -1).otherwise(1)).alias("amount"))
    parts = b.table(spark, folder, "part").select(
        F.concat(F.lit("Part-"), "p_partkey").alias("resource_id"), F.col("p_brand").alias("type"))
    return costs.cost_samples(bills, parts, "amount")


@query(
    "cost_samples",
    with_views(SAMPLES) + "SELECT type, round(monthly_cost, 2) AS monthly_cost, count(*) AS n FROM samples GROUP BY 1, 2",
)
def cost_samples(spark, folder):
    return (
        cost_samples_frame(spark, folder)
        .groupBy("type", F.round("monthly_cost", 2).alias("monthly_cost"))
        .agg(F.count(F.lit(1)).alias("n")))


@query(
    "lognormal_fit",
    with_views(SAMPLES, "p AS (SELECT type, ln(monthly_cost) AS x FROM samples WHERE monthly_cost > 0)")
    + "SELECT type, 'lognormal' AS distribution, round(avg(x), 8) AS mu, round(stddev_pop(x), 8) AS sigma, "
    "count(*) AS sample_count FROM p GROUP BY type HAVING count(*) >= 5",
)
def lognormal_fit(spark, folder):
    fitted = costs.lognormal_fit(cost_samples_frame(spark, folder), "monthly_cost", MIN)
    return fitted.select(
        "type", "distribution", F.round("mu", 8).alias("mu"), F.round("sigma", 8).alias("sigma"), "sample_count")


# --- findings and topology: JON-08, JON-11, AGG-23, AGG-24 ----------------------------

FINDING_CODES = {"view": "SEEN", "click": "TOUCHED", "error": "TOUCHED"}


@query(
    "violation_rates",
    "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 5), "
    "m AS (SELECT CASE event_type WHEN 'view' THEN 'SEEN' WHEN 'click' THEN 'TOUCHED' WHEN 'error' THEN 'TOUCHED' "
    "WHEN 'signup' THEN 'signup' END AS code, n FROM c) "
    "SELECT code, round(least(1, sum(n) / (SELECT count(*) FROM lineitem)), 9) AS rate FROM m WHERE code IS NOT NULL GROUP BY 1",
)
def violation_rates(spark, folder):
    total = b.table(spark, folder, "lineitem").agg(F.count(F.lit(1))).scalar()
    rates = findings.violation_rates(
        b.table(spark, folder, "events"), total, MIN, ("signup",), FINDING_CODES, "event_type")
    return rates.select("code", share("rate"))


REFERRING = """
referring AS (SELECT CAST(l_suppkey % 40 AS VARCHAR) AS owner,
  CASE WHEN l_quantity > 30 THEN CAST(l_partkey % 50 AS VARCHAR) ELSE '' END AS target FROM lineitem),
crossing AS (SELECT * FROM referring WHERE target <> '' AND target <> owner),
signal AS (SELECT (SELECT count(*) FROM crossing) AS refs, (SELECT count(DISTINCT owner) FROM crossing) AS spokes,
  (SELECT count(DISTINCT target) FROM crossing) AS hubs, (SELECT count(*) FROM referring) AS total)
"""


def referring_rows(spark, folder):
    target = F.concat(
        F.lit('{"id":"/subscriptions/'), F.col("l_partkey") % 50, F.lit('/resourceGroups/x/subscriptions/999/"}'))
    return b.table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 40).cast("string").alias("subscription_id"),
        F.when(F.col("l_quantity") > 30, target).otherwise("{}").alias("properties"))


@query(
    "cross_owner_references",
    with_views(REFERRING)
    + "SELECT refs AS cross_ref_resources, spokes AS spoke_subscriptions, hubs AS hub_subscriptions, total AS total_resources FROM signal",
)
def cross_owner_references(spark, folder):
    return topology.cross_refs(referring_rows(spark, folder))


@query(
    "topology_odds",
    with_views(REFERRING)
    + """SELECT 'hub_spoke' AS pattern, 'probability' AS measure, round(greatest(0.70, least(1, spokes / total)), 9) AS value FROM signal
UNION ALL SELECT 'hub_spoke', 'hub_count_mean', hubs FROM signal UNION ALL SELECT 'hub_spoke', 'hub_count_std', 0 FROM signal
UNION ALL SELECT 'shared_keyvault', 'probability', 0.5 FROM signal
UNION ALL SELECT 'centralized_logging', 'probability', 0.6 FROM signal
UNION ALL SELECT 'shared_acr', 'probability', 0.3 FROM signal
UNION ALL SELECT 'private_endpoints', 'probability', round(refs / total, 9) FROM signal
UNION ALL SELECT 'private_endpoints', 'per_spoke_mean', round(refs / spokes, 9) FROM signal
UNION ALL SELECT 'private_endpoints', 'per_spoke_std', 0 FROM signal""",
)
def topology_odds(spark, folder):
    return topology.topology_odds(topology.cross_refs(referring_rows(spark, folder))).select(
        "pattern", "measure", F.round("value", 9).alias("value"))


# --- completing tables, tag keys: SRC-04..06 ------------------------------------------

@query(
    "generic_tags",
    with_views(b.TAGGED_DOCUMENTS)
    + "SELECT doc_id, lang AS country, source AS project, coalesce(CAST(quality AS VARCHAR), '') AS tier, "
    "CAST(2 + (quality IS NOT NULL)::INT AS BIGINT) AS keys FROM doc_tags",
)
def generic_tags(spark, folder):
    kept = jsonmaps.filter_map_keys(jsonmaps.json_map("tags"), words.GENERIC_TAG_KEYS)
    return b.tagged_documents(spark, folder).withColumn("m", kept).select(
        "doc_id", F.element_at("m", "Country").alias("country"), F.element_at("m", "project").alias("project"),
        F.coalesce(F.element_at("m", "Tier"), F.lit("")).alias("tier"), F.size("m").cast("long").alias("keys"))


@query(
    "completed_owners",
    "SELECT DISTINCT owner FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS owner FROM customer "
    "UNION ALL SELECT o_custkey FROM orders)",
)
def completed_owners(spark, folder):
    """Every third customer is declared under another key, so its orders' owner is missing."""
    key = F.col("c_custkey")
    declared = b.table(spark, folder, "customer").select(F.when(key % 3 == 0, key + 1_000_000_000).otherwise(key).alias("owner"))
    children = b.table(spark, folder, "orders").select(F.col("o_custkey").alias("owner"))
    return complete_parents(children, declared, "owner")


@query(
    "completed_groups",
    "WITH d AS (SELECT c_custkey AS owner, '5-low' AS name FROM customer), "
    "s AS (SELECT DISTINCT o_custkey AS owner, o_orderpriority AS name FROM orders) "
    "SELECT owner, name FROM d UNION ALL SELECT owner, name FROM s WHERE lower(name) <> '5-low'",
)
def completed_groups(spark, folder):
    declared = b.table(spark, folder, "customer").select(F.col("c_custkey").alias("owner"), F.lit("5-low").alias("name"))
    children = b.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("resource_group"))
    return complete_groups(declared, children, "owner")
