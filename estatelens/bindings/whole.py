"""Whole profiles: assembly, review, reading and writing, archetypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.operators.leaks import leaks
from estatelens.plans import profile as plan
from estatelens.session import scratch_path
from estatelens.sources import profiles
from estatelens.sources.scan import load_scan
from . import tables as b
from .registry import query, with_views

MIN = 200
NATIONS = [f"NATION_{i}" for i in range(25)]
# Each kind of part stands for a type of resource.
KINDS = {
    "ECONOMY": "microsoft.Compute/virtualMachines",
    "SMALL": "microsoft.Storage/storageAccounts",
    "MEDIUM": "microsoft.Network/networkSecurityGroups",
    "LARGE": "microsoft.KeyVault/vaults",
    "STANDARD": "microsoft.Web/sites",
    "PROMO": "microsoft.ContainerService/managedClusters",
}
FIELDS = {t.replace("microsoft.", "Microsoft."): ("diskSizeGB", "state") for t in KINDS.values()}
KIND_SQL = "CASE upper(%s) " + " ".join(
    f"WHEN '{kind}' THEN '{t.replace('microsoft.', 'Microsoft.')}'" for kind, t in KINDS.items()) + " END"
FINDINGS = {"view": "TAG_MISSING_ENV", "click": "VM_NO_BACKUP", "error": "VM_NO_BACKUP"}

_written: dict[tuple[str, str, str], str] = {}


def _once(spark, folder, what, write) -> str:
    """Path of a table that several queries read, written on first use."""
    key = (spark.sparkContext.applicationId, folder, what)
    if key not in _written:
        path = scratch_path(spark, what)
        write(path)
        _written[key] = path
    return _written[key]


def scan(spark, folder):
    """Five scan tables on disk, as an exporter leaves them."""
    def write(path):
        rows = b.scan_rows(
            spark, folder, "resource_id", "subscription_id", "resource_group", "type", "name", "location", "tags",
            "properties", "sku", "kind")
        names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
        kind = F.element_at(names, F.upper(F.regexp_extract("type", "\\.([^/]+)/", 1)))
        rows = rows.withColumn("properties", F.replace("properties", F.lit('"size"'), F.lit('"diskSizeGB"')))
        tables = {
            "subscriptions": b.estate_owners(spark, folder),
            "resource_groups": b.declared_groups(spark, folder),
            "resources": rows.withColumn("type", kind),
            "findings": b.table(spark, folder, "events").select(F.col("event_type").alias("finding_type")),
        }
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        # Bills use the scan ids in another casing; these are read back, so the tables are joined once.
        billed = spark.read.parquet(f"{path}/resources.parquet")
        billed.select(
            F.upper("resource_id").alias("resource_id"), F.lit("2024-01").alias("billing_month"),
            (F.length("resource_id") * 10.0).alias("amortized_cost_eur"),
        ).write.parquet(f"{path}/resource_costs.parquet")

    return load_scan(spark, _once(spark, folder, "scan", write))


def written_profile(spark, folder):
    def write(path):
        profile = plan.build_profile(
            scan(spark, folder), MIN, allow_no_terms=True, k=5, locations=NATIONS, property_fields=FIELDS,
            finding_codes=FINDINGS)
        profiles.write_profile(profile, path)

    return profiles.read_profile(spark, _once(spark, folder, "profile", write))


def shown(df):
    return df.select(
        "section", *[F.coalesce(f"key{i}", F.lit("")).alias(f"key{i}") for i in (1, 2, 3)],
        F.round("value", 8).alias("value"))


@query("profile")
def profile(spark, folder):
    return shown(written_profile(spark, folder))


MAIN = (
    "source_stats", "resource_types", "location_distribution", "tag_key_frequencies", "tag_value_cardinality",
    "untagged_rate_by_type", "violation_rates", "naming_patterns", "type_cooccurrence", "coverage")


@query(
    "profile_main_sections",
    with_views(
        b.SCAN, b.SCAN_TAGS,
        "kinds AS (SELECT " + KIND_SQL % "p_type" + " AS type, resource_group, subscription_id FROM scan)",
        "total AS (SELECT count(*) AS n FROM scan)",
        "tc AS (SELECT type, count(*) AS n FROM kinds GROUP BY 1)",
        "lc AS (SELECT location, count(*) AS n FROM scan GROUP BY 1)",
        "ec AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)",
        "pv AS (SELECT key, value, count(*) AS n FROM tag_pairs GROUP BY 1, 2)",
        "m AS (SELECT DISTINCT subscription_id, resource_group, type FROM kinds)",
        "pairs AS (SELECT x.type AS a, y.type AS b, count(*) AS n FROM m x JOIN m y USING (subscription_id, resource_group) "
        "WHERE x.type < y.type GROUP BY 1, 2)",
        "d AS (SELECT a AS s, b AS t, n FROM pairs WHERE n >= 200 UNION ALL SELECT b, a, n FROM pairs WHERE n >= 200)")
    + ("""SELECT section, key1, key2, '' AS key3, round(value, 8) AS value FROM (
SELECT 'source_stats' AS section, 'total_subscriptions' AS key1, '' AS key2, count(*)::DOUBLE AS value FROM customer
UNION ALL SELECT 'source_stats', 'total_resource_groups', '', 5.0 * count(*) FROM customer
UNION ALL SELECT 'source_stats', 'total_resources', '', n FROM total
UNION ALL SELECT 'resource_types', type, '', n / (SELECT sum(n) FROM tc WHERE n >= 200) FROM tc WHERE n >= 200
UNION ALL SELECT 'location_distribution', CASE WHEN n < 200 THEN '__other__' ELSE location END, '', sum(n) / (SELECT n FROM total) FROM lc GROUP BY 2
UNION ALL SELECT 'tag_key_frequencies', key, '', count(*) / (SELECT n FROM total) FROM tag_pairs WHERE key NOT LIKE 'hidden%' GROUP BY key
UNION ALL SELECT 'tag_value_cardinality', key, '', count(*) FILTER (n >= 200) FROM pv WHERE key NOT LIKE 'hidden%' GROUP BY key
UNION ALL SELECT 'untagged_rate_by_type', KIND, '', 1 - avg(has_tags::INT) FROM tagged GROUP BY 2
UNION ALL SELECT 'violation_rates', CASE event_type WHEN 'view' THEN 'TAG_MISSING_ENV' ELSE 'VM_NO_BACKUP' END, '', sum(n) / (SELECT n FROM total)
  FROM ec WHERE event_type IN ('view', 'click', 'error') AND n >= 200 GROUP BY 2
UNION ALL SELECT 'naming_patterns', '<word>-<word>-<int>', '', 1.0 FROM total
UNION ALL SELECT 'type_cooccurrence', s, t, n / sum(n) OVER (PARTITION BY s) FROM d
UNION ALL SELECT 'coverage', 'type_cooccurrence', CASE WHEN (SELECT count(*) FROM d) > 0 THEN 'derived' ELSE 'insufficient_coverage' END, 1.0
UNION ALL SELECT 'coverage', unnest(['tag_key_cooccurrence', 'tag_value_cardinality', 'untagged_rate_by_type',
  'naming_conventions', 'cost_distributions']), 'derived', 1.0
UNION ALL SELECT 'coverage', 'api_version', 'no_source', 1.0)""").replace("KIND,", KIND_SQL % "split_part(substr(type, 11), '/', 1)" + ","),
)
def profile_main_sections(spark, folder):
    found = shown(written_profile(spark, folder))
    return found.where(F.col("section").isin(*MAIN))


@query("profile_review")
def profile_review(spark, folder):
    return plan.review(written_profile(spark, folder))


@query(
    "profile_leaks",
    with_views(b.SCAN)
    + "SELECT 'location_distribution' AS section, count(*) AS leaks, CAST(max(length(location)) AS BIGINT) AS longest "
    f"FROM (SELECT location FROM scan GROUP BY 1 HAVING count(*) >= {MIN})",
)
def profile_leaks(spark, folder):
    """The names of nations and customers as terms, against the published locations."""
    return profile_leaks_by_section(spark, folder).where(F.col("section") == "location_distribution")


@query("profile_leaks_by_section")
def profile_leaks_by_section(spark, folder):
    """The names of nations and customers as terms, against every string of the profile."""
    terms = b.table(spark, folder, "nation").select(F.col("n_name").alias("term")).union(
        b.table(spark, folder, "customer").select("c_name"))
    found = leaks(plan.profile_strings(written_profile(spark, folder)), terms, "section", "text")
    return found.select("section", "leaks", F.col("longest").cast("long").alias("longest"))


@query("profile_document_read_back")
def profile_document_read_back(spark, folder):
    """The profile as a JSON document in lines, and back to the long form."""
    path = scratch_path(spark, "document")
    profiles.document_lines(written_profile(spark, folder)).write.text(path)
    return shown(profiles.read_document(spark, path, lines=True))


@query("owner_archetypes")
def owner_archetypes(spark, folder):
    found = written_profile(spark, folder)
    return shown(found.where(F.col("section").isin("archetypes", "archetype_locations")))
