"""Fingerprints, change batches, scan and estate tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.functions.jsonmaps import revert_field
from estatelens.operators import drift, fingerprint, integrity
from estatelens.operators.paging import page
from estatelens.operators.serving import totals
from estatelens.plans import batches
from estatelens.session import scratch_path, settle
from estatelens.sources import estate as estate_io
from estatelens.sources import overlay
from estatelens.sources import scan as scan_io
from . import tables as b
from .registry import query, with_views

BATCH = "00000000-0000-4000-8000-000000000001"
SECOND = "00000000-0000-4000-8000-000000000002"
NO_BATCHES, NO_RECORDS = batches.BATCHES, batches.RECORDS


def state(spark, folder, spread=False):
    return b.estate_rows(spark, folder, spread).select(*drift.STATE_COLUMNS)


def first_batch(spark, folder, kind, **more):
    """The whole estate changed by every code of a kind."""
    rows = state(spark, folder)
    applied_at = rows.agg(F.max(drift.HIDE_PATH)).scalar()
    return drift.apply_changes(
        rows, spark.createDataFrame([], NO_BATCHES), spark.createDataFrame([], NO_RECORDS), BATCH, kind, applied_at, **more)


# --- fingerprints: AGG-34, AGG-35 -------------------------------------------------------

def sql_fingerprint(source: str, texts: str) -> str:
    sums = ", ".join(
        f"CAST(sum(CAST('0x' || substr(h, {start}, {length}) AS UBIGINT)) AS VARCHAR)" for start, length in fingerprint.PIECES)
    return (
        f"SELECT count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {sums})) AS fingerprint "
        f"FROM (SELECT sha256(concat_ws(chr(31), {texts})) AS h FROM {source})")


ORDER_TEXTS = (
    "'o_custkey=' || o_custkey, 'o_orderkey=' || o_orderkey, 'o_orderpriority=' || o_orderpriority, "
    "'o_orderstatus=' || o_orderstatus, 'o_totalprice=' || CAST(round(o_totalprice * 100) AS BIGINT)")
CUSTOMER_TEXTS = (
    "'c_acctbal=' || CAST(round(c_acctbal * 100) AS BIGINT), 'c_custkey=' || c_custkey, 'c_mktsegment=' || c_mktsegment, 'c_name=' || c_name")
LINE_TEXTS = (
    "'l_extendedprice=' || CAST(round(l_extendedprice * 100) AS BIGINT), 'l_orderkey=' || l_orderkey, 'l_partkey=' || l_partkey, "
    "'l_shipdate=' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR)")


STATE_TEXTS = (
    "'gone=' || hidden, 'id=' || id, 'kind=' || coalesce(kind, chr(0)), 'tier=' || coalesce(tier, chr(0)), 'type=' || type")


@query("state_fingerprint", with_views(b.ESTATE) + sql_fingerprint("estate", STATE_TEXTS))
def state_fingerprint(spark, folder):
    rows = state(spark, folder).withColumn("tier", F.element_at("sku", "tier")).withColumn("gone", F.col(drift.HIDE_PATH))
    return fingerprint.fingerprint(rows, ["id", "type", "kind", "tier", "gone"], marks={"gone"})


@query(
    "content_fingerprint",
    "SELECT 'customer' AS \"table\", * FROM (" + sql_fingerprint("customer", CUSTOMER_TEXTS) + ") UNION ALL "
    "SELECT 'orders', * FROM (" + sql_fingerprint("orders", ORDER_TEXTS) + ") UNION ALL "
    "SELECT 'lineitem', * FROM (" + sql_fingerprint("lineitem", LINE_TEXTS) + ")",
)
def content_fingerprint(spark, folder):
    lines = b.table(spark, folder, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))
    return fingerprint.content_fingerprint({
        "customer": (b.table(spark, folder, "customer"), ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], {"c_acctbal"}),
        "orders": (
            b.table(spark, folder, "orders"),
            ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"], {"o_totalprice"}),
        "lineitem": (lines, ["l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate"], {"l_extendedprice"}),
    })


# --- change batches: DRF-01..09, JON-10, WIN-03, FN-14 ----------------------------------

RULE_JSON = (
    '{"name":"AllowAll-Inbound-Drift","properties":{"access":"Allow","direction":"Inbound","protocol":"*","sourcePortRange":"*",'
    '"destinationPortRange":"*","sourceAddressPrefix":"*","destinationAddressPrefix":"*","priority":110}}')
NEXT_TIER = "CASE tier WHEN 'Free' THEN 'Basic' WHEN 'Basic' THEN 'Standard' WHEN 'Standard' THEN 'Premium' WHEN 'Premium' THEN 'Standard' ELSE 'Premium' END"


def delta_sql(parts: list[tuple[str, str, str, str, str, str]]) -> str:
    selects = [
        f"SELECT id, '{code}' AS drift_code, '{path}' AS field_path, {before} AS before, {after} AS after FROM estate WHERE NOT hidden AND {condition}"
        for code, kind, path, before, after, condition in parts]
    return " UNION ALL ".join(selects)


CHAOS = [
    ("DRIFT_STORAGE_PUBLIC_ACCESS", "", "properties.allowBlobPublicAccess", "NULL", "'true'", "type = 'Microsoft.Storage/storageAccounts'"),
    ("DRIFT_STORAGE_HTTP_ALLOWED", "", "properties.supportsHttpsTrafficOnly", "NULL", "'false'", "type = 'Microsoft.Storage/storageAccounts'"),
    ("DRIFT_STORAGE_OLD_TLS", "", "properties.minimumTlsVersion", "tls", "'TLS1_0'", "type = 'Microsoft.Storage/storageAccounts'"),
    ("DRIFT_NSG_OPEN_INBOUND", "", "properties.securityRules[]", "NULL", f"'{RULE_JSON}'", "type = 'Microsoft.Network/networkSecurityGroups'"),
    ("DRIFT_KV_NO_PURGE_PROTECT", "", "properties.enablePurgeProtection", "NULL", "'false'", "type = 'Microsoft.KeyVault/vaults'"),
    ("DRIFT_KV_NO_SOFT_DELETE", "", "properties.enableSoftDelete", "NULL", "'false'", "type = 'Microsoft.KeyVault/vaults'"),
    ("DRIFT_AKS_NO_RBAC", "", "properties.enableRBAC", "NULL", "'false'", "type = 'Microsoft.ContainerService/managedClusters'"),
    ("DRIFT_TAGS_REMOVED", "", "tags.environment", "environment", "NULL", "environment IS NOT NULL"),
]
SKU_JSON = "'{\"name\":\"' || %s || '\",\"tier\":\"' || %s || '\"}'"
TEMPORAL = [
    ("DRIFT_PROVISIONING_STATE", "", "properties.provisioningState", "'Succeeded'", "'Updating'", "true"),
    ("DRIFT_SKU_TIER_SHIFT", "", "sku", SKU_JSON % ("tier || '_S1'", "tier"),
     SKU_JSON % (f"CASE WHEN tier = 'Custom' THEN 'Custom_S1' ELSE {NEXT_TIER} || '_S1' END", NEXT_TIER), "tier IS NOT NULL"),
    ("DRIFT_TAG_CHURN", "", "tags.environment", "environment", "CASE environment WHEN 'staging' THEN 'production' ELSE 'staging' END", "environment IS NOT NULL"),
    ("DRIFT_SQL_TLS_DOWNGRADE", "", "properties.minimalTlsVersion", "NULL", "'1.0'", "type = 'Microsoft.Sql/servers'"),
    ("DRIFT_SQL_PUBLIC_NETWORK", "", "properties.publicNetworkAccess", "NULL", "'Enabled'", "type = 'Microsoft.Sql/servers'"),
    ("DRIFT_SQLDB_TDE_DISABLED", "", "properties.transparentDataEncryption", "NULL", "'Disabled'", "type = 'Microsoft.Sql/servers/databases'"),
    ("DRIFT_WEBSITE_HTTPS_OFF", "", "properties.httpsOnly", "NULL", "'false'", "type = 'Microsoft.Web/sites'"),
    ("DRIFT_WEBSITE_STOPPED", "", "properties.state", "NULL", "'Stopped'", "type = 'Microsoft.Web/sites'"),
]


def shown(deltas):
    nothing = F.lit("(none)")
    return deltas.select(
        F.col("resource_id").alias("id"), "drift_code", "field_path",
        F.coalesce("before", nothing).alias("before"), F.coalesce("after", nothing).alias("after"))


def deltas_of(spark, folder, kind):
    seen = state(spark, folder).where(F.col(drift.HIDE_PATH).isNull())
    return drift.compute_deltas(seen, kind)[1]


SHOWN = "SELECT id, drift_code, field_path, coalesce(before, '(none)') AS before, coalesce(after, '(none)') AS after FROM deltas"


@query("chaos_deltas", with_views(b.ESTATE, f"deltas AS ({delta_sql(CHAOS)})") + SHOWN)
def chaos_deltas(spark, folder):
    return shown(deltas_of(spark, folder, "chaos"))


@query("temporal_deltas", with_views(b.ESTATE, f"deltas AS ({delta_sql(TEMPORAL)})") + SHOWN)
def temporal_deltas(spark, folder):
    return shown(deltas_of(spark, folder, "temporal"))


@query(
    "eligible_changes",
    with_views(b.ESTATE, f"deltas AS ({delta_sql(CHAOS + TEMPORAL)})") + "SELECT drift_code, count(*) AS n FROM deltas GROUP BY 1",
)
def eligible_changes(spark, folder):
    seen = state(spark, folder).where(F.col(drift.HIDE_PATH).isNull())
    both = drift.eligible_rows(seen, "chaos").unionByName(drift.eligible_rows(seen, "temporal"))
    return both.groupBy("drift_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sampled_change_counts",
    with_views(b.ESTATE, f"deltas AS ({delta_sql(TEMPORAL)})", "e AS (SELECT drift_code, count(*) AS n FROM deltas GROUP BY 1)")
    + "SELECT drift_code, CAST(round_even(0.3 * n, 0) AS BIGINT) AS n, CAST(round_even(0.3 * n, 0) AS BIGINT) AS rows, true AS eligible FROM e",
)
def sampled_change_counts(spark, folder):
    seen = state(spark, folder).where(F.col(drift.HIDE_PATH).isNull())
    picked, plan = drift.sample_changes(seen, "temporal", 0.3, seed=7)
    held = drift.eligible_rows(seen, "temporal").withColumn("ok", F.lit(True))
    counted = picked.join(held, ["id", "drift_code"], "left").groupBy("drift_code").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("eligible"))
    return counted.join(plan.select("drift_code", F.col("quota").alias("rows")), "drift_code")


@query(
    "sampled_deltas",
    with_views(
        b.ESTATE, f"every AS ({delta_sql(CHAOS)})",
        "drawn AS (SELECT *, count(*) OVER (PARTITION BY drift_code) AS n, "
        "row_number() OVER (PARTITION BY drift_code ORDER BY substr(md5('11:drift:' || drift_code || ':' || id), 1, 15), id) AS i FROM every)",
        "deltas AS (SELECT * FROM drawn WHERE i <= round_even(0.25 * n, 0))") + SHOWN,
)
def sampled_deltas(spark, folder):
    seen = state(spark, folder).where(F.col(drift.HIDE_PATH).isNull())
    return shown(drift.compute_deltas(seen, "chaos", intensity=0.25, seed=11)[1])


AFTER_CHAOS = """
after AS (SELECT id, hidden, CASE WHEN hidden THEN environment END AS environment,
  CASE WHEN NOT hidden AND type = 'Microsoft.Storage/storageAccounts' THEN 'TLS1_0' ELSE tls END AS tls,
  NOT hidden AND type = 'Microsoft.Network/networkSecurityGroups' AS opened FROM estate)
"""


@query(
    "applied_snapshot",
    with_views(b.ESTATE, AFTER_CHAOS)
    + "SELECT id, hidden, coalesce(environment, '(none)') AS environment, coalesce(tls, '(none)') AS tls, opened FROM after",
)
def applied_snapshot(spark, folder):
    snapshot = first_batch(spark, folder, "chaos").snapshot
    nothing = F.lit("(none)")
    return snapshot.select(
        "id", F.col(drift.HIDE_PATH).isNotNull().alias("hidden"),
        F.coalesce(F.element_at("tags", "environment"), nothing).alias("environment"),
        F.coalesce(F.element_at("properties", "minimumTlsVersion"), nothing).alias("tls"),
        F.map_contains_key("properties", "securityRules").alias("opened"))


@query(
    "applied_records",
    with_views(b.ESTATE, f"deltas AS ({delta_sql(CHAOS)})")
    + "SELECT drift_code, count(*) AS n, count(*) AS ids, (SELECT count(*) FROM deltas) AS last FROM deltas GROUP BY 1",
)
def applied_records(spark, folder):
    records = first_batch(spark, folder, "chaos").records
    last = records.agg(F.max("record_id")).scalar()
    return records.groupBy("drift_code").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("ids")).withColumn("last", last.cast("long"))


@query(
    "chained_batches",
    with_views(b.ESTATE) + "SELECT 2::BIGINT AS batches, true AS chained, true AS changed, 2::BIGINT AS last_seq",
)
def chained_batches(spark, folder):
    first = first_batch(spark, folder, "chaos")
    second = drift.apply_changes(
        first.snapshot, first.batch, first.records, SECOND, "temporal", first.batch.agg(F.max("applied_at")).scalar())
    left_at = first.batch.select("result_fingerprint").scalar()
    return second.batch.select(
        F.lit(2).cast("long").alias("batches"), (left_at == F.col("parent_fingerprint")).alias("chained"),
        (F.col("parent_fingerprint") != F.col("result_fingerprint")).alias("changed"), F.col("seq").cast("long").alias("last_seq"))


ORIGINAL = (
    "SELECT id, hidden, coalesce(environment, '(none)') AS environment, priority, coalesce(tier, '(none)') AS tier, "
    "coalesce(tls, '(none)') AS tls, CAST(1 + (tls IS NOT NULL)::INT AS BIGINT) AS fields FROM estate")


def reverted(spark, folder, kind, **more):
    nothing = F.lit("(none)")
    applied = first_batch(spark, folder, kind, **more)
    return drift.restore(applied.snapshot, applied.records, BATCH).select(
        "id", F.col(drift.HIDE_PATH).isNotNull().alias("hidden"),
        F.coalesce(F.element_at("tags", "environment"), nothing).alias("environment"),
        F.element_at("tags", "priority").alias("priority"),
        F.coalesce(F.element_at("sku", "tier"), nothing).alias("tier"),
        F.coalesce(F.element_at("properties", "minimumTlsVersion"), nothing).alias("tls"),
        F.size("properties").cast("long").alias("fields"))


@query("reverted_chaos", with_views(b.ESTATE) + ORIGINAL)
def reverted_chaos(spark, folder):
    return reverted(spark, folder, "chaos")


@query("reverted_temporal", with_views(b.ESTATE) + ORIGINAL)
def reverted_temporal(spark, folder):
    return reverted(spark, folder, "temporal")


@query("reverted_lifecycle", with_views(b.ESTATE) + ORIGINAL)
def reverted_lifecycle(spark, folder):
    """Changed fields, rows that go and rows that come, all in one batch, and undone."""
    referenced = b.estate_rows(spark, folder).where(F.col("amount") > 100000).select("id")
    groups = b.estate_groups(spark, folder).withColumn("location", F.lit("eastus"))
    return reverted(spark, folder, "chaos", references=[referenced], disappear=120, groups=groups, appear=40, seed=3)


@query(
    "guarded_revert",
    with_views(
        b.ESTATE, f"chaos AS ({delta_sql(CHAOS)})", f"later AS ({delta_sql(TEMPORAL)})",
        # The first batch takes away every environment, so the second finds none to change.
        "n AS (SELECT (SELECT count(*) FROM chaos) AS c, (SELECT count(*) FROM later WHERE drift_code <> 'DRIFT_TAG_CHURN') AS t)")
    + f"SELECT '{BATCH}' AS batch_id, 1::BIGINT AS seq, c AS records, 'blocked' AS before, 'reverted' AS after, c > 0 AND t > 0 AS refused, c > 0 AS restored FROM n "
    f"UNION ALL SELECT '{SECOND}', 2, t, 'free', 'reverted', c > 0 AND t > 0, t > 0 FROM n",
)
def guarded_revert(spark, folder):
    """Two batches reverted newest first, after the older one was refused; their records stay."""
    first = first_batch(spark, folder, "chaos")
    at = first.batch.agg(F.max("applied_at")).scalar()
    second = drift.apply_changes(first.snapshot, first.batch, first.records, SECOND, "temporal", at)
    batches, records = first.batch.unionByName(second.batch), first.records.unionByName(second.records)
    before = drift.revert_states(batches, records).withColumnRenamed("state", "before")
    try:
        drift.revert(second.snapshot, batches, records, BATCH, at)
        refused = False
    except drift.RevertError:
        refused = True
    one, marked = drift.revert(second.snapshot, batches, records, SECOND, at)
    one = settle(one)  # its fingerprint and the next revert read it
    none, marked = drift.revert(one, marked, records, BATCH, at)
    found = F.when(F.col("batch_id") == SECOND, drift.visible_fingerprint(one)).otherwise(drift.visible_fingerprint(none))
    after = drift.revert_states(marked, records).select("batch_id", F.col("state").alias("after"))
    return drift.batch_log(marked, records).join(before.drop("seq"), "batch_id").join(after, "batch_id").select(
        "batch_id", F.col("seq").cast("long").alias("seq"), "records", "before", "after", F.lit(refused).alias("refused"),
        (found == F.col("parent_fingerprint")).alias("restored"))


@query(
    "overlaid_snapshot",
    with_views(b.ESTATE, AFTER_CHAOS)
    + "SELECT id, hidden, coalesce(environment, '(none)') AS environment, coalesce(tls, '(none)') AS tls, opened FROM after",
)
def overlaid_snapshot(spark, folder):
    """`applied_snapshot` merged on read from a base and the changed rows."""
    path, rows = scratch_path(spark, "store"), state(spark, folder, spread=True)
    batches.open_store(rows, path)
    at = batches.apply_batch(spark, path, BATCH, "chaos", state(spark, folder).agg(F.max(drift.HIDE_PATH)).scalar())
    nothing = F.lit("(none)")
    return overlay.read(spark, at, "resources").select(
        "id", F.col(drift.HIDE_PATH).isNotNull().alias("hidden"),
        F.coalesce(F.element_at("tags", "environment"), nothing).alias("environment"),
        F.coalesce(F.element_at("properties", "minimumTlsVersion"), nothing).alias("tls"),
        F.map_contains_key("properties", "securityRules").alias("opened"))


@query(
    "overlay_versions",
    with_views(
        b.ESTATE, f"chaos AS ({delta_sql(CHAOS)})", f"later AS ({delta_sql(TEMPORAL)})",
        "n AS (SELECT (SELECT count(DISTINCT id) FROM chaos) AS rows, (SELECT count(*) FROM chaos) AS logged, "
        "(SELECT count(DISTINCT id) FROM later) AS later_rows, (SELECT count(*) FROM later WHERE drift_code <> 'DRIFT_TAG_CHURN') AS later_logged, "
        "(SELECT count(*) FROM estate WHERE NOT hidden) AS seen)")
    + "SELECT 1::BIGINT AS version, 'chaos' AS step, rows AS written, logged AS records, seen, true AS exact, false AS as_before FROM n "
    "UNION ALL SELECT 2, 'temporal', later_rows, logged + later_logged, seen, true, false FROM n "
    "UNION ALL SELECT 3, 'compact', 0, logged + later_logged, seen, true, false FROM n "
    "UNION ALL SELECT 4, 'revert', later_rows, logged + later_logged, seen, true, false FROM n "
    "UNION ALL SELECT 5, 'revert', rows, logged + later_logged, seen, true, true FROM n",
)
def overlay_versions(spark, folder):
    """Two batches, a compaction and both reverts: rows written by each, and whether the kept fingerprint is the one of all rows."""
    path, rows = scratch_path(spark, "store"), state(spark, folder, spread=True)
    applied_at = state(spark, folder).agg(F.max(drift.HIDE_PATH)).scalar()
    start = batches.open_store(rows, path)
    first = batches.apply_batch(spark, path, BATCH, "chaos", applied_at)
    second = batches.apply_batch(spark, path, SECOND, "temporal", applied_at)
    packed = overlay.compact(spark, second, "resources")
    back = batches.revert_batch(spark, path, SECOND, applied_at)
    steps = {"chaos": first, "temporal": second, "compact": packed, "revert": back}
    parts = [*steps.items(), ("revert", batches.revert_batch(spark, path, BATCH, applied_at))]
    out = None
    for step, at in parts:
        visible = overlay.read(spark, at, "resources").where(F.col(drift.HIDE_PATH).isNull())
        kept = batches.kept_fingerprint(at)
        part = fingerprint.fingerprint(visible, drift.STATE_COLUMNS, marks={drift.HIDE_PATH}).select(
            F.lit(at.number).cast("long").alias("version"), F.lit(step).alias("step"),
            F.lit(batches.written_rows(spark, at)).cast("long").alias("written"),
            F.lit(overlay.read(spark, at, "records").count()).cast("long").alias("records"), F.col("rows").alias("seen"),
            (F.col("fingerprint") == kept).alias("exact"), F.lit(kept == batches.kept_fingerprint(start)).alias("as_before"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "disappearing_rows",
    with_views(b.ESTATE) + "SELECT 120::BIGINT AS n, 0::BIGINT AS referenced, 120::BIGINT AS known FROM (SELECT count(*) FROM estate)",
)
def disappearing_rows(spark, folder):
    rows = state(spark, folder).where(F.col(drift.HIDE_PATH).isNull())
    referenced = b.estate_rows(spark, folder).where(F.col("amount") > 100000).select("id")
    gone = drift.disappearing(rows, [referenced], 120, seed=3).select("id")
    marks = referenced.withColumn("r", F.lit(True))
    known = rows.select("id").withColumn("k", F.lit(True))
    return gone.join(marks, "id", "left").join(known, "id", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("r").alias("referenced"), F.count("k").alias("known"))


@query(
    "appearing_rows",
    "WITH g AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS subscription_id, o_orderpriority AS name FROM orders) "
    "SELECT subscription_id, name AS resource_group, 1::BIGINT AS n FROM g ORDER BY name, subscription_id LIMIT 40",
)
def appearing_rows(spark, folder):
    groups = b.estate_groups(spark, folder).withColumn("location", F.lit("eastus"))
    minted = drift.appearing(groups, 40, seed=3)
    return minted.groupBy("subscription_id", "resource_group").agg(F.count_distinct("id").alias("n"))


LOG = """
batches AS (SELECT 'b-' || year(o_orderdate) AS batch_id, year(o_orderdate) AS y, row_number() OVER (ORDER BY year(o_orderdate)) AS seq,
  year(o_orderdate) = 2000 AS reverted FROM orders GROUP BY year(o_orderdate)),
records AS (SELECT o_orderkey AS record_id, 'b-' || year(o_orderdate) AS batch_id, 'c-' || o_custkey AS resource_id, o_orderstatus AS field FROM orders)
"""


def change_log(spark, folder):
    orders = b.table(spark, folder, "orders")
    year = F.year("o_orderdate")
    fresh = orders.groupBy(year.alias("y")).agg(F.max("o_orderdate").alias("applied_at")).select(
        F.concat(F.lit("b-"), "y").alias("batch_id"), "applied_at",
        F.when(F.col("y") == 2000, F.col("applied_at")).alias("reverted_at"))
    nothing = spark.createDataFrame([], "seq long")
    records = orders.select(
        F.col("o_orderkey").alias("record_id"), F.concat(F.lit("b-"), year).alias("batch_id"),
        F.concat(F.lit("c-"), "o_custkey").alias("resource_id"), F.col("o_orderstatus").alias("field"))
    return drift.next_seq(nothing, fresh, ["applied_at", "batch_id"]), records


@query("batch_order", with_views(LOG) + "SELECT batch_id, seq, reverted FROM batches")
def batch_order(spark, folder):
    batches, _ = change_log(spark, folder)
    return batches.select("batch_id", F.col("seq").cast("long").alias("seq"), F.col("reverted_at").isNotNull().alias("reverted"))


@query(
    "batch_log",
    with_views(LOG) + "SELECT batch_id, seq, (SELECT count(*) FROM records r WHERE r.batch_id = b.batch_id) AS records FROM batches b",
)
def batch_log(spark, folder):
    return drift.batch_log(*change_log(spark, folder)).select("batch_id", F.col("seq").cast("long").alias("seq"), "records")


@query(
    "blocking_batches",
    with_views(LOG)
    + "SELECT batch_id FROM batches WHERE seq > (SELECT seq FROM batches WHERE batch_id = 'b-1998') AND NOT reverted AND batch_id IN "
    "(SELECT batch_id FROM records WHERE resource_id IN (SELECT resource_id FROM records WHERE batch_id = 'b-1998'))",
)
def blocking_batches(spark, folder):
    return integrity.blocking_batches(*change_log(spark, folder), "b-1998").select("batch_id")


@query(
    "batch_detail",
    with_views(LOG, "mine AS (SELECT *, row_number() OVER (ORDER BY record_id) AS i, count(*) OVER () AS n FROM records WHERE batch_id = 'b-1998' AND record_id > 50)")
    + "SELECT batch_id, seq, reverted, record_id, resource_id, field, CASE WHEN n > 20 THEN (SELECT max(record_id) FROM mine WHERE i <= 20) ELSE -1 END AS next_after "
    "FROM batches JOIN mine USING (batch_id) WHERE i <= 20",
)
def batch_detail(spark, folder):
    return drift.batch_detail(*change_log(spark, folder), "b-1998", 50, 20).select(
        "batch_id", F.col("seq").cast("long").alias("seq"), F.col("reverted_at").isNotNull().alias("reverted"), "record_id",
        "resource_id", "field", F.coalesce("next_after", F.lit(-1)).alias("next_after"))


@query(
    "revert_states",
    with_views(LOG, "touched AS (SELECT DISTINCT batch_id, resource_id FROM records)")
    + "SELECT batch_id, seq, CASE WHEN reverted THEN 'reverted' WHEN EXISTS (SELECT 1 FROM touched t JOIN touched u USING (resource_id) "
    "JOIN batches n ON n.batch_id = u.batch_id WHERE t.batch_id = b.batch_id AND n.seq > b.seq AND NOT n.reverted) THEN 'blocked' ELSE 'free' END AS state "
    "FROM batches b",
)
def revert_states(spark, folder):
    states = drift.revert_states(*change_log(spark, folder))
    return states.select("batch_id", F.col("seq").cast("long").alias("seq"), "state")


@query(
    "resource_history",
    with_views(LOG) + "SELECT record_id, batch_id, field, (SELECT max(record_id) FROM (SELECT record_id FROM records WHERE resource_id = 'c-7' AND record_id > 100 ORDER BY 1 LIMIT 5)) AS next_after "
    "FROM records WHERE resource_id = 'c-7' AND record_id > 100 ORDER BY 1 LIMIT 5",
)
def resource_history(spark, folder):
    _, records = change_log(spark, folder)
    return page(records.where(F.col("resource_id") == "c-7").select("record_id", "batch_id", "field"), "record_id", 100, 5)


@query(
    "snapshot_diff",
    """SELECT o_orderkey, 'removed' AS change, '' AS field, '' AS before, '' AS after FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT o_orderkey + 100000000, 'added', '', '', '' FROM orders WHERE o_orderkey % 60 = 7
UNION ALL SELECT o_orderkey, 'changed', 'o_orderstatus', o_orderstatus, 'X' FROM orders WHERE o_orderkey % 7 = 1 AND o_orderkey % 50 <> 0
UNION ALL SELECT o_orderkey, 'changed', 'o_orderpriority', o_orderpriority, '' FROM orders WHERE o_orderkey % 11 = 2 AND o_orderkey % 50 <> 0""",
)
def snapshot_diff(spark, folder):
    before = b.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey")
    kept = before.where(key % 50 != 0).select(
        "o_orderkey", "o_custkey", F.when(key % 7 == 1, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 11 != 2, F.col("o_orderpriority")).alias("o_orderpriority"))
    added = before.where(key % 60 == 7).withColumn("o_orderkey", key + 100000000)
    found = drift.diff(before, kept.unionByName(added), "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])
    return found.na.fill("", ["field", "before", "after"])


@query(
    "restored_fields",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'b=2' WHEN 1 THEN 'a=' || o_orderstatus || ',b=2' ELSE 'a=[\"x\"],b=2' END AS fields FROM orders",
)
def restored_fields(spark, folder):
    kind = F.col("o_orderkey") % 3
    now = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.when(kind == 2, '["x","y"]').otherwise("changed"))
    path = F.when(kind == 2, "properties.a[]").otherwise("properties.a")
    before = F.when(kind == 1, F.col("o_orderstatus"))
    after = F.when(kind == 2, "y").otherwise("changed")
    rows = b.table(spark, folder, "orders").select(
        "o_orderkey", F.array_sort(F.map_entries(revert_field(now, path, before, after))).alias("e"))
    # A JSON list is rebuilt from its elements' texts.
    fields = F.transform("e", lambda x: F.concat_ws("=", x["key"], x["value"]))
    return rows.select("o_orderkey", F.regexp_replace(F.array_join(fields, ","), "\\[x\\]", '["x"]').alias("fields"))


# --- sources: SRC-01, SRC-03, SRC-07, SRC-08 --------------------------------------------

def estate_tables(spark, folder):
    rows = b.estate_rows(spark, folder)
    return {
        "subscriptions": b.estate_owners(spark, folder).withColumn("state", F.lit("Enabled")).withColumn("tags", F.lit("{}")),
        "resource_groups": b.estate_groups(spark, folder).withColumn("location", F.lit("eastus")).withColumn("tags", F.lit("{}")),
        "resources": rows.select(
            "id", "name", "type", F.lit("eastus").alias("location"), "resource_group_name", "subscription_id",
            F.to_json("properties").alias("properties"), F.to_json("sku").alias("sku"), F.to_json("tags").alias("tags"),
            "kind", "drift_deleted_at"),
        "cost_records": b.table(spark, folder, "lineitem").join(
            rows.select("number", F.col("id").alias("resource_id")), F.col("l_orderkey") == F.col("number")
        ).groupBy("resource_id", F.to_date(F.date_trunc("month", "l_shipdate")).alias("billing_period")).agg(
            F.sum("l_extendedprice").alias("cost_amount")),
    }


@query(
    "projected_scan",
    with_views(
        b.ESTATE,
        "bills AS (SELECT id, date_trunc('month', l_shipdate) AS m, sum(l_extendedprice) AS c FROM lineitem JOIN estate ON l_orderkey = o_orderkey WHERE NOT hidden GROUP BY 1, 2)")
    + "SELECT strftime(m, '%Y-%m') AS part, count(*) AS n, round(sum(c), 2) AS amount FROM bills GROUP BY 1 "
    "UNION ALL SELECT 'rows', count(*), count(tier) FROM estate WHERE NOT hidden UNION ALL SELECT 'owners', count(*), 0 FROM customer "
    "UNION ALL SELECT 'groups', count(*), 0 FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)",
)
def projected_scan(spark, folder):
    scan = scan_io.to_scan(estate_tables(spark, folder))
    n = F.count(F.lit(1)).alias("n")
    bills = scan["resource_costs"].groupBy(F.col("billing_month").alias("part")).agg(
        n, F.round(F.sum("amortized_cost_eur"), 2).alias("amount"))
    rows = scan["resources"].agg(n, F.count("sku").cast("double").alias("amount"))
    owners = scan["subscriptions"].agg(n, F.count("tags").cast("double").alias("amount"))
    groups = scan["resource_groups"].agg(n, F.count("tags").cast("double").alias("amount"))
    return bills.union(rows.select(F.lit("rows"), "*")).union(owners.select(F.lit("owners"), "*")).union(
        groups.select(F.lit("groups"), "*"))


def content(df):
    """Rows and the sum of their hashes over all columns, whatever their order."""
    hashed = F.xxhash64(*[F.col(c) if t[:3] != "map" else F.to_json(c) for c, t in sorted(df.dtypes)])
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(hashed.cast("decimal(38,0)")).alias("h"))


def compared(written, read):
    """(table, n, same): rows read back, and whether each column's values are those that were written."""
    out = None
    for name, df in written.items():
        held = set(read[name].columns) >= set(df.columns)
        back = content(read[name].select(*df.columns)) if held else read[name].limit(0).agg(F.lit(0).alias("n"), F.lit(-1).alias("h"))
        one = content(df).select(F.col("n").alias("n0"), F.col("h").alias("h0")).join(back).select(
            F.lit(name).alias("table"), "n", ((F.col("n") == F.col("n0")) & F.col("h").eqNullSafe(F.col("h0")) & (F.col("n") > 0)).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "scan_read_back",
    with_views(b.ESTATE)
    + "SELECT 'resources' AS \"table\", count(*) AS n, true AS same FROM estate WHERE NOT hidden UNION ALL SELECT 'subscriptions', count(*), true FROM customer "
    "UNION ALL SELECT 'resource_groups', 0, true UNION ALL SELECT 'findings', 0, true UNION ALL SELECT 'resource_costs', 0, true",
)
def scan_read_back(spark, folder):
    """Two scan tables written, loaded and compared; the optional ones are not there and come up empty."""
    target = scratch_path(spark, "scan")
    scan = scan_io.to_scan(estate_tables(spark, folder))
    for name in scan_io.REQUIRED:
        scan[name].write.parquet(f"{target}/{name}.parquet")
    loaded = scan_io.load_scan(spark, target)
    missing = {name: df for name, df in loaded.items() if name not in scan_io.REQUIRED}
    return compared({name: scan[name] for name in scan_io.REQUIRED}, loaded).unionByName(
        totals(missing).withColumn("same", F.col("n") == 0))


@query(
    "estate_read_back",
    with_views(b.ESTATE)
    + "SELECT 'resources' AS \"table\", count(*) AS n, true AS same FROM estate UNION ALL SELECT 'subscriptions', count(*), true FROM customer "
    "UNION ALL SELECT 'resource_groups', count(*), true FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) "
    "UNION ALL SELECT 'cost_records', count(*), true FROM (SELECT DISTINCT l_orderkey, date_trunc('month', l_shipdate) FROM lineitem)",
)
def estate_read_back(spark, folder):
    """Every table written and read, compared over all columns (sums of costs in whole cents)."""
    target, tables = scratch_path(spark, "estate"), estate_tables(spark, folder)
    tables["cost_records"] = tables["cost_records"].withColumn("cost_amount", F.round("cost_amount", 2))
    estate_io.write_estate(tables, target)
    return compared(tables, estate_io.read_estate(spark, target))


@query(
    "owner_read_back",
    with_views(b.ESTATE)
    + "SELECT id FROM estate WHERE id LIKE '/subscriptions/' || (SELECT min(o_custkey) FROM orders) || '/%'",
)
def owner_read_back(spark, folder):
    """One owner's rows out of an estate of few buckets."""
    target, tables = scratch_path(spark, "estate"), estate_tables(spark, folder)
    estate_io.write_estate({"resources": tables["resources"]}, target, buckets=5)
    owner = b.table(spark, folder, "orders").agg(F.min("o_custkey")).first()[0]
    return estate_io.owner_rows(spark, target, str(owner)).select("id")


@query(
    "normalised_export",
    with_views(b.TAGGED_DOCUMENTS)
    + "SELECT 'export' AS scan_id, '/d/' || doc_id AS resource_id, lang AS type, CASE WHEN quality = 1 THEN '{\"q\":1}' ELSE '(none)' END AS properties, "
    "CASE WHEN lang = 'de' THEN '{\"Country\":\"de\"}' ELSE '(none)' END AS tags FROM doc_tags",
)
def normalised_export(spark, folder):
    docs = b.table(spark, folder, "documents").join(b.table(spark, folder, "labels"), "doc_id", "left")
    text = F.lit(None).cast("string")
    german = F.create_map(F.lit("Country"), F.col("lang"), F.lit("secret"), F.col("source"))
    rows = docs.select(
        F.concat(F.lit("/d/"), "doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("type"),
        F.lit("eastus").alias("location"), F.lit("g").alias("resourceGroup"), F.col("source").alias("subscriptionId"),
        F.when(F.col("lang") == "de", german).otherwise(F.create_map(F.lit("secret"), F.col("source"))).alias("tags"),
        F.when(F.col("quality") == 1, '{"q":1}').otherwise("{}").alias("properties"), text.alias("sku"), text.alias("kind"))
    found = scan_io.normalize_rows(rows)
    nothing = F.lit("(none)")
    return found.select(
        "scan_id", "resource_id", "type", F.coalesce("properties", nothing).alias("properties"),
        F.coalesce("tags", nothing).alias("tags"))
