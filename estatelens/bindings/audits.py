"""Name coherence, governance and leak-scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens.catalogues import types as t
from estatelens.functions import text
from estatelens.functions.jsonmaps import empty_map
from estatelens.operators import coherence, governance, leaks
from estatelens.operators.templates import group_type_sets
from . import tables as b
from .registry import query, with_views

# --- group contents against claims: FN-06..08, AGG-36..38 ------------------------------

CONTENT_TYPES = {
    "ECONOMY": "microsoft.compute/virtualmachines",
    "SMALL": "Microsoft.Web/sites",
    "MEDIUM": "Microsoft.Sql/servers/databases",
    "LARGE": "Microsoft.Insights/activityLogAlerts",
    "STANDARD": "Microsoft.Insights/scheduledQueryRules",
    "PROMO": "Microsoft.ManagedIdentity/userAssignedIdentities",
}
CLAIMS = ("vm-workload", "web-app", "sql-db", "monitoring", "identity", "shared", "core", "lonely")

CLAIMED = """
held AS (SELECT o_custkey, o_orderpriority,
    bool_or(p_type = 'ECONOMY') AS e, bool_or(p_type = 'SMALL') AS s, bool_or(p_type = 'MEDIUM') AS d,
    bool_or(p_type = 'LARGE') AS a, bool_or(p_type = 'STANDARD') AS q, bool_or(p_type = 'PROMO') AS m
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
groups AS (SELECT CAST(c_custkey AS VARCHAR) AS owner, name AS resource_group,
    ['vm-workload', 'web-app', 'sql-db', 'monitoring', 'identity', 'shared', 'core', 'lonely'][c_custkey % 8 + 1] AS token,
    e IS NULL AS empty, coalesce(e, false) AS e, coalesce(s, false) AS s, coalesce(d, false) AS d,
    coalesce(a, false) AS a, coalesce(q, false) AS q, coalesce(m, false) AS m
  FROM (SELECT c_custkey, subscription_id, name FROM declared JOIN customer ON CAST(c_custkey AS VARCHAR) = subscription_id)
  LEFT JOIN held ON o_custkey = c_custkey AND o_orderpriority = name),
scored AS (SELECT *,
    CASE WHEN e THEN 2.0 ELSE -99 END AS vm, CASE WHEN s THEN 2.0 + 0.5 * d::INT ELSE -99 END AS web,
    CASE WHEN d THEN 2.5 - 1.5 * s::INT ELSE -99 END AS sql,
    CASE WHEN m THEN 2.0 - 1.5 * (e::INT + s::INT + d::INT) ELSE -99 END AS ident FROM groups),
ranked AS (SELECT *, list_sort([vm, web, sql, ident], 'DESC') AS o FROM scored),
looked AS (SELECT *, CASE WHEN empty OR o[1] = -99 THEN 'shared'
    WHEN o[1] >= 2 AND o[1] - o[2] >= 0.5 THEN CASE o[1] WHEN vm THEN 'vm-workload' WHEN web THEN 'web-app' WHEN sql THEN 'sql-db' ELSE 'identity' END
    ELSE 'core' END AS looks,
  CASE token WHEN 'vm-workload' THEN e WHEN 'web-app' THEN s WHEN 'sql-db' THEN d WHEN 'monitoring' THEN a AND q WHEN 'identity' THEN m ELSE false END AS backed,
  token IN ('shared', 'core') AS generic, token IN ('vm-workload', 'web-app', 'sql-db', 'monitoring', 'identity') AS known FROM ranked),
judged AS (SELECT *, CASE WHEN generic OR NOT known THEN token WHEN empty THEN 'shared' WHEN backed THEN token ELSE 'core' END AS kept,
  CASE token WHEN 'vm-workload' THEN e WHEN 'web-app' THEN s WHEN 'sql-db' THEN d WHEN 'identity' THEN m ELSE false END AS anchored FROM looked)
"""


def claimed_groups(spark, folder):
    rows = b.scan_rows(spark, folder, "subscription_id", "resource_group", "type")
    kind = F.upper(F.regexp_extract("type", "\\.([^/]+)/", 1))
    type_name = kind
    for name, known in CONTENT_TYPES.items():
        type_name = F.when(kind == name, known).otherwise(type_name)
    sets = group_type_sets(rows.withColumn("type", type_name), b.declared_groups(spark, folder))
    claim = F.element_at(F.array(*[F.lit(c) for c in CLAIMS]), (F.col("owner").cast("int") % 8) + 1)
    return sets.withColumn("token", claim)


@query(
    "matched_archetypes",
    with_views(b.DECLARED_GROUPS, CLAIMED) + "SELECT owner, resource_group, looks FROM judged",
)
def matched_archetypes(spark, folder):
    return coherence.match_archetype(claimed_groups(spark, folder), "type_set", "looks").select(
        "owner", "resource_group", "looks")


@query(
    "confirmed_archetypes",
    with_views(b.DECLARED_GROUPS, CLAIMED)
    + "SELECT owner, resource_group, kept AS token, known AND NOT empty AND backed AS confirmed, "
    "token = 'sql-db' AND known AND NOT empty AND backed AS by_ancestors FROM judged",
)
def confirmed_archetypes(spark, folder):
    judged = coherence.confirm_archetype(claimed_groups(spark, folder), "token", "type_set", "v")
    return judged.select("owner", "resource_group", "v.*")


AUDIT = """
audited AS (SELECT token,
  CAST(count(*) FILTER (empty) AS BIGINT) AS empty, CAST(count(*) FILTER (NOT empty) AS BIGINT) AS nonempty,
  CAST(count(*) FILTER (NOT empty AND generic AND looks NOT IN ('shared', 'core')) AS BIGINT) AS contents_semantic,
  CAST(count(*) FILTER (NOT empty AND NOT generic AND kept <> token) AS BIGINT) AS unconfirmed,
  CAST(count(*) FILTER (NOT empty AND NOT generic AND NOT known) AS BIGINT) AS unknown_token,
  CAST(count(*) FILTER (NOT empty AND known AND anchored) AS BIGINT) AS with_anchor,
  CAST(count(*) FILTER (NOT empty AND known AND NOT anchored) AS BIGINT) AS anchorless,
  CAST(count(*) FILTER (NOT empty AND known AND NOT anchored AND token <> 'monitoring') AS BIGINT) AS anchorless_needed,
  CAST(count(*) FILTER (NOT empty AND known AND token <> 'monitoring') AS BIGINT) AS needing_anchor,
  CAST(count(*) FILTER (NOT empty AND known AND token <> 'monitoring') AS BIGINT) AS role_groups,
  0::BIGINT AS undeclared_ubiquitous,
  CAST(count(*) FILTER (NOT empty AND NOT generic AND looks = token) AS BIGINT) AS agree,
  CAST(count(*) FILTER (NOT empty AND NOT generic AND looks <> token AND looks IN ('shared', 'core')) AS BIGINT) AS thin,
  CAST(count(*) FILTER (NOT empty AND NOT generic AND looks <> token AND looks NOT IN ('shared', 'core')) AS BIGINT) AS cross
  FROM judged GROUP BY token)
"""


@query("name_coherence", with_views(b.DECLARED_GROUPS, CLAIMED, AUDIT) + "SELECT * FROM audited")
def name_coherence(spark, folder):
    return coherence.audit(claimed_groups(spark, folder))


@query(
    "coherence_gates",
    with_views(
        b.DECLARED_GROUPS, CLAIMED, AUDIT,
        "s AS (SELECT * FROM audited WHERE token NOT IN ('shared', 'core', '?'))",
        "g AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS gate, unnest(['semantic_groups', 'role_groups', 'unconfirmed', 'empty_semantic', "
        "'anchorless_needed', 'cross_percent', 'undeclared_ubiquitous']) AS measure, unnest([sum(nonempty), sum(role_groups), "
        "(SELECT sum(unconfirmed) FROM audited), sum(empty), sum(anchorless_needed), round(100.0 * sum(\"cross\") / sum(nonempty), 6), 0]::DOUBLE[]) AS value FROM s)")
    + "SELECT CAST(gate AS BIGINT) AS gate, measure, value, CASE WHEN gate <= 2 THEN value >= 1 WHEN gate = 6 THEN value <= 1 ELSE value = 0 END AS passed FROM g",
)
def coherence_gates(spark, folder):
    gates = coherence.evaluate_gates(coherence.audit_metrics(name_coherence(spark, folder)))
    return gates.select(F.col("gate").cast("long").alias("gate"), "measure", F.round("value", 6).alias("value"), "passed")


@query(
    "unconfirmed_examples",
    with_views(b.DECLARED_GROUPS, CLAIMED)
    + "SELECT token, kept, owner || '/' || resource_group AS name FROM judged WHERE NOT empty AND NOT generic AND kept <> token ORDER BY 3 LIMIT 5",
)
def unconfirmed_examples(spark, folder):
    groups = claimed_groups(spark, folder)
    return coherence.examples(groups.withColumn("resource_group", F.concat_ws("/", "owner", "resource_group")))


FAULTS = """
faults AS (
  SELECT 'empty' AS kind, '' AS scope, 5 AS most, token, name, '' AS instead FROM named WHERE empty AND NOT generic
  UNION ALL SELECT 'unconfirmed', '', 5, token, name, kept FROM named WHERE NOT empty AND NOT generic AND kept <> token
  UNION ALL SELECT 'anchorless', token, 5, token, name, '' FROM named WHERE NOT empty AND known AND NOT anchored
  UNION ALL SELECT 'cross', token, 3, token, name, looks FROM named
    WHERE NOT empty AND NOT generic AND looks <> token AND looks NOT IN ('shared', 'core')),
contents AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) || '/' || o_orderpriority AS name, %s AS type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
placed AS (SELECT *, row_number() OVER (PARTITION BY kind, scope ORDER BY name, token) AS i FROM faults)
""" % ("CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONTENT_TYPES.items()) + " ELSE p_type END")


@query(
    "audit_examples",
    with_views(b.DECLARED_GROUPS, CLAIMED, "named AS (SELECT *, owner || '/' || resource_group AS name FROM judged)", FAULTS)
    + "SELECT kind, token, name, instead, coalesce((SELECT string_agg(type, ',' ORDER BY type) FROM (SELECT type FROM contents c WHERE c.name = p.name "
    "ORDER BY type LIMIT 6)), '') AS types FROM placed p WHERE i <= most",
)
def audit_examples(spark, folder):
    groups = claimed_groups(spark, folder)
    found = coherence.audit_examples(groups.withColumn("resource_group", F.concat_ws("/", "owner", "resource_group")))
    return found.select("kind", "token", "name", F.coalesce("instead", F.lit("")).alias("instead"), F.array_join("types", ",").alias("types"))


@query("token_coverage", with_views(b.DECLARED_GROUPS, CLAIMED) + "SELECT token, count(*) AS n FROM groups GROUP BY 1")
def token_coverage(spark, folder):
    return coherence.token_coverage(claimed_groups(spark, folder), "token")


# --- governance: GOV-01..06 -------------------------------------------------------------

def governed_rows(spark, folder):
    """Orders as resources with the properties that rules read."""
    k = F.col("o_orderkey")

    def when(condition, value):
        return F.when(condition, F.lit(value))

    port = F.when(k % 3 == 0, "22").when(k % 3 == 1, "3389").otherwise("*")
    rule = F.struct(
        F.concat(F.lit("rule-"), k).alias("name"),
        F.struct(
            F.when(k % 5 == 0, "Deny").otherwise("Allow").alias("access"),
            F.when(k % 7 == 0, "Outbound").otherwise("Inbound").alias("direction"),
            port.alias("destinationPortRange"),
            F.when(k % 11 == 0, "10.0.0.0/8").otherwise("*").alias("sourceAddressPrefix"),
            F.lit(100).alias("priority"),
        ).alias("properties"),
    )
    properties = F.to_json(F.struct(
        (F.col("o_orderstatus") == "F").alias("allowBlobPublicAccess"),
        (k % 3 != 0).alias("supportsHttpsTrafficOnly"),
        F.when(k % 5 == 0, "TLS1_0").otherwise("TLS1_2").alias("minimumTlsVersion"),
        (k % 7 != 0).alias("enableSoftDelete"),
        when(k % 3 != 0, True).alias("enablePurgeProtection"),
        (k % 9 != 0).alias("enableRBAC"),
        F.struct(F.when(k % 3 == 0, "Disabled").otherwise("Enabled").alias("state")).alias("auditingSettings"),
        when(k % 2 == 1, "Disabled").alias("transparentDataEncryption"),
        when(k % 3 == 1, True).alias("_noRecoveryServicesLink"),
        F.struct(F.struct(F.struct((k % 16 != 0).alias("enabled")).alias("blob")).alias("services")).alias("encryption"),
        F.when(k % 2 == 1, F.array(rule)).alias("securityRules"),
    ))
    tags = F.map_concat(
        F.when(F.col("o_orderstatus") != "P", F.create_map(F.lit("environment"), F.lit("prod"))).otherwise(empty_map()),
        F.when(k % 2 == 0, F.create_map(F.lit("owner"), F.lit("team"))).otherwise(empty_map()),
        F.when(k % 3 == 0, F.create_map(F.lit("costCenter"), F.lit("1"))).otherwise(empty_map()),
    )
    return b.table(spark, folder, "orders").select(
        k.alias("id"), b.pick_from(b.ESTATE_TYPES, k % 8).alias("type"), tags.alias("tags"), properties.alias("properties"))


BROKEN = """
broken AS (SELECT id, unnest(codes) AS code FROM (SELECT o_orderkey AS id, list_filter([
  CASE WHEN i = 0 AND k % 16 = 0 THEN 'STORAGE_NO_ENCRYPTION' END, CASE WHEN i = 0 AND o_orderstatus = 'F' THEN 'STORAGE_PUBLIC_ACCESS' END,
  CASE WHEN i = 0 AND k % 3 = 0 THEN 'STORAGE_HTTP_ALLOWED' END, CASE WHEN i = 0 AND k % 5 = 0 THEN 'STORAGE_OLD_TLS' END,
  CASE WHEN i = 1 AND o AND k % 3 = 0 THEN 'NSG_OPEN_SSH' END, CASE WHEN i = 1 AND o AND k % 3 = 1 THEN 'NSG_OPEN_RDP' END,
  CASE WHEN i = 1 AND o AND k % 3 = 2 THEN 'NSG_OPEN_ALL' END,
  CASE WHEN i = 2 AND k % 7 = 0 THEN 'KV_NO_SOFT_DELETE' END, CASE WHEN i = 7 AND k % 3 = 1 THEN 'VM_NO_BACKUP' END,
  CASE WHEN o_orderstatus = 'P' THEN 'TAG_MISSING_ENV' END, CASE WHEN k % 2 = 1 THEN 'TAG_MISSING_OWNER' END,
  CASE WHEN k % 3 <> 0 THEN 'TAG_MISSING_COSTCENTER' END, CASE WHEN i = 4 AND k % 3 = 0 THEN 'SQL_NO_AUDIT' END,
  CASE WHEN i = 5 AND k % 2 = 1 THEN 'SQL_NO_TDE' END, CASE WHEN i = 3 AND k % 9 = 0 THEN 'AKS_RBAC_DISABLED' END],
  lambda x: x IS NOT NULL) AS codes FROM (SELECT *, o_orderkey AS k, o_orderkey % 8 AS i,
    o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS o FROM orders)))
"""
SEVERITY = "CASE WHEN code IN ('STORAGE_NO_ENCRYPTION', 'STORAGE_PUBLIC_ACCESS', 'NSG_OPEN_SSH', 'NSG_OPEN_RDP', 'NSG_OPEN_ALL', 'SQL_NO_TDE') THEN 'High' WHEN code LIKE 'TAG%' OR code = 'VM_NO_BACKUP' THEN 'Low' ELSE 'Medium' END"


@query(
    "broken_rules",
    with_views(BROKEN)
    + f"SELECT id, code, {SEVERITY} AS severity, CASE WHEN code LIKE 'NSG%' THEN '{{\"path\":\"properties.securityRules\"}}' "
    "WHEN code = 'TAG_MISSING_ENV' THEN '{\"path\":\"tags.environment\"}' ELSE '' END AS detail FROM broken",
)
def broken_rules(spark, folder):
    shown = F.col("code").startswith("NSG") | (F.col("code") == "TAG_MISSING_ENV")
    return governance.evaluate(governed_rows(spark, folder)).withColumn("detail", F.when(shown, F.col("detail")).otherwise(""))


@query(
    "open_port_rules",
    with_views(BROKEN) + "SELECT id, code FROM broken WHERE code LIKE 'NSG%'",
)
def open_port_rules(spark, folder):
    rules = tuple(r for r in governance.RULES if r.code.startswith("NSG"))
    return governance.evaluate(governed_rows(spark, folder), rules).select("id", "code")


@query(
    "missing_tags",
    with_views(BROKEN) + "SELECT id, code FROM broken WHERE code LIKE 'TAG%'",
)
def missing_tags(spark, folder):
    rules = tuple(r for r in governance.RULES if r.code.startswith("TAG"))
    return governance.evaluate(governed_rows(spark, folder), rules).select("id", "code")


def machines_and_interfaces(spark, folder):
    machines = b.estate_rows(spark, folder).select(
        F.concat(F.lit("vm-"), "number").alias("id"), "type",
        F.concat(F.lit('{"networkProfile":{"networkInterfaces":[{"id":"nic-'), "subscription_id", F.lit('"}]}}')).alias("properties"))
    public = F.when(F.col("c_nationkey") % 2 == 0, '"publicIPAddress":{"id":"ip"}').otherwise('"subnet":{"id":"net"}')
    interfaces = b.table(spark, folder, "customer").select(
        F.concat(F.lit("nic-"), "c_custkey").alias("id"), F.lit(t.NIC).alias("type"),
        F.concat(F.lit('{"ipConfigurations":[{"properties":{'), public, F.lit("}}]}")).alias("properties"))
    return machines.union(interfaces)


@query(
    "rule_rates",
    with_views(
        BROKEN,
        "e AS (SELECT o_orderkey % 8 AS i, count(*) AS n FROM orders GROUP BY 1)",
        """r(code, i, expected) AS (VALUES ('STORAGE_NO_ENCRYPTION', 0, 0.08), ('STORAGE_PUBLIC_ACCESS', 0, 0.05), ('STORAGE_HTTP_ALLOWED', 0, 0.03),
  ('STORAGE_OLD_TLS', 0, 0.04), ('NSG_OPEN_SSH', 1, 0.06), ('NSG_OPEN_RDP', 1, 0.04), ('NSG_OPEN_ALL', 1, 0.02), ('KV_NO_SOFT_DELETE', 2, 0.07),
  ('KV_NO_PURGE_PROTECT', 2, 0.10), ('VM_NO_BACKUP', 7, 0.15), ('TAG_MISSING_ENV', -1, 0.12), ('TAG_MISSING_OWNER', -1, 0.18),
  ('TAG_MISSING_COSTCENTER', -1, 0.15), ('SQL_NO_AUDIT', 4, 0.10), ('SQL_NO_TDE', 5, 0.05), ('AKS_RBAC_DISABLED', 3, 0.08), ('DISK_UNENCRYPTED', -2, 0.06))""",
        "x AS (SELECT r.code, CAST(coalesce((SELECT sum(n) FROM e WHERE e.i = r.i OR r.i = -1), 0) AS BIGINT) AS eligible, "
        "(SELECT count(*) FROM broken WHERE broken.code = r.code) AS hits, CAST(expected AS DOUBLE) AS expected_rate FROM r)")
    + "SELECT code, eligible, hits, coalesce(round(hits / nullif(eligible, 0), 9), -1.0) AS rate, expected_rate FROM x "
    "UNION ALL SELECT 'VM_PUBLIC_IP', count(*), count(*) FILTER (c_nationkey % 2 = 0), coalesce(round(avg((c_nationkey % 2 = 0)::INT), 9), -1.0), 0.08::DOUBLE "
    "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 8 = 7",
)
def rule_rates(spark, folder):
    found = governance.rates(governed_rows(spark, folder)).unionByName(governance.public_machine_rate(machines_and_interfaces(spark, folder)))
    return found.withColumn(
        "rate", F.round(F.coalesce("rate", F.lit(-1.0)), 9))


@query(
    "public_machines",
    "SELECT o_orderkey AS id, 'VM_PUBLIC_IP' AS code, 'Medium' AS severity FROM orders JOIN customer ON o_custkey = c_custkey "
    "WHERE o_orderkey % 8 = 7 AND c_nationkey % 2 = 0",
)
def public_machines(spark, folder):
    return governance.public_machines(machines_and_interfaces(spark, folder)).withColumn(
        "id", F.substring("id", 4, 20).cast("long"))


@query(
    "machines_without_backup",
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 8 = 7 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def machines_without_backup(spark, folder):
    machines = b.estate_rows(spark, folder).where(F.col("type") == t.VM).select(F.col("number").alias("o_orderkey"))
    backups = b.table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return governance.without_link(machines, backups, "o_orderkey")


@query(
    "misplaced_rows",
    "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') "
    "AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)",
)
def misplaced_rows(spark, folder):
    rows = b.table(spark, folder, "customer").withColumnRenamed("c_nationkey", "scope")
    hubs = b.table(spark, folder, "supplier").where("s_acctbal > 8000").withColumnRenamed("s_nationkey", "scope")
    return governance.misplaced(rows, hubs, ["scope"], "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey")


@query(
    "custom_authorization_roles",
    "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 IN (0, 1)",
)
def custom_authorization_roles(spark, folder):
    action = F.element_at(
        F.array(*[F.lit(a) for a in ("Microsoft.Authorization/*", "*", "*/read", "Microsoft.Compute/*")]),
        (F.col("o_orderkey") % 4 + 1).cast("int"))
    role = F.to_json(F.struct(
        F.when(F.col("o_orderstatus") == "F", "CustomRole").otherwise("BuiltInRole").alias("type"),
        F.array(F.struct(F.array(F.lit("Microsoft.Web/read"), action).alias("actions"))).alias("permissions")))
    rows = b.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit(t.ROLE_DEFINITION).alias("type"), role.alias("properties"))
    return governance.custom_authorization_roles(rows).select("id")


@query("off_pattern_names", "SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, '^(red|blue|small|old) [a-z]+$')")
def off_pattern_names(spark, folder):
    return governance.off_pattern(b.table(spark, folder, "part"), "p_name", "^(red|blue|small|old) [a-z]+$").select("p_partkey")


@query(
    "off_catalogue_sizes",
    "SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT CASE WHEN l_returnflag = 'R' AND l_discount >= 0.06 AND l_quantity < 40 THEN CAST(l_quantity AS INT) ELSE -1 END FROM lineitem)",
)
def off_catalogue_sizes(spark, folder):
    offered = F.expr("l_returnflag = 'R' AND l_discount >= 0.06 AND l_quantity < 40")
    known = b.table(spark, folder, "lineitem").select(F.when(offered, F.col("l_quantity").cast("int")).otherwise(-1).alias("p_size"))
    return governance.off_catalogue(b.table(spark, folder, "part"), "p_size", known).select("p_partkey")


# --- identifiers and leaks: FN-01, FN-02, LEK-01..03, SET-01 ----------------------------

TOKENS = "tokens AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS token FROM documents)"


@query(
    "identifier_shapes",
    with_views(TOKENS, "urls AS (SELECT token FROM tokens UNION SELECT url FROM pages)")
    + """SELECT token,
  starts_with(lower(trim(token)), 'hidden-link:') OR starts_with(lower(trim(token)), 'hidden-related:') OR starts_with(lower(trim(token)), '__system__')
  OR contains(lower(token), '/subscriptions/') OR contains(lower(token), '/resourcegroups/') OR contains(lower(token), '/providers/')
  OR regexp_matches(trim(token), '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') OR regexp_matches(trim(token), '(?i)^[0-9a-f]{24,}$')
  OR (contains(token, ':') AND trim(split_part(trim(token), ':', 1)) <> '') AS key_like,
  regexp_matches(token, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}') OR regexp_matches(token, '(?i)[0-9a-f]{20,}')
  OR contains(lower(token), '/subscriptions/') OR contains(lower(token), '/resourcegroups/') OR contains(lower(token), '/providers/')
  OR length(trim(token)) > 40 AS value_like
FROM urls""",
)
def identifier_shapes(spark, folder):
    tokens = b.table(spark, folder, "documents").select(F.explode(F.split("text", "\\s+")).alias("token"))
    every = tokens.union(b.table(spark, folder, "pages").select("url")).distinct()
    return every.select(
        "token", text.is_identifier_key("token").alias("key_like"), text.is_identifier_value("token").alias("value_like"))


BENCH_TERMS = """
words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS term FROM benchmark),
sentences AS (SELECT DISTINCT trim(unnest(string_split(text, '.'))) AS term FROM benchmark),
long_words AS MATERIALIZED (SELECT term FROM words WHERE length(term) >= 6),
phrases AS MATERIALIZED (SELECT term FROM sentences WHERE length(term) >= 3 AND contains(term, ' ')),
doc_words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))) AS term FROM documents),
near AS MATERIALIZED (SELECT doc_id, text, term FROM documents, phrases WHERE contains(text, term)),
hits AS (SELECT doc_id, term FROM doc_words JOIN long_words USING (term)
  UNION SELECT doc_id, term FROM near
    WHERE regexp_matches(text, '(^|[^\\p{L}\\p{N}_])' || regexp_escape(term) || '($|[^\\p{L}\\p{N}_])'))
"""


def bench_terms(spark, folder):
    bench = b.table(spark, folder, "benchmark")
    single = bench.select(F.explode(F.regexp_extract_all("text", F.lit(leaks.IDENT_RUN), F.lit(0))).alias("term"))
    sentences = bench.select(F.explode(F.split("text", "\\.")).alias("s")).select(F.trim("s").alias("term"))
    return (
        single.where(F.char_length("term") >= 6)
        .union(sentences.where((F.char_length("term") >= 3) & F.contains(F.col("term"), F.lit(" "))))
        .distinct())


@query(
    "leaking_documents",
    with_views(BENCH_TERMS)
    + "SELECT doc_id, count(*) AS leaks, CAST(max(length(term)) AS BIGINT) AS longest FROM hits GROUP BY 1",
)
def leaking_documents(spark, folder):
    found = leaks.leaks(b.table(spark, folder, "documents"), bench_terms(spark, folder), "doc_id", "text")
    return found.withColumn("longest", F.col("longest").cast("long"))


@query(
    "leaked_term_lengths",
    with_views(BENCH_TERMS)
    + "SELECT CAST(length(term) AS BIGINT) AS length, count(DISTINCT term) AS terms, count(*) AS texts FROM hits GROUP BY 1",
)
def leaked_term_lengths(spark, folder):
    found = leaks.leak_pairs(b.table(spark, folder, "documents"), bench_terms(spark, folder), "doc_id", "text")
    # The pairs are distinct, so counting them per term first needs no distinct aggregate.
    per_term = found.groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
    return per_term.groupBy(F.length("term").cast("long").alias("length")).agg(
        F.count(F.lit(1)).alias("terms"), F.sum("texts").alias("texts"))


NAMES = """
ids AS (SELECT c_name AS term FROM customer UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part
  UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders UNION SELECT o_orderstatus FROM orders UNION SELECT 'user-' || user_id FROM events),
kept AS (SELECT DISTINCT trim(term) AS term FROM ids WHERE length(trim(term)) >= 3 AND NOT regexp_matches(trim(term), '^[0-9]+$'))
"""


@query(
    "identifier_terms",
    with_views(NAMES)
    + "SELECT term FROM kept WHERE term NOT IN (SELECT p_name FROM part WHERE p_size > 45)",
)
def identifier_terms(spark, folder):
    def t_(name):
        return b.table(spark, folder, name)

    columns = [
        (t_("customer"), "c_name"), (t_("supplier"), "s_name"), (t_("part"), "p_name"), (t_("orders"), "o_orderkey"),
        (t_("orders"), "o_orderstatus"), (t_("events").select(F.concat(F.lit("user-"), "user_id").alias("u")), "u")]
    name = F.when(F.col("p_size") > 45, F.col("p_name")).otherwise("")
    clean = t_("part").select("p_partkey", F.concat(F.lit("<"), name, F.lit(">")).alias("note"))
    return leaks.build_terms(columns, [(t_("events"), "props")], (clean, "p_partkey", "note"))


ROW_TERMS = """
raw AS (SELECT doc_id, 'doc-' || doc_id AS name, lang, source, quality, custom FROM doc_tags),
identifiers AS (SELECT name AS term FROM raw UNION SELECT source FROM raw UNION SELECT 'customKey' FROM raw WHERE custom IS NOT NULL
  UNION SELECT custom FROM raw WHERE custom IS NOT NULL),
published AS (SELECT 'Country' AS term FROM raw UNION SELECT lang FROM raw UNION SELECT 'project' FROM raw
  UNION SELECT 'Tier' FROM raw WHERE quality IS NOT NULL UNION SELECT CAST(quality AS VARCHAR) FROM raw WHERE quality IS NOT NULL)
"""


@query(
    "derived_terms",
    with_views(b.TAGGED_DOCUMENTS, ROW_TERMS)
    + "SELECT term, 'identifier' AS kind FROM identifiers UNION ALL SELECT term, 'published' FROM published",
)
def derived_terms(spark, folder):
    rows = b.tagged_documents(spark, folder).withColumn("name", F.concat(F.lit("doc-"), "doc_id"))
    found, published = leaks.row_terms(rows, ["name"], "tags")
    return found.withColumn("kind", F.lit("identifier")).union(published.withColumn("kind", F.lit("published")))


@query(
    "final_terms",
    with_views(b.TAGGED_DOCUMENTS, ROW_TERMS)
    + "SELECT term FROM (SELECT c_name AS term FROM customer UNION SELECT term FROM identifiers UNION SELECT lang FROM raw UNION SELECT o_orderpriority FROM orders) "
    "EXCEPT SELECT term FROM published",
)
def final_terms(spark, folder):
    rows = b.tagged_documents(spark, folder).withColumn("name", F.concat(F.lit("doc-"), "doc_id"))
    found, published = leaks.row_terms(rows, ["name"], "tags")
    listed = b.table(spark, folder, "customer").select(F.col("c_name").alias("term")).union(
        b.table(spark, folder, "documents").select("lang"))
    groups = b.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("term"))
    return leaks.term_list(listed, found, groups, published)
