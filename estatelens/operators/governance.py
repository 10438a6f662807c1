"""Finding governance defects.

Rules are data: an id, a severity, a rate to expect and a condition on a row. Rows are
frames with ``id``, ``type``, ``tags`` (map) and ``properties`` (JSON text).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.catalogues import types as t

ANY_TYPE = "*"


@dataclass(frozen=True)
class Rule:
    code: str
    eligible_type: str
    expected_rate: float
    severity: str
    broken: Callable[[], Column]
    looks_at: str


def check_rules(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    codes = [r.code for r in rules]
    twice = sorted({c for c in codes if codes.count(c) > 1})
    if twice:
        raise ValueError(f"duplicate rule codes: {twice}")
    return rules


def prop(path: str) -> Column:
    return F.get_json_object("properties", f"$.{path}")


def _equals(path: str, value: str) -> Callable[[], Column]:
    return lambda: F.coalesce(prop(path) == value, F.lit(False))


def _no_tag(key: str) -> Callable[[], Column]:
    return lambda: ~F.coalesce(F.map_contains_key(F.col("tags"), key), F.lit(False))


SECURITY_RULES = (
    "array<struct<name: string, properties: struct<access: string, direction: string, "
    "destinationPortRange: string, sourceAddressPrefix: string, priority: int>>>"
)


def opens_port(rules: Column, port: str) -> Column:
    """An inbound allow rule from anywhere for exactly this port."""
    return F.exists(
        rules,
        lambda r: (r["properties"]["access"] == "Allow")
        & (r["properties"]["direction"] == "Inbound")
        & (r["properties"]["sourceAddressPrefix"] == "*")
        & (r["properties"]["destinationPortRange"] == port),
    )


def _open_port(port: str) -> Callable[[], Column]:
    return lambda: F.coalesce(
        opens_port(F.from_json(prop("securityRules"), SECURITY_RULES), port), F.lit(False)
    )


# --- fixed values: must equal the reference's for right results ---------------------
RULES = check_rules((
    Rule("STORAGE_NO_ENCRYPTION", t.STORAGE, 0.08, "High",
         _equals("encryption.services.blob.enabled", "false"), "properties.encryption.services.blob.enabled"),
    Rule("STORAGE_PUBLIC_ACCESS", t.STORAGE, 0.05, "High", _equals("allowBlobPublicAccess", "true"), "properties.allowBlobPublicAccess"),
    Rule("STORAGE_HTTP_ALLOWED", t.STORAGE, 0.03, "Medium", _equals("supportsHttpsTrafficOnly", "false"), "properties.supportsHttpsTrafficOnly"),
    Rule("STORAGE_OLD_TLS", t.STORAGE, 0.04, "Medium", _equals("minimumTlsVersion", "TLS1_0"), "properties.minimumTlsVersion"),
    Rule("NSG_OPEN_SSH", t.NSG, 0.06, "High", _open_port("22"), "properties.securityRules"),
    Rule("NSG_OPEN_RDP", t.NSG, 0.04, "High", _open_port("3389"), "properties.securityRules"),
    Rule("NSG_OPEN_ALL", t.NSG, 0.02, "High", _open_port("*"), "properties.securityRules"),
    Rule("KV_NO_SOFT_DELETE", t.KEY_VAULT, 0.07, "Medium", _equals("enableSoftDelete", "false"), "properties.enableSoftDelete"),
    Rule("KV_NO_PURGE_PROTECT", t.KEY_VAULT, 0.10, "Medium", _equals("enablePurgeProtection", "false"), "properties.enablePurgeProtection"),
    Rule("VM_NO_BACKUP", t.VM, 0.15, "Low", _equals("_noRecoveryServicesLink", "true"), "properties._noRecoveryServicesLink"),
    Rule("TAG_MISSING_ENV", ANY_TYPE, 0.12, "Low", _no_tag("environment"), "tags.environment"),
    Rule("TAG_MISSING_OWNER", ANY_TYPE, 0.18, "Low", _no_tag("owner"), "tags.owner"),
    Rule("TAG_MISSING_COSTCENTER", ANY_TYPE, 0.15, "Low", _no_tag("costCenter"), "tags.costCenter"),
    Rule("SQL_NO_AUDIT", t.SQL_SERVER, 0.10, "Medium", _equals("auditingSettings.state", "Disabled"), "properties.auditingSettings.state"),
    Rule("SQL_NO_TDE", t.SQL_DATABASE, 0.05, "High", _equals("transparentDataEncryption", "Disabled"), "properties.transparentDataEncryption"),
    Rule("AKS_RBAC_DISABLED", t.AKS, 0.08, "Medium", _equals("enableRBAC", "false"), "properties.enableRBAC"),
    Rule("DISK_UNENCRYPTED", t.DISK, 0.06, "High", _equals("encryption.enabled", "false"), "properties.encryption.enabled"),
))
VM_PUBLIC_IP = ("VM_PUBLIC_IP", 0.08, "Medium")
CODES = tuple(r.code for r in RULES) + (VM_PUBLIC_IP[0],)


def _eligible(rule: Rule) -> Column:
    return F.lit(True) if rule.eligible_type == ANY_TYPE else F.col("type") == rule.eligible_type


def evaluate(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, code, severity, detail) of every broken rule, all rules in one scan.

    The detail names the field the rule looks at.
    """
    hits = F.array(*[
        F.when(
            _eligible(r) & r.broken(),
            F.struct(
                F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"),
                F.to_json(F.struct(F.lit(r.looks_at).alias("path"))).alias("detail"),
            ),
        )
        for r in rules
    ])
    return rows.select(
        "id", F.inline(F.filter(hits, lambda h: h.isNotNull()))
    )


def rates(rows: DataFrame, rules: tuple[Rule, ...] = RULES, expected: dict[str, float] | None = None) -> DataFrame:
    """Hits per eligible row and code, beside the expected rate, in one scan."""
    expected = expected or {}
    counts = rows.agg(*[
        c
        for r in rules
        for c in (
            F.count_if(_eligible(r)).alias(f"{r.code}|eligible"),
            F.count_if(_eligible(r) & r.broken()).alias(f"{r.code}|hits"),
        )
    ])
    out = [
        F.struct(
            F.lit(r.code).alias("code"),
            F.col(f"{r.code}|eligible").alias("eligible"),
            F.col(f"{r.code}|hits").alias("hits"),
            F.when(
                F.col(f"{r.code}|eligible") > 0,
                F.col(f"{r.code}|hits") / F.col(f"{r.code}|eligible"),
            ).alias("rate"),
            F.lit(float(expected.get(r.code, r.expected_rate))).alias("expected_rate"),
        )
        for r in rules
    ]
    return counts.select(F.inline(F.array(*out)))


def exposed_through(
    owners: DataFrame, parts: DataFrame, reference: str, part_key: str, exposed: Column
) -> DataFrame:
    """Rows that refer to at least one exposed part, e.g. machines whose interface is public.

    ``reference`` is an array column of part ids.
    """
    links = owners.select("id", F.explode(reference).alias(part_key))
    bad = parts.where(exposed).select(part_key).distinct()
    return links.join(bad, part_key, "left_semi").select("id").distinct()


def public_machines(rows: DataFrame) -> DataFrame:
    """Virtual machines with an interface that has a public address."""
    nics = F.from_json(prop("networkProfile.networkInterfaces"), "array<struct<id: string>>")
    configs = F.from_json(
        prop("ipConfigurations"),
        "array<struct<properties: struct<publicIPAddress: struct<id: string>>>>",
    )
    machines = rows.where(F.col("type") == t.VM).withColumn("nic_ids", nics["id"])
    interfaces = rows.where(F.col("type") == t.NIC).withColumn("configs", configs)
    public = F.exists(F.col("configs"), lambda c: c["properties"]["publicIPAddress"]["id"].isNotNull())
    code, _, severity = VM_PUBLIC_IP
    return exposed_through(
        machines, interfaces.withColumnRenamed("id", "nic_id"), "nic_ids", "nic_id", public
    ).select("id", F.lit(code).alias("code"), F.lit(severity).alias("severity"))


def public_machine_rate(rows: DataFrame, expected: float | None = None) -> DataFrame:
    """The rate of machines with a public address, in the columns of `rates`.

    The defect lies in another row, so it takes a join that the one-row rules do not.
    """
    machines = rows.where(F.col("type") == t.VM).agg(F.count(F.lit(1)).alias("eligible"))
    hits = public_machines(rows).agg(F.count(F.lit(1))).scalar()
    code, usual, _ = VM_PUBLIC_IP
    return machines.select(
        F.lit(code).alias("code"), "eligible", hits.alias("hits"),
        F.when(F.col("eligible") > 0, hits / F.col("eligible")).alias("rate"),
        F.lit(float(usual if expected is None else expected)).alias("expected_rate"))


def without_link(rows: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    """Rows no link mentions, e.g. machines without a backup."""
    return rows.join(links.select(key).distinct(), key, "left_anti")


def grants_authorization(permissions: Column, prefix: str = "Microsoft.Authorization/") -> Column:
    """A role whose actions reach into authorization itself."""
    return F.exists(
        permissions, lambda p: F.exists(p["actions"], lambda a: a.startswith(prefix) | (a == "*"))
    )


def custom_authorization_roles(rows: DataFrame) -> DataFrame:
    permissions = F.from_json(prop("permissions"), "array<struct<actions: array<string>>>")
    return rows.where(
        (F.col("type") == t.ROLE_DEFINITION)
        & (prop("type") == "CustomRole")
        & F.coalesce(grants_authorization(permissions), F.lit(False))
    )


def misplaced(rows: DataFrame, hubs: DataFrame, scope: list[str], location: str, allowed) -> DataFrame:
    """Rows beside a hub (same scope) in a region that is not allowed there."""
    return rows.where(~F.col(location).isin(*allowed)).join(
        hubs.select(*scope).distinct(), scope, "left_semi"
    )


def off_pattern(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    return rows.where(~F.col(name).rlike(pattern))


def off_catalogue(rows: DataFrame, key: str, catalogue: DataFrame) -> DataFrame:
    """Rows whose value is not in the catalogue; rows without a value are fine."""
    return rows.where(F.col(key).isNotNull()).join(
        catalogue.select(key).distinct(), key, "left_anti"
    )


def over_privileged(assignments: DataFrame) -> DataFrame:
    """Owner grants: to service principals, and at the scope of a whole owner."""
    owner_role = t.ROLE_PREFIX + t.ROLES["Owner"]
    held = assignments.where(F.col("role_definition_id") == owner_role)
    return held.agg(
        F.count_if(F.col("principal_type") == "ServicePrincipal").alias("owner_service_principals"),
        F.count_if(
            F.col("scope") == F.concat(F.lit("/subscriptions/"), F.col("subscription_id"))
        ).alias("owner_at_owner_scope"),
    )
