"""Change batches: snapshot in, snapshot and change log out.

A snapshot has ``id``, ``subscription_id``, ``type``, the maps ``tags``, ``sku`` and
``properties`` (field to text, nested values as JSON text), ``kind`` and
``drift_deleted_at``. The estate itself is never written here, so a dry run is simply not
writing what comes back.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.catalogues import types as t
from estatelens.catalogues.words import TIER_LADDER
from estatelens.functions.jsonmaps import (
    TEXT_MAP, empty_map, revert_field, set_key, sorted_map_text,
)
from estatelens.functions.keyed import keyed_letters
from estatelens.functions.text import resource_path
from estatelens.session import settle
from .fingerprint import canonical, fingerprint
from .integrity import blocking_batches, newer_in_force, removable
from .paging import page
from .ranking import keyed_rank, planned_count, rank_in_ranges, sample_exactly

ANY_TYPE = "*"
APPEAR, DISAPPEAR = "DRIFT_APPEAR", "DRIFT_DISAPPEAR"
APPEAR_PATH, HIDE_PATH = "@appear", "drift_deleted_at"
STATE_COLUMNS = ["id", "subscription_id", "type", "tags", "sku", "kind", "properties", HIDE_PATH]


def _gone(_: Column) -> Column:
    return F.lit(None).cast("string")


def _to(value: str) -> Callable[[Column], Column]:
    return lambda _: F.lit(value)


def _other_stage(before: Column) -> Column:
    return F.when(before.eqNullSafe("staging"), "production").otherwise("staging")


def next_tier(tier: Column) -> Column:
    """One step up the ladder; the top steps down, anything unknown becomes Premium."""
    step = F.lit("Premium")
    for i, name in enumerate(TIER_LADDER):
        after = TIER_LADDER[i + 1] if i + 1 < len(TIER_LADDER) else TIER_LADDER[i - 1]
        step = F.when(tier == name, after).otherwise(step)
    return step


def _shifted_sku(sku: Column) -> Column:
    tier = next_tier(F.element_at(sku, "tier"))
    name = F.element_at(sku, "name")
    head = F.split(name, "_")[0]
    renamed = F.when(
        head.isin(*TIER_LADDER), F.concat(tier, F.substring(name, F.length(head) + 1, F.length(name)))
    ).otherwise(name)
    with_tier = set_key(sku, F.lit("tier"), tier)
    return F.when(name.isNotNull(), set_key(with_tier, F.lit("name"), renamed)).otherwise(with_tier)


RULE = (
    "struct<name: string, properties: struct<access: string, direction: string, "
    "protocol: string, sourcePortRange: string, destinationPortRange: string, "
    "sourceAddressPrefix: string, destinationAddressPrefix: string, priority: int>>"
)


def open_inbound_rule(rules_json: Column) -> Column:
    """JSON of an allow-everything rule ten priorities behind the last one."""
    rules = F.from_json(F.coalesce(rules_json, F.lit("[]")), f"array<{RULE}>")
    last = F.array_max(F.transform(rules, lambda r: r["properties"]["priority"]))
    body = {
        "access": "Allow", "direction": "Inbound", "protocol": "*", "sourcePortRange": "*",
        "destinationPortRange": "*", "sourceAddressPrefix": "*", "destinationAddressPrefix": "*",
    }
    return F.to_json(
        F.struct(
            F.lit("AllowAll-Inbound-Drift").alias("name"),
            F.struct(
                *[F.lit(v).alias(k) for k, v in body.items()],
                (F.coalesce(F.nullif(last, F.lit(0)), F.lit(100)) + 10).alias("priority"),
            ).alias("properties"),
        )
    )


@dataclass(frozen=True)
class Change:
    """One kind of change: which rows may get it and what a field becomes."""

    code: str
    eligible_type: str
    kind: str
    path: str
    after: Callable[[Column], Column]
    requires: Callable[[], Column] | None = None

    @property
    def container(self) -> str:
        return self.path.split(".", 1)[0]

    @property
    def key(self) -> str:
        return self.path.split(".", 1)[1].removesuffix("[]") if "." in self.path else ""

    def eligible(self) -> Column:
        of_type = F.lit(True) if self.eligible_type == ANY_TYPE else F.col("type") == self.eligible_type
        return of_type if self.requires is None else of_type & F.coalesce(self.requires(), F.lit(False))


def _has_environment() -> Column:
    return F.map_contains_key(F.col("tags"), "environment")


def _has_sku() -> Column:
    return F.size(F.col("sku")) > 0


# --- fixed values: must equal the reference's for right results ---------------------
CHANGES = (
    Change("DRIFT_STORAGE_PUBLIC_ACCESS", t.STORAGE, "chaos", "properties.allowBlobPublicAccess", _to("true")),
    Change("DRIFT_STORAGE_HTTP_ALLOWED", t.STORAGE, "chaos", "properties.supportsHttpsTrafficOnly", _to("false")),
    Change("DRIFT_STORAGE_OLD_TLS", t.STORAGE, "chaos", "properties.minimumTlsVersion", _to("TLS1_0")),
    Change("DRIFT_NSG_OPEN_INBOUND", t.NSG, "chaos", "properties.securityRules[]", open_inbound_rule),
    Change("DRIFT_KV_NO_PURGE_PROTECT", t.KEY_VAULT, "chaos", "properties.enablePurgeProtection", _to("false")),
    Change("DRIFT_KV_NO_SOFT_DELETE", t.KEY_VAULT, "chaos", "properties.enableSoftDelete", _to("false")),
    Change("DRIFT_AKS_NO_RBAC", t.AKS, "chaos", "properties.enableRBAC", _to("false")),
    Change("DRIFT_TAGS_REMOVED", ANY_TYPE, "chaos", "tags.environment", _gone, _has_environment),
    Change("DRIFT_PROVISIONING_STATE", ANY_TYPE, "temporal", "properties.provisioningState", _to("Updating")),
    Change("DRIFT_SKU_TIER_SHIFT", ANY_TYPE, "temporal", "sku", _shifted_sku, _has_sku),
    Change("DRIFT_TAG_CHURN", ANY_TYPE, "temporal", "tags.environment", _other_stage, _has_environment),
    Change("DRIFT_SQL_TLS_DOWNGRADE", t.SQL_SERVER, "temporal", "properties.minimalTlsVersion", _to("1.0")),
    Change("DRIFT_SQL_PUBLIC_NETWORK", t.SQL_SERVER, "temporal", "properties.publicNetworkAccess", _to("Enabled")),
    Change("DRIFT_SQLDB_TDE_DISABLED", t.SQL_DATABASE, "temporal", "properties.transparentDataEncryption", _to("Disabled")),
    Change("DRIFT_WEBSITE_HTTPS_OFF", t.WEBSITE, "temporal", "properties.httpsOnly", _to("false")),
    Change("DRIFT_WEBSITE_STOPPED", t.WEBSITE, "temporal", "properties.state", _to("Stopped")),
)


def check_changes(changes: tuple[Change, ...]) -> tuple[Change, ...]:
    codes = [c.code for c in changes]
    twice = sorted({c for c in codes if codes.count(c) > 1})
    if twice:
        raise ValueError(f"duplicate change codes: {twice}")
    return changes


check_changes(CHANGES)


def _chosen(kind: str, codes, changes) -> list[Change]:
    picked = [c for c in changes if c.kind == kind and (codes is None or c.code in set(codes))]
    return sorted(picked, key=lambda c: c.code)


def _eligible_codes(chosen: list[Change], types) -> Column:
    allowed = F.lit(True) if types is None else F.col("type").isin(*types)
    marks = [F.when(c.eligible() & allowed, F.lit(c.code)) for c in chosen]
    if not marks:
        return F.array().cast("array<string>")
    return F.filter(F.array(*marks), lambda c: c.isNotNull())


def eligible_rows(
    rows: DataFrame, kind: str, codes=None, types=None, changes: tuple[Change, ...] = CHANGES,
    key: str = "id",
) -> DataFrame:
    """(id, drift_code) for every change a row may get, all codes in one scan."""
    return rows.select(
        key, F.explode(_eligible_codes(_chosen(kind, codes, changes), types)).alias("drift_code")
    )


def sample_changes(
    rows: DataFrame, kind: str, intensity: float, seed: int, codes=None, types=None,
    changes: tuple[Change, ...] = CHANGES, key: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """Exactly the planned number of rows per code, and the plan with what was asked for."""
    hits = eligible_rows(rows, kind, codes, types, changes, key)
    counted = hits.groupBy("drift_code").agg(F.count(F.lit(1)).alias("eligible"))
    quota, target = planned_count(intensity, F.col("eligible"))
    plan = counted.withColumn("target", target).withColumn("quota", quota)
    # One row per code of the registry.
    return sample_exactly(hits, F.broadcast(plan), ["drift_code"], [key], seed, "drift"), plan


def _delta(change: Change, position: int, before: Column, after: Column) -> Column:
    return F.struct(
        F.lit(position).alias("position"), F.lit(change.code).alias("drift_code"),
        F.lit(change.path).alias("field_path"), before.alias("before"), after.alias("after"),
    )


def _appended(list_json: Column, element: Column) -> Column:
    inner = F.regexp_replace(F.coalesce(list_json, F.lit("[]")), "^\\[|\\]$", "")
    return F.concat(
        F.lit("["), F.when(inner != "", F.concat(inner, F.lit(","))).otherwise(""), element, F.lit("]")
    )


def _none_of(names) -> Callable[[Column, Column], Column]:
    return lambda key, _: ~key.isin(*names)


def _folded(changes: list[Change], on: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """Values to compute first, in their order, new container columns and the array of deltas.

    The value of each field is followed through the changes that touch it, so a later
    change sees an earlier one; fields that nobody touches twice stay flat expressions.
    New containers and list elements are long expressions that are read several times, so
    they become columns of their own.
    """
    first: dict[str, Column] = {}
    fields: dict[tuple[str, str], Column] = {}
    whole: dict[str, Column] = {}
    deltas = []

    def once(position: int, hit: Column, value: Column) -> Column:
        name = f"__after_{position}"
        first[name] = F.when(hit, value)
        return F.col(name)

    for position, change in enumerate(changes):
        hit = on[change.code]
        if change.container == change.path:
            before = whole.get(change.container, F.col(change.container))
            after = once(position, hit, change.after(before))
            whole[change.container] = F.when(hit, after).otherwise(before)
            delta = _delta(change, position, sorted_map_text(before), sorted_map_text(after))
        else:
            field = (change.container, change.key)
            before = fields.get(field, F.element_at(F.col(change.container), change.key))
            after = change.after(before)
            if change.path.endswith("[]"):
                after = once(position, hit, after)
                delta = _delta(change, position, F.lit(None).cast("string"), after)
                fields[field] = F.when(hit, _appended(before, after)).otherwise(before)
            else:
                delta = _delta(change, position, before, after)
                fields[field] = F.when(hit, after).otherwise(before)
        deltas.append(F.when(hit, delta))
    columns = dict(whole)
    for container in sorted({c for c, _ in fields}):
        held = F.coalesce(F.col(container), empty_map())
        mine = {key: value for (c, key), value in fields.items() if c == container}
        others = F.map_filter(held, _none_of(mine))
        entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in mine.items()])
        # A field keeps a NULL only if it had one and nobody touched it.
        present = F.filter(entries, lambda x: x["value"].isNotNull())
        columns[container] = F.map_concat(others, F.map_from_entries(present))
    return first, columns, F.filter(F.array(*deltas), lambda d: d.isNotNull())


def changed_rows(
    rows: DataFrame, kind: str, codes, types, intensity: float, seed: int,
    changes: tuple[Change, ...], key: str, touched_only: bool = False,
) -> DataFrame:
    """The rows after the changes, each with its deltas in ``__deltas``; all of them, or those that a change touches."""
    chosen = _chosen(kind, codes, changes)
    if not chosen:
        raise ValueError(f"no change of kind {kind!r} is selected")
    marked = rows
    if intensity == 1.0:
        allowed = F.lit(True) if types is None else F.col("type").isin(*types)
        on = {c.code: c.eligible() & allowed for c in chosen}
    else:
        picked, _ = sample_changes(rows, kind, intensity, seed, codes, types, changes, key)
        # At most one entry per code and row.
        per_row = picked.groupBy(key).agg(F.collect_set("drift_code").alias("__codes"))
        marked = rows.join(per_row, key, "left")
        on = {c.code: F.coalesce(F.array_contains("__codes", c.code), F.lit(False)) for c in chosen}
    first, columns, deltas = _folded(chosen, on)
    touched = F.lit(False)
    for hit in on.values():
        touched = touched | hit
    after = {c: F.when(touched, new).otherwise(F.col(c)) for c, new in columns.items()}
    if touched_only:  # told before a change is computed, not by the deltas that come out
        marked = marked.where(touched)
    for name, value in first.items():  # a later one may read an earlier one
        marked = marked.withColumn(name, value)
    return marked.withColumns({**after, "__deltas": deltas}).drop("__codes", *first)


def _split(changed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    logged = changed.select(F.col(key).alias("resource_id"), "subscription_id", F.inline("__deltas"))
    return changed.drop("__deltas"), logged


def compute_deltas(
    rows: DataFrame, kind: str, codes=None, types=None, intensity: float = 1.0, seed: int = 0,
    changes: tuple[Change, ...] = CHANGES, key: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """The changed rows and one delta per (row, code), codes applied in sorted order.

    Which rows are eligible is read off the state the batch starts from; no change of a
    kind makes another of the kind apply or not apply. Intensity 1 takes every eligible
    row and needs no shuffle at all.
    """
    return _split(changed_rows(rows, kind, codes, types, intensity, seed, changes, key), key)


def disappearing(rows: DataFrame, references: list[DataFrame], count: int, seed: int) -> DataFrame:
    """``count`` rows that nothing refers to and nothing lies below, or all of them."""
    free = removable(rows, references)
    return keyed_rank(free, [], ["id"], seed, "disappear", "rank", F.lit(count)).drop("rank")


def appearing(groups: DataFrame, count: int, seed: int) -> DataFrame:
    """``count`` new untagged rows, dealt to the groups in turn by name.

    ``groups`` has subscription_id, name and location. No more than ``count`` groups can
    get a row, so no others are kept.
    """
    dealt = rank_in_ranges(groups, [], ["name", "subscription_id"], "turn").where(F.col("turn") <= count)
    held = dealt.withColumnRenamed("name", "resource_group")
    groups_in_turn = dealt.agg(F.max("turn")).scalar()
    spark = groups.sparkSession
    minted = spark.range(count).withColumn("turn", F.col("id") % groups_in_turn + 1)
    name = F.concat(F.lit("st"), keyed_letters(10, seed, "appear", "id"), F.lpad(F.col("id").cast("string"), 4, "0"))
    return (
        minted.withColumn("name", name)
        .withColumnRenamed("id", "nth")
        .join(held, "turn")
        .select(
            resource_path("subscription_id", "resource_group", F.lit(t.STORAGE), "name").alias("id"),
            "subscription_id", F.lit(t.STORAGE).alias("type"), "resource_group", "name", "location",
            empty_map().alias("tags"), empty_map().alias("sku"), F.lit(None).cast("string").alias("kind"),
            empty_map().alias("properties"), F.lit(None).cast("timestamp").alias(HIDE_PATH),
        )
    )


def visible_digest(state: DataFrame) -> Column:
    """The digest of a row that can be seen, null for a hidden one."""
    columns = [c for c in STATE_COLUMNS if c in state.columns]
    return F.when(F.col(HIDE_PATH).isNull(), F.sha2(canonical(state, columns, marks={HIDE_PATH}), 256))


def visible_fingerprint(state: DataFrame) -> Column:
    """Fingerprint of the rows that can be seen, as a subquery."""
    seen = state.where(F.col(HIDE_PATH).isNull())
    columns = [c for c in STATE_COLUMNS if c in state.columns]
    return fingerprint(seen, columns, marks={HIDE_PATH}).select("fingerprint").scalar()


def next_seq(batches: DataFrame, fresh: DataFrame, order: list[str]) -> DataFrame:
    """Number new batches behind the existing ones; one row per change call, so few."""
    last = batches.agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()
    return fresh.withColumn("seq", last + F.row_number().over(Window.orderBy(*order)))


def number_records(deltas: DataFrame, first: int | Column = 0) -> DataFrame:
    """Record ids in order of (position, resource), counted range by range."""
    ranked = rank_in_ranges(deltas, [], ["position", "resource_id", "drift_code"], "record_id")
    start = first if isinstance(first, Column) else F.lit(first)
    return ranked.withColumn("record_id", F.col("record_id") + start)


def lost_deltas(gone: DataFrame, position: int) -> DataFrame:
    """Deltas of rows that go."""
    return gone.select(
        F.col("id").alias("resource_id"), "subscription_id", F.lit(position).alias("position"),
        F.lit(DISAPPEAR).alias("drift_code"), F.lit(HIDE_PATH).alias("field_path"),
        F.lit(None).cast("string").alias("before"), F.lit("drift-deleted").alias("after"),
    )


def minted_deltas(minted: DataFrame, position: int) -> DataFrame:
    """Deltas of rows that come."""
    return minted.select(
        F.col("id").alias("resource_id"), "subscription_id", F.lit(position).alias("position"),
        F.lit(APPEAR).alias("drift_code"), F.lit(APPEAR_PATH).alias("field_path"),
        F.lit(None).cast("string").alias("before"), F.lit("appear").alias("after"),
    )


def logged_records(deltas: DataFrame, records: DataFrame, batch_id: str, kind: str) -> DataFrame:
    """A batch's records, numbered behind those that are there."""
    last_record = records.agg(F.coalesce(F.max("record_id"), F.lit(0))).scalar()
    origin = F.to_json(F.struct(F.col("drift_code"), F.lit(kind).alias("drift_type")))
    return number_records(deltas, last_record).select(
        "*", F.lit(batch_id).alias("batch_id"), origin.alias("metadata")).drop("position")


def options_text(intensity: float, types, codes, disappear: int, appear: int) -> str:
    """The options a batch is made with, as they are kept with it."""
    return json.dumps({
        "intensity": intensity, "resource_types": types and list(types), "codes": codes and list(codes),
        "disappear": disappear, "appear": appear})


@dataclass(frozen=True)
class Batch:
    snapshot: DataFrame
    batch: DataFrame
    records: DataFrame


def apply_changes(
    state: DataFrame, batches: DataFrame, records: DataFrame, batch_id: str, kind: str,
    applied_at: Column, codes=None, types=None, intensity: float = 1.0, seed: int = 0,
    references: list[DataFrame] | None = None, disappear: int = 0,
    groups: DataFrame | None = None, appear: int = 0, changes: tuple[Change, ...] = CHANGES,
) -> Batch:
    """One change batch: the new snapshot, the batch row and its records.

    Hidden rows are left alone. The batch carries fingerprints of what could be seen
    before and after, so consecutive batches chain, and the options it was made with.

    The change is evaluated once: changed rows with their deltas, rows that go or come and
    the numbered records are settled, and the result's fingerprint reads what was written.
    """
    hidden = F.col(HIDE_PATH).isNotNull()
    seen = state.where(~hidden)
    changed, deltas = _split(settle(changed_rows(seen, kind, codes, types, intensity, seed, changes, "id")), "id")
    if disappear:
        gone = settle(disappearing(changed, references or [], disappear, seed).select("id"))
        marks = gone.withColumn("__gone", F.lit(True))
        changed = changed.join(marks, "id", "left").withColumn(
            HIDE_PATH, F.when(F.col("__gone"), applied_at).otherwise(F.col(HIDE_PATH))
        )
        lost = lost_deltas(changed.where(F.col("__gone")), len(changes))
        changed = changed.drop("__gone")
        deltas = deltas.unionByName(lost)
    snapshot = changed.unionByName(state.where(hidden))
    if appear and groups is not None:
        minted = settle(appearing(groups, appear, seed))
        snapshot = snapshot.unionByName(minted.select(*[c for c in snapshot.columns if c in minted.columns]), allowMissingColumns=True)
        deltas = deltas.unionByName(minted_deltas(minted, len(changes) + 1))
    logged = settle(logged_records(deltas, records, batch_id, kind))
    if disappear or appear:
        snapshot = settle(snapshot)
    options = options_text(intensity, types, codes, disappear, appear)
    fresh = state.sparkSession.range(1).select(
        F.lit(batch_id).alias("batch_id"), F.lit(kind).alias("drift_type"),
        F.lit(seed).cast("long").alias("seed"), F.lit(options).alias("options"), applied_at.alias("applied_at"),
        F.lit(None).cast("timestamp").alias("reverted_at"),
        visible_fingerprint(state).alias("parent_fingerprint"),
        visible_fingerprint(snapshot).alias("result_fingerprint"),
    )
    return Batch(snapshot, next_seq(batches, fresh, ["applied_at", "batch_id"]), logged)


class RevertError(ValueError):
    """The batch cannot be reverted."""


def check_revert(batches: DataFrame, records: DataFrame, batch_id) -> None:
    target = batches.where(F.col("batch_id") == batch_id).select("reverted_at").take(1)
    if not target:
        raise RevertError(f"there is no batch {batch_id}")
    if target[0][0] is not None:
        raise RevertError(f"batch {batch_id} was already reverted")
    # Records are only met where a newer batch could block.
    newer = 0 if newer_in_force(batches, batch_id).isEmpty() else blocking_batches(batches, records, batch_id).count()
    if newer:
        raise RevertError(f"{newer} newer batches changed the same rows; revert those first")


def restore(
    state: DataFrame, records: DataFrame, batch_id, marked: str | None = None, kept: dict[str, Column] | None = None,
) -> DataFrame:
    """The snapshot with the fields a batch changed put back in record order.

    Rows the batch added go, rows it hid come back. Only tags, sku, kind, properties and
    the hide mark are ever written. Each row meets all its records at once. With ``marked``
    only rows that the batch touched are returned, and that column tells those it added,
    which are then left as they are. ``kept`` are columns computed of the rows before.
    """
    mine = records.where(F.col("batch_id") == batch_id)
    met = (
        mine.groupBy(F.col("resource_id").alias("id"))
        # One batch changes a row at most once per code, so the list stays short.
        .agg(
            F.sort_array(F.collect_list(F.when(
                F.col("field_path") != APPEAR_PATH, F.struct("record_id", "field_path", "before", "after")))).alias("__steps"),
            F.coalesce(F.bool_or(F.col("field_path") == APPEAR_PATH), F.lit(False)).alias("__added"))
    )
    if marked:
        rows = state.join(met, "id").withColumnRenamed("__added", marked)
        touched = ~F.col(marked) & (F.size("__steps") > 0)
    else:
        rows = state.join(met, "id", "left").where(~F.coalesce("__added", F.lit(False))).drop("__added")
        touched = F.coalesce(F.size("__steps") > 0, F.lit(False))

    def of(prefix: str) -> Column:
        return F.filter("__steps", lambda s: s["field_path"].startswith(prefix))

    def folded(container: str) -> Column:
        return F.when(
            touched,
            F.aggregate(
                of(f"{container}."),
                F.coalesce(F.col(container), empty_map()),
                lambda m, s: revert_field(m, s["field_path"], s["before"], s["after"]),
            ),
        ).otherwise(F.col(container))

    # The last step of each is found once, for whether there is one and for what it holds.
    lasts = {p: f"__last_{p}" for p in ("sku", "kind", HIDE_PATH)}
    rows = rows.withColumns({name: F.when(touched, F.try_element_at(of(p), F.lit(-1))) for p, name in lasts.items()})
    had = lambda prefix: F.col(lasts[prefix]).isNotNull()
    first_before = lambda prefix: F.col(lasts[prefix])["before"]
    return rows.withColumns({
        **(kept or {}),
        "tags": folded("tags"),
        "properties": folded("properties"),
        "sku": F.when(had("sku"), F.from_json(first_before("sku"), TEXT_MAP)).otherwise(F.col("sku")),
        "kind": F.when(had("kind"), first_before("kind")).otherwise(F.col("kind")),
        HIDE_PATH: F.when(had(HIDE_PATH), F.lit(None).cast("timestamp")).otherwise(F.col(HIDE_PATH)),
    }).drop("__steps", *lasts.values())


def revert(
    state: DataFrame, batches: DataFrame, records: DataFrame, batch_id, reverted_at: Column
) -> tuple[DataFrame, DataFrame]:
    """Undo one batch: the restored snapshot and the batches with the revert marked."""
    check_revert(batches, records, batch_id)
    marked = batches.withColumn(
        "reverted_at",
        F.when(F.col("batch_id") == batch_id, reverted_at).otherwise(F.col("reverted_at")),
    )
    return restore(state, records, batch_id), marked


def batch_log(batches: DataFrame, records: DataFrame) -> DataFrame:
    """Batches in order with the number of their records."""
    counted = records.groupBy("batch_id").agg(F.count(F.lit(1)).alias("records"))
    return batches.join(counted, "batch_id", "left").na.fill(0, ["records"]).orderBy("seq")


def batch_detail(batches: DataFrame, records: DataFrame, batch_id, after: int | None = None, top: int | None = None) -> DataFrame:
    """One batch beside a page of its records in record order, with the cursor to go on from.

    A batch without records behind the cursor is one row, an unknown batch none.
    """
    mine = page(records.where(F.col("batch_id") == batch_id), "record_id", after, top)
    return batches.where(F.col("batch_id") == batch_id).join(mine, "batch_id", "left").orderBy("record_id")


def revert_states(batches: DataFrame, records: DataFrame) -> DataFrame:
    """(batch_id, seq, state) of every batch: ``reverted``, ``blocked`` by a newer one, or ``free``.

    A batch is blocked if a newer batch that is in force changed any of its rows. Each row
    is met once, with its batches and the newest one in force; batches are never paired
    with one another.
    """
    known = batches.select("batch_id", "seq", F.col("reverted_at").isNotNull().alias("__done"))
    touched = records.select("batch_id", "resource_id").where(F.col("resource_id").isNotNull()).join(known, "batch_id")
    per_row = touched.groupBy("resource_id").agg(
        F.max(F.when(~F.col("__done"), F.col("seq"))).alias("__newest"),
        F.collect_set(F.struct("batch_id", "seq")).alias("__by"))
    older = per_row.select(F.explode(F.filter("__by", lambda x: x["seq"] < F.col("__newest"))).alias("__b"))
    blocked = older.select("__b.batch_id").distinct()
    marked = known.join(blocked.withColumn("__blocked", F.lit(True)), "batch_id", "left")
    return marked.select(
        "batch_id", "seq",
        F.when(F.col("__done"), "reverted").when(F.col("__blocked"), "blocked").otherwise("free").alias("state"))


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, field, before, after): rows added and removed, and each changed field.

    One full join; fields are compared as columns and only differences are written out.
    """
    old = before.select(F.col(key).alias("key"), F.struct(*fields).alias("old"))
    new = after.select(F.col(key).alias("key"), F.struct(*fields).alias("new"))
    both = old.join(new, "key", "full")

    def entry(change: str, field: str | None, was: Column, now: Column) -> Column:
        return F.struct(
            F.lit(change).alias("change"), F.lit(field).cast("string").alias("field"),
            was.cast("string").alias("before"), now.cast("string").alias("after"),
        )

    nothing = F.lit(None)
    changed = F.filter(
        F.array(*[
            F.when(
                ~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")),
                entry("changed", f, F.col(f"old.{f}"), F.col(f"new.{f}")),
            )
            for f in fields
        ]),
        lambda e: e.isNotNull(),
    )
    entries = (
        F.when(F.col("old").isNull(), F.array(entry("added", None, nothing, nothing)))
        .when(F.col("new").isNull(), F.array(entry("removed", None, nothing, nothing)))
        .otherwise(changed)
    )
    return both.select(F.col("key").alias(key), F.inline(entries))
