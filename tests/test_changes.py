"""Change batches: guards, round trips, determinism."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from estatelens.bindings import changes as bound
from estatelens.catalogues import types as t
from estatelens.operators import drift, fingerprint


def now_value():
    return dt.datetime(2024, 1, 1)


def now():
    return F.lit(now_value())


def estate(spark, n=40):
    kinds = [t.STORAGE, t.NSG, t.KEY_VAULT, t.SQL_SERVER]
    rows = []
    for i in range(n):
        rules = '[{"name":"r","properties":{"priority":200}}]'
        rows.append((
            f"/subscriptions/s{i % 3}/resourceGroups/g{i % 2}/providers/{kinds[i % 4]}/r{i}", f"s{i % 3}", kinds[i % 4],
            {"environment": "prod", "k": "v"} if i % 2 else {}, {"tier": "Free", "name": "Free_1"} if i % 5 == 0 else None,
            None, {"securityRules": rules} if i % 8 == 1 else {}, None))
    schema = ("id string, subscription_id string, type string, tags map<string,string>, sku map<string,string>, kind string, "
              "properties map<string,string>, drift_deleted_at timestamp")
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return spark.createDataFrame([], bound.NO_BATCHES), spark.createDataFrame([], bound.NO_RECORDS)


def content(df):
    cols = [c for c in drift.STATE_COLUMNS if c in df.columns]
    return fingerprint.fingerprint(df, cols, marks={drift.HIDE_PATH}).first()


@pytest.mark.parametrize("kind", ["chaos", "temporal"])
@pytest.mark.parametrize("intensity", [1.0, 0.4, 3])
def test_revert_restores_the_estate(spark, kind, intensity):
    rows = estate(spark)
    done = drift.apply_changes(rows, *empty(spark), "b1", kind, now(), intensity=intensity, seed=5)
    assert content(done.snapshot) != content(rows)
    restored, batches = drift.revert(done.snapshot, done.batch, done.records, "b1", now())
    assert content(restored) == content(rows)
    assert batches.where("reverted_at IS NOT NULL").count() == 1


def test_rows_that_come_and_go_are_reverted(spark):
    rows = estate(spark)
    groups = spark.createDataFrame([("s0", "g0", "x"), ("s1", "g1", "x"), ("s2", "g0", "x")], "subscription_id string, name string, location string")
    kept = rows.limit(1).select("id")
    done = drift.apply_changes(rows, *empty(spark), "b1", "chaos", now(), references=[kept], disappear=5, groups=groups, appear=7, seed=2)
    assert done.snapshot.count() == 47
    assert done.snapshot.where("drift_deleted_at IS NOT NULL").count() == 5
    codes = {r.drift_code: r["count"] for r in done.records.groupBy("drift_code").count().collect()}
    assert codes[drift.APPEAR] == 7 and codes[drift.DISAPPEAR] == 5
    ids = [r.record_id for r in done.records.collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    restored, _ = drift.revert(done.snapshot, done.batch, done.records, "b1", now())
    assert content(restored) == content(rows)


def test_same_seed_same_batch_whatever_the_partitions(spark):
    rows = estate(spark)

    def run(parts, seed):
        _, deltas = drift.compute_deltas(rows.repartition(parts), "chaos", intensity=0.5, seed=seed)
        return sorted((r.resource_id, r.drift_code) for r in deltas.collect())

    assert run(1, 9) == run(7, 9) != run(7, 10)


def test_an_absolute_count_is_clamped_and_the_clamp_shows(spark):
    _, plan = drift.sample_changes(estate(spark), "chaos", 15, seed=1, codes=["DRIFT_KV_NO_SOFT_DELETE"])
    row = plan.first()
    assert (row.eligible, row.target, row.quota) == (10, 15, 10)


def test_an_appended_rule_goes_behind_the_last(spark):
    changed, deltas = drift.compute_deltas(estate(spark), "chaos", codes=["DRIFT_NSG_OPEN_INBOUND"])
    priorities = {r.id: r.p for r in changed.where(F.col("type") == t.NSG).select(
        "id", F.get_json_object(F.element_at("properties", "securityRules"), "$[*].properties.priority").alias("p")).collect()}
    assert "[200,210]" in priorities.values() and "110" in priorities.values()
    assert deltas.count() == 10


def test_revert_guards(spark):
    rows = estate(spark)
    first = drift.apply_changes(rows, *empty(spark), "b1", "chaos", now())
    second = drift.apply_changes(first.snapshot, first.batch, first.records, "b2", "temporal", now())
    batches = first.batch.unionByName(second.batch)
    records = first.records.unionByName(second.records)
    with pytest.raises(drift.RevertError, match="newer"):
        drift.check_revert(batches, records, "b1")
    with pytest.raises(drift.RevertError, match="no batch"):
        drift.check_revert(batches, records, "b9")
    state, batches = drift.revert(second.snapshot, batches, records, "b2", now())
    with pytest.raises(drift.RevertError, match="already"):
        drift.check_revert(batches, records, "b2")
    state, _ = drift.revert(state, batches, records, "b1", now())
    assert content(state) == content(rows)


def test_a_batch_is_read_with_its_records(spark):
    done = drift.apply_changes(estate(spark), *empty(spark), "b1", "chaos", now(), codes=["DRIFT_KV_NO_SOFT_DELETE"], seed=4)
    row = done.batch.first()
    assert json.loads(row.options) == {
        "intensity": 1.0, "resource_types": None, "codes": ["DRIFT_KV_NO_SOFT_DELETE"], "disappear": 0, "appear": 0}
    got = drift.batch_detail(done.batch, done.records, "b1", 3, 4).collect()
    assert [r.record_id for r in got] == [4, 5, 6, 7] and {r.next_after for r in got} == {7} and {r.seed for r in got} == {4}
    assert json.loads(got[0].metadata) == {"drift_code": "DRIFT_KV_NO_SOFT_DELETE", "drift_type": "chaos"}
    assert [r.record_id for r in drift.batch_detail(done.batch, done.records, "b1", 99).collect()] == [None]
    assert drift.batch_detail(done.batch, done.records, "b9").count() == 0


def test_revert_states(spark):
    batches = spark.createDataFrame(
        [("a", 1, None), ("b", 2, None), ("c", 3, now_value()), ("d", 4, None)], "batch_id string, seq int, reverted_at timestamp")
    records = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "z")], "batch_id string, resource_id string")
    got = {r.batch_id: r.state for r in drift.revert_states(batches, records).collect()}
    assert got == {"a": "blocked", "b": "free", "c": "reverted", "d": "free"}


def test_batches_chain(spark):
    rows = estate(spark)
    first = drift.apply_changes(rows, *empty(spark), "b1", "chaos", now())
    second = drift.apply_changes(first.snapshot, first.batch, first.records, "b2", "temporal", now())
    a, b = first.batch.first(), second.batch.first()
    assert a.result_fingerprint == b.parent_fingerprint and (a.seq, b.seq) == (1, 2)


def test_a_later_change_of_one_field_sees_the_earlier(spark):
    rows = estate(spark).where(F.col("type") == t.KEY_VAULT)
    twice = (
        drift.Change("A", "*", "k", "properties.x", lambda _: F.lit("1")),
        drift.Change("B", "*", "k", "properties.x", lambda before: F.concat(before, F.lit("2"))))
    changed, deltas = drift.compute_deltas(rows, "k", changes=twice)
    assert {r[0] for r in changed.select(F.element_at("properties", "x")).collect()} == {"12"}
    assert {(r.drift_code, r.before, r.after) for r in deltas.collect()} == {("A", None, "1"), ("B", "1", "12")}


def test_registries_refuse_duplicates(spark):
    from estatelens.catalogues.archetypes import ARCHETYPES, Archetype, check_catalogue
    from estatelens.operators import governance

    with pytest.raises(ValueError):
        drift.check_changes(drift.CHANGES + drift.CHANGES[:1])
    with pytest.raises(ValueError):
        governance.check_rules(governance.RULES[:1] * 2)
    with pytest.raises(ValueError):
        check_catalogue(ARCHETYPES + ARCHETYPES[:1])
    with pytest.raises(TypeError):
        Archetype(id="x", token="x", anchors=("a/b",))  # no default confirmation policy
    with pytest.raises(ValueError):
        Archetype(id="x", token="x", anchors=(), signals_confirm=False)


def test_tier_ladder(spark):
    df = spark.createDataFrame([(x,) for x in ("Free", "Basic", "Standard", "Premium", "Other")], "t string")
    assert [r[0] for r in df.select(drift.next_tier(F.col("t"))).collect()] == ["Basic", "Standard", "Premium", "Standard", "Premium"]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(500).select("id", (F.col("id") / 7).alias("c"))
    same = fingerprint.fingerprint(df.orderBy(F.desc("id")).repartition(5), ["id", "c"], cents={"c"}).first()
    assert same == fingerprint.fingerprint(df, ["id", "c"], cents={"c"}).first()
    moved = df.withColumn("c", F.when(F.col("id") == 3, F.col("c") + 0.01).otherwise(F.col("c")))
    assert same != fingerprint.fingerprint(moved, ["id", "c"], cents={"c"}).first()
    noise = df.withColumn("c", F.col("c") + 1e-11)
    assert same == fingerprint.fingerprint(noise, ["id", "c"], cents={"c"}).first()


def test_revert_states_meet_each_row_once(spark):
    at = now_value()
    batches = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("c", 3, at), ("d", 4, None)], "batch_id string, seq long, reverted_at timestamp")
    touched = [("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "z"), ("a", None), ("d", None), ("gone", "y")]
    states = drift.revert_states(batches, spark.createDataFrame(touched, "batch_id string, resource_id string"))
    assert {r.batch_id: r.state for r in states.collect()} == {"a": "blocked", "b": "free", "c": "reverted", "d": "free"}
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # records to their batches, batches to the blocked ones
