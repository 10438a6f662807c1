"""Stores that merge on read, against snapshots written whole."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from estatelens.operators import drift, fingerprint
from estatelens.plans import batches
from estatelens.session import list_folders
from estatelens.sources import overlay
from tests.test_changes import estate, now

GROUPS = [("s0", "g0", "x"), ("s1", "g1", "x"), ("s2", "g0", "x")]


def pairs(df):
    return sorted((r["id"], r["v"]) for r in df.select("id", "v").collect())


def test_the_newest_change_of_a_key_wins(spark, tmp_path):
    rng, held = random.Random(3), {i: 0 for i in range(60)}
    path = str(tmp_path / "s")
    at = overlay.create(path, {"t": (spark.createDataFrame(list(held.items()), "id long, v long"), "id")})
    for turn in range(1, 7):
        some = rng.sample(range(80), 12)
        gone = {i for i in some if rng.random() < 0.3}
        rows = spark.createDataFrame([(i, turn, i in gone) for i in some], "id long, v long, __gone boolean")
        folder, _ = overlay.stage(at, "t", rows)
        at = overlay.commit(spark, at, {"t": folder})
        held = {i: v for i, v in {**held, **{i: turn for i in some}}.items() if i not in gone}
        assert pairs(overlay.read(spark, at, "t")) == sorted(held.items())
        if turn == 4:
            at = overlay.compact(spark, at, "t")
            assert not at.tables["t"].changes and pairs(overlay.read(spark, at, "t")) == sorted(held.items())
    first = overlay.version(spark, path, 0)
    assert pairs(overlay.read(spark, first, "t")) == [(i, 0) for i in range(60)]
    overlay.drop_unused(spark, path)
    assert pairs(overlay.read(spark, overlay.version(spark, path), "t")) == sorted(held.items())
    assert len(list_folders(spark, f"{path}/t")) == 2 and len(list_folders(spark, f"{path}/t/changes")) == 2
    with pytest.raises(ValueError):
        overlay.version(spark, path, 0)


def test_unfinished_writes_do_not_count(spark, tmp_path):
    path = str(tmp_path / "s")
    at = overlay.create(path, {"t": (spark.createDataFrame([(1, 1)], "id long, v long"), "id")})
    change = spark.createDataFrame([(1, 2)], "id long, v long")
    overlay.stage(at, "t", change)  # a writer that was lost before it committed
    lost = tmp_path / "s" / "versions" / "00000001-lost"
    lost.mkdir()
    (lost / "part-0.txt").write_text("{")  # and one lost while it did
    assert overlay.version(spark, path).number == 0
    assert pairs(overlay.read(spark, overlay.version(spark, path), "t")) == [(1, 1)]
    folder, _ = overlay.stage(at, "t", change)
    done = overlay.commit(spark, at, {"t": folder})
    assert pairs(overlay.read(spark, overlay.version(spark, path), "t")) == [(1, 2)] and done.number == 1
    with pytest.raises(ValueError, match="was written since"):
        overlay.commit(spark, at, {"t": folder})


def test_bad_tables_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="reserved"):
        overlay.create(str(tmp_path / "a"), {"t": (spark.createDataFrame([(1, True)], "id long, __gone boolean"), "id")})
    with pytest.raises(ValueError, match="null"):
        overlay.create(str(tmp_path / "b"), {"t": (spark.createDataFrame([(None, 1)], "id long, v long"), "id")})
    at = overlay.create(str(tmp_path / "c"), {"t": (spark.createDataFrame([], "id long, v long"), "id")})
    with pytest.raises(ValueError, match="null"):
        overlay.stage(at, "t", spark.createDataFrame([(None, 1)], "id long, v long"))
    folder, _ = overlay.stage(at, "t", spark.createDataFrame([], "id long, v long"))
    assert overlay.read(spark, overlay.commit(spark, at, {"t": folder}), "t").count() == 0


def seen_fingerprint(df):
    seen = df.where(F.col(drift.HIDE_PATH).isNull())
    return fingerprint.fingerprint(seen, drift.STATE_COLUMNS, marks={drift.HIDE_PATH}).first()["fingerprint"]


def test_a_batch_equals_the_one_on_whole_snapshots(spark, tmp_path):
    rows, path = estate(spark), str(tmp_path / "s")
    batches.open_store(rows, path)
    groups = spark.createDataFrame(GROUPS, "subscription_id string, name string, location string")
    more = {"intensity": 0.5, "seed": 8, "disappear": 3, "groups": groups, "appear": 4}
    empty = (spark.createDataFrame([], batches.BATCHES), spark.createDataFrame([], batches.RECORDS))
    want = drift.apply_changes(rows, *empty, "b1", "chaos", now(), **more)
    at = batches.apply_batch(spark, path, "b1", "chaos", now(), **more)
    text = lambda df: sorted(str(r) for r in df.select(*sorted(df.columns)).collect())
    assert text(overlay.read(spark, at, "resources").withColumn("tags", F.to_json("tags"))) == text(want.snapshot.withColumn("tags", F.to_json("tags")))
    assert text(overlay.read(spark, at, "records")) == text(want.records)
    assert text(overlay.read(spark, at, "batches")) == text(want.batch)
    changed = want.records.select("resource_id").distinct().count()
    assert batches.written_rows(spark, at) == changed < rows.count()
    again = batches.apply_batch(spark, path, "b1", "chaos", now(), **more)
    assert again.number == at.number
    with pytest.raises(ValueError, match="other options"):
        batches.apply_batch(spark, path, "b1", "chaos", now(), seed=9)


def test_kept_fingerprints_over_random_batches(spark, tmp_path):
    rng, path = random.Random(11), str(tmp_path / "s")
    at = batches.open_store(estate(spark, 30), path)
    assert batches.kept_fingerprint(at) == seen_fingerprint(estate(spark, 30))
    groups = spark.createDataFrame(GROUPS, "subscription_id string, name string, location string")
    states, open_batches = {}, []
    for turn in range(20):
        before = batches.kept_fingerprint(at)
        if open_batches and rng.random() < 0.3:
            name = open_batches.pop()
            at = batches.revert_batch(spark, path, name, now())
            assert batches.kept_fingerprint(at) == states[name]
        else:
            name = f"b{turn}"
            states[name] = before
            at = batches.apply_batch(
                spark, path, name, rng.choice(["chaos", "temporal"]), F.lit(dt.datetime(2024, 1, 1 + turn)), intensity=rng.choice([1.0, 0.3, 2]),
                seed=turn, disappear=rng.choice([0, 2]), groups=groups, appear=rng.choice([0, 3]))
            open_batches.append(name)
        if turn % 4 == 3:
            at = overlay.compact(spark, at, "resources")
        assert batches.kept_fingerprint(at) == seen_fingerprint(overlay.read(spark, at, "resources")), turn
    with pytest.raises(drift.RevertError):
        batches.revert_batch(spark, path, "b99", now())


def test_reading_a_few_columns_moves_no_others(spark, tmp_path):
    at = overlay.create(str(tmp_path / "s"), {"t": (spark.createDataFrame([(0, 0, "w0", None)], "id long, v long, wide string, m map<string,string>"), "id")})
    for turn in (1, 2):
        rows = spark.createDataFrame([(i, turn, f"w{turn}", None if i else {"a": str(turn)}) for i in range(turn)], "id long, v long, wide string, m map<string,string>")
        at = overlay.commit(spark, at, {"t": overlay.stage(at, "t", rows)[0]})
    held = overlay.read(spark, at, "t")
    assert not re.search(r"max_by\([^)]*wide", held.select("id")._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(map(tuple, held.collect())) == [(0, 2, "w2", {"a": "2"}), (1, 2, "w2", None)]


def test_records_are_appended_and_whole_rows_are_sorted_once(spark, tmp_path):
    path = str(tmp_path / "s")
    batches.open_store(estate(spark, 12), path)
    batches.apply_batch(spark, path, "b1", "chaos", now())
    at = batches.apply_batch(spark, path, "b2", "temporal", now())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    held = overlay.read(spark, at, "records")
    assert not re.search("Join|Aggregate|Window", plan(held))
    assert "Aggregate" not in plan(overlay.read(spark, at, "resources"))
    rows = sorted(held.select("record_id", "batch_id").collect())
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and {r[1] for r in rows} == {"b1", "b2"}
    overlay.drop_unused(spark, path)
    at = overlay.compact(spark, overlay.version(spark, path), "records")
    assert not at.tables["records"].appended and sorted(overlay.read(spark, at, "records").select("record_id", "batch_id").collect()) == rows


def test_a_marked_restore_returns_touched_rows_alone(spark):
    rows = spark.createDataFrame(
        [(i, {"environment": "x"} if i else None, {}, None, {}, None) for i in ("a", "b", "c", "d")],
        "id string, tags map<string,string>, sku map<string,string>, kind string, properties map<string,string>, drift_deleted_at timestamp")
    records = spark.createDataFrame(
        [("a", "tags.environment", "old", "x", 1, "b1"), ("b", drift.APPEAR_PATH, None, "appear", 2, "b1"), ("c", "tags.environment", "old", "x", 3, "b2"),
         ("d", None, None, None, 4, "b1")],
        "resource_id string, field_path string, before string, after string, record_id long, batch_id string")
    got = drift.restore(rows, records, "b1", marked="__gone", kept={"__was": F.element_at("tags", "environment")})
    assert sorted((r["id"], r["tags"]["environment"], r["__was"], r["__gone"]) for r in got.collect()) == [
        ("a", "old", "x", False), ("b", "x", "x", True), ("d", "x", "x", False)]
    whole = drift.restore(rows, records, "b1")
    assert sorted((r["id"], r["tags"]["environment"]) for r in whole.collect()) == [("a", "old"), ("c", "x"), ("d", "x")]
