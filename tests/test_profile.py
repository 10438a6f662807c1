"""Profiles of a scan with planted facts, and profiles on disk."""

import json

import pytest
from pyspark.sql import functions as F

from estatelens.plans import profile as plan
from estatelens.operators import clusters, costs, histogram, lattice, names, pairs, tags, templates, topology
from estatelens.sources import profiles, scan as scan_io

VM = "microsoft.compute/virtualmachines"
FIELDS = {"Microsoft.compute/virtualmachines": ("vmSize",)}


def planted(spark):
    """Four big and four small owners; a rare type, location, composition and tag value."""
    rows = []

    def add(owner, group, type_name, location="eastus2", tags=None, properties=None, kind=None):
        n = len(rows)
        rows.append((
            "s", f"/subscriptions/sub-{owner}/resourceGroups/{group}/providers/{type_name}/r{n}", f"app-prod-{n:03d}", type_name, location,
            group, f"sub-{owner}", json.dumps(properties) if properties else None, None, json.dumps(tags) if tags else None, kind))

    for owner in range(8):
        big = owner < 4
        for g in range(4 if big else 2):
            for _ in range(3):
                add(f"{owner:04d}", f"rg-{owner}-{g}", VM, "eastus2" if big else "westeurope",
                    {"Environment": "prod" if big else "dev"}, {"vmSize": "S" if owner % 2 else "L", "secret": "x"})
            add(f"{owner:04d}", f"rg-{owner}-{g}", "microsoft.network/networkinterfaces", "eastus2" if big else "westeurope", None,
                None if big else {"ref": "/subscriptions/sub-0000/resourceGroups/rg-0-0/x"})
    for _ in range(4):
        add("0000", "rg-0-0", "microsoft.test/raretype", "antarcticasouth", {"Owner": "Someone"})
    scan = {
        "resources": spark.createDataFrame(rows, scan_io.SCHEMAS["resources"]),
        "subscriptions": spark.createDataFrame([("s", f"sub-{o:04d}", f"Sub {o}", "Enabled", None) for o in range(8)], scan_io.SCHEMAS["subscriptions"]),
        "resource_groups": spark.createDataFrame(
            [("s", f"id{o}{g}", f"RG-{o}-{g}", "x", f"sub-{o:04d}", None) for o in range(8) for g in range(5)], scan_io.SCHEMAS["resource_groups"]),
        "findings": spark.createDataFrame(
            [("s", "r", f, "c", "High") for f in ["unattached_nics"] * 8 + ["stopped_vms"] * 6 + ["unattached_disks"] * 2 + ["mystery"] * 5],
            scan_io.SCHEMAS["findings"]),
        "resource_costs": spark.createDataFrame([], scan_io.SCHEMAS["resource_costs"]),
    }
    return scan, len(rows)


@pytest.fixture(scope="module")
def built(spark):
    scan, n = planted(spark)
    frame = plan.build_profile(scan, 5, allow_no_terms=True, k=3, locations=["eastus2", "westeurope", "antarcticasouth"], property_fields=FIELDS)
    rows = {}
    for r in frame.collect():
        rows.setdefault(r.section, {})[tuple(k for k in (r.key1, r.key2, r.key3) if k is not None)] = r.value
    return frame, rows, n


def test_planted_facts(built):
    _, p, n = built
    assert ("Microsoft.test/raretype",) not in p["resource_types"] and len(p["resource_types"]) == 2
    assert p["location_distribution"][("__other__",)] == pytest.approx(4 / n)
    assert p["tag_value_distributions"][("Environment", "prod")] == pytest.approx(48 / 72)
    assert not any("Someone" in key for section in p.values() for key in section)
    assert not any("secret" in key for section in p.values() for key in section)
    assert p["violation_rates"] == {("VM_NO_BACKUP",): pytest.approx(14 / n)}
    assert p["coverage"][("cost_distributions", "no_source")] == 1.0
    assert p["coverage"][("api_version", "no_source")] == 1.0
    assert p["topology"][("private_endpoints", "per_spoke_mean")] == pytest.approx(2.0)
    assert p["topology"][("hub_spoke", "hub_count_mean")] == 1.0


def test_templates_and_true_empties(built):
    _, p, _ = built
    t = p["templates"]
    # 24 used groups; 23 share one composition, one is rare; 40 are declared.
    assert t[("template-0", "weight")] == pytest.approx(23 / 40)
    assert t[("template-0", "mean")] == pytest.approx(4.0) and t[("template-0", "std")] == 0.0
    assert t[("__misc__", "weight")] == pytest.approx(17 / 40)
    assert t[("__misc__", "empty_share")] == pytest.approx(16 / 17)
    assert t[("__misc__", "mean")] == pytest.approx(8.0)


def test_archetypes_add_up(built):
    _, p, _ = built
    weights = [v for k, v in p["archetypes"].items() if k[1] == "weight"]
    assert len(weights) == 3 and sum(weights) == pytest.approx(1.0)
    for arch in {k[0] for k in p["archetypes"]}:
        assert sum(v for k, v in p["archetype_locations"].items() if k[0] == arch) == pytest.approx(1.0)


def test_wholes_add_up(built):
    frame, _, _ = built
    for section, keys in plan.WHOLES.items():
        sums = frame.where(F.col("section") == section).groupBy(*keys).agg(F.sum("value").alias("s"))
        assert sums.where(F.abs(F.col("s") - 1) > 1e-9).isEmpty(), section


def test_more_clusters_than_owners(spark):
    scan, _ = planted(spark)
    features = tags.owner_features(scan["resources"])
    clustered = clusters.cluster_owners(features, "subscription_id", ["resource_count", "rg_count"], 50)
    assert clustered.count() == 8


def test_clusters_do_not_depend_on_partitions(spark):
    columns = ["x", "y"]
    # Irregular points, so that no two groupings cost the same.
    owners = spark.range(400).select(
        F.col("id").cast("string").alias("o"), ((F.col("id") % 4) * 10 + F.pmod(F.xxhash64(F.col("id") + 7), F.lit(997)) / 499).alias("x"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 37).alias("y"))

    def run(parts):
        return {r.o: r.cluster for r in clusters.cluster_owners(owners.repartition(parts), "o", columns, 4).collect()}

    assert run(1) == run(9)


def test_a_profile_without_terms_is_refused(spark):
    scan, _ = planted(spark)
    with pytest.raises(plan.TermListRequired):
        plan.build_profile(scan)


def test_leaking_profile_is_refused(spark, built):
    frame, _, _ = built
    clean = spark.createDataFrame([("sub-0000",), ("rg-0-0",)], "term string")
    plan.refuse_leaking_profile(frame, clean)
    with pytest.raises(ValueError):
        plan.refuse_leaking_profile(frame, spark.createDataFrame([("westeurope",)], "term string"))


def test_long_form_round_trip(spark, built, tmp_path):
    frame, _, _ = built
    profiles.write_profile(frame, str(tmp_path / "p"))
    back = profiles.read_profile(spark, str(tmp_path / "p"))
    assert back.exceptAll(frame.select(*back.columns)).isEmpty() and back.count() == frame.count()


def test_broken_profiles_are_refused(spark, built):
    frame, _, _ = built
    for section, value in (("resource_types", 1.2), ("nonsense", 0.5), ("templates", -1.0), ("naming_patterns", float("nan"))):
        bad = frame.unionByName(spark.createDataFrame([(section, "k", None, None, value)], profiles.LONG))
        with pytest.raises(plan.ProfileError):
            plan.check_profile(bad)


@pytest.mark.parametrize("lines", [False, True])
def test_document_round_trip(spark, built, tmp_path, lines):
    frame, _, _ = built
    if lines:
        profiles.document_lines(frame).write.text(str(tmp_path / "d"))
    else:
        profiles.profile_document(frame).coalesce(1).write.json(str(tmp_path / "d"))
    back = profiles.read_document(spark, str(tmp_path / "d"), lines)
    same = frame.where(~F.col("section").isin("coverage", "location_distribution", "topology"))
    assert back.exceptAll(same).isEmpty()
    assert same.exceptAll(back).isEmpty()


def test_exported_pages(spark, tmp_path):
    page = {
        "data": [
            {"id": "/a", "name": "n", "type": "t", "location": "l", "resourceGroup": "g", "subscriptionId": "s",
             "tags": {"Environment": "prod", "AcmeKey": "v"}, "properties": {"a": {"b": 1}}, "sku": {}, "kind": None},
            {"id": "/b", "name": "m", "type": "t", "location": "l", "resourceGroup": "g", "subscriptionId": "s",
             "tags": {"AcmeKey": "v"}, "properties": {}, "sku": {"name": "x"}, "kind": "k"}],
        "skipToken": "x", "resultTruncated": "false", "totalRecords": 2, "count": 2}
    (tmp_path / "page1.json").write_text(json.dumps(page, indent=1))
    rows = {r.resource_id: r for r in scan_io.normalize_rows(scan_io.read_exported(spark, str(tmp_path))).collect()}
    assert json.loads(rows["/a"].tags) == {"Environment": "prod"} and rows["/b"].tags is None
    assert json.loads(rows["/a"].properties) == {"a": {"b": 1}} and rows["/b"].properties is None
    assert rows["/a"].sku is None and json.loads(rows["/b"].sku) == {"name": "x"}


def test_missing_optional_tables_are_empty(spark, tmp_path):
    scan, _ = planted(spark)
    for name in scan_io.REQUIRED:
        scan[name].write.parquet(str(tmp_path / f"{name}.parquet"))
    loaded = scan_io.load_scan(spark, str(tmp_path))
    assert loaded["findings"].columns == scan["findings"].columns and loaded["findings"].isEmpty()
    with pytest.raises(Exception):
        scan_io.load_scan(spark, str(tmp_path / "nowhere"))


def test_cost_query_guards(spark):
    import datetime as dt

    bills = spark.range(12).select(
        F.col("id").alias("resource_id"), F.lit(dt.date(2024, 1, 1)).alias("billing_period"), F.lit(2.0).alias("cost_amount"),
        F.lit("s").alias("subscription_id"))
    rows = spark.range(12).select(F.col("id").alias("resource_id"), F.lit("t/x").alias("type"), F.lit("g").alias("resource_group"),
                                  F.lit('{"k":"a long value"}').alias("tags"))
    today = dt.date(2024, 1, 9)
    by_id = [("Dimension", "ResourceId")]
    assert costs.cost_query(bills, rows, "MonthToDate", today, by_id, max_rows=12).count() == 12
    with pytest.raises(Exception, match="more than 11 rows"):
        costs.cost_query(bills, rows, "MonthToDate", today, by_id, max_rows=11).collect()
    with pytest.raises(Exception, match="too long"):
        costs.cost_query(bills, rows, "MonthToDate", today, [("Tag", "k")], max_key_bytes=5).collect()
    with pytest.raises(ValueError):
        costs.cost_query(bills, rows, "MonthToDate", today, [("Dimension", "Colour")])
    with pytest.raises(ValueError):
        costs.cost_query(bills, rows, "MonthToDate", today, by_id * 3)
    assert costs.cost_query(bills, rows, "TheLastMonth", today).first().total == 0.0


def test_the_lattice_counts_like_the_rows(spark):
    scan, n = planted(spark)
    rows = scan["resources"].unionByName(scan["resources"].limit(7).withColumn("tags", F.lit(None).cast("string")).withColumn("name", F.lit(None).cast("string")))
    base = lattice.row_lattice(rows)
    assert base.agg(F.sum("n")).first()[0] == n + 7 and base.count() < n

    def same(a, b):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))

    same(histogram.value_counts(rows, "type", "location"), lattice.rolled_up(base, "type", "location"))
    same(tags.tag_value_counts(rows), tags.tag_value_counts(base, weight="n"))
    same(tags.tag_coverage(rows), tags.tag_coverage(base, weight="n"))
    same(tags.owner_features(rows), tags.owner_features(base, weight="n"))
    same(templates.group_type_sets(rows, scan["resource_groups"]), templates.group_type_sets(base, scan["resource_groups"], weight="n"))
    same(histogram.pivot_counts(rows, "subscription_id", "location", ["eastus2"]), histogram.pivot_counts(base, "subscription_id", "location", ["eastus2"], weight="n"))
    crossed = lattice.rolled_up(base, "subscription_id", "target").withColumnRenamed("subscription_id", "source")
    same(topology.cross_refs(rows), topology.crossings(crossed))
    for a, b in zip(names.name_patterns(rows, "name", 5), names.sequence_shares(lattice.rolled_up(base, "classes"), 5)):
        same(a, b)
    empty = lattice.row_lattice(rows.limit(0))
    assert empty.count() == 0 and topology.crossings(lattice.rolled_up(empty, "subscription_id", "target").withColumnRenamed("subscription_id", "source")).first()["total_resources"] == 0


def test_a_profile_reads_the_rows_three_times(spark, tmp_path, monkeypatch):
    scan, _ = planted(spark)
    scan["resources"].write.parquet(str(tmp_path / "resources"))
    scan["resources"] = spark.read.parquet(str(tmp_path / "resources"))
    read = []
    for module in {plan, lattice, tags, templates, pairs}:
        if hasattr(module, "settle"):
            def counted(df, settle=module.settle):
                leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
                found = [leaves.apply(i) for i in range(leaves.size())]
                scans = [x.output().toString() for x in found if x.nodeName() == "LogicalRelation"]
                read.extend(x for x in scans if "properties" in x or "resource_id" in x)
                return settle(df)
            monkeypatch.setattr(module, "settle", counted)
    plan.build_profile(scan, 5, allow_no_terms=True, property_fields=FIELDS).count()
    assert len(read) <= 3


def test_key_pairs_under_a_floor(spark):
    objects = [{f"k{i}": 1 for i in range(300)}] + [{"a": 1, "b": 2, f"rare{i}": 3} for i in range(6)] + [{"a": 1}, {}, {"b": 1, "a": 2}]
    df = spark.createDataFrame([(json.dumps(o),) for o in objects] + [(None,)], "tags string")
    pruned = pairs.key_pair_counts(df, "tags", 5)
    assert sorted(map(tuple, pruned.select("a", "b", "n").collect())) == [("a", "b", 7)]
    assert sorted(map(tuple, pairs.key_pair_counts(df, "tags").where("n >= 5").select("a", "b", "n").collect())) == [("a", "b", 7)]
    wide = spark.createDataFrame([(json.dumps({f"k{i}": 1 for i in range(10_000)}),)] * 3, "tags string")
    assert pairs.key_pair_counts(wide, "tags", 5).count() == 0  # fifty million pairs are never written


def test_owner_costs_have_no_row_limit(spark, tmp_path):
    from estatelens.bindings import serving

    owners = 1200
    spark.range(owners).select(
        F.col("id").alias("l_partkey"), F.lit("1998-07-03").cast("date").alias("l_shipdate"), F.lit(2.5).alias("l_extendedprice"),
        F.col("id").alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(owners).select(
        F.col("id").alias("p_partkey"), F.lit("SMALL").alias("p_type"), F.lit("b").alias("p_brand"), F.lit(1).alias("p_size"),
        F.lit("n").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    found = {(r["SubscriptionId"], r["total"]) for r in serving.cost_by_owner_month_to_date(spark, str(tmp_path)).collect()}
    assert found == {(str(i), 2.5) for i in range(owners)}
