"""Steps whose cost must not grow faster than their rows."""

from estatelens.functions import text
from estatelens.operators import costs, integrity, shapes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dangling_edges_hash_the_ids_and_sort_no_edge(spark):
    edges = spark.createDataFrame(
        [("a", "b", 1), ("a", "b", 1), ("a", "x", 2), ("x", "b", 3), (None, "b", 4), ("a", None, 5)],
        "source_resource_id string, target_resource_id string, n int")
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    found = integrity.dangling(edges, nodes)
    plan = plan_of(found)
    assert plan.count("ShuffledHashJoin") == 2 and "Sort" not in plan and "Broadcast" not in plan
    assert sorted(r["n"] for r in found.collect()) == [2, 3, 4, 5]


def test_cost_samples_move_each_side_once(spark):
    bills = spark.createDataFrame(
        [("ID-1", "2024-01", 1.0), ("ID-1", "2024-01", 2.0), ("id-1", "2024-01", 4.0), ("Id-1", "2024-01", 8.0),
         ("iD-1", "2024-01", 16.0), ("ID-1", None, 32.0), ("7", "2024-01", 64.0), (None, "2024-01", 128.0), ("gone", "2024-01", 256.0),
         ("id-1", "2024-02", None)],
        "resource_id string, billing_month string, amount double")
    rows = spark.createDataFrame([("id-1", "a"), ("iD-1", "a"), ("ID-1", "b"), ("7", None), (None, "a")], "resource_id string, type string")
    found = costs.cost_samples(bills, rows, "amount")
    assert plan_of(found).count("Exchange hashpartitioning(") == 2
    amounts = [3.0, 4.0, 8.0, 16.0, 32.0]
    want = [("a", 2 * v) for v in amounts] + [("b", v) for v in amounts] + [("a", None), ("b", None), (None, 64.0)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_rows_are_counted_before_fields_are_taken_apart(spark):
    rows = spark.createDataFrame(
        [("microsoft.a/b", '{"state": "x", "id": "%d"}' % i, '{"tier": "t", "id": "%d"}' % i, "k") for i in range(6)]
        + [("microsoft.a/b", '{"state": null}', None, None), ("microsoft.a/b", "no json", "{}", None), ("microsoft.a/b", None, None, "k")],
        "type string, properties string, sku string, kind string")
    leading = spark.createDataFrame([("Microsoft.a/b", 1.0)], "type string, share double")
    found = shapes.type_shapes(rows, leading, 5, {"Microsoft.a/b": ("state",)}, ("tier",))
    plan = plan_of(found)
    assert plan.rindex("Generate") < plan.rindex("Exchange hashpartitioning(")  # the rows stand below both
    got = {(r["part"], r["field"], r["value"]): round(r["share"], 6) for r in found.collect()}
    assert got == {
        ("properties", "state", "x"): round(6 / 7, 6), ("properties", "state", "__other__"): round(1 / 7, 6),
        ("sku", "tier", "t"): 1.0, ("kind", "kind", "k"): 1.0}


def test_a_name_is_split_once(spark):
    df = spark.createDataFrame([("web-prod-01",), ("--",), ("",), (None,), ("a_" + "0" * 24,), ("0" * 10,)], "n string")
    classed = df.select("n", text.classify_name("n").alias("c"))
    assert classed.select("c")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r["c"] for r in classed.collect()] == [["word", "env", "int"], None, None, None, None, ["int"]]
