"""Rows keep their identity wherever a frame comes from, and whatever its columns are called."""

import pytest
from pyspark.sql import functions as F

from estatelens.llm import mixing, sharding, similar, simhash, warc
from estatelens.llm.common import _is_scan, with_row_id

WAYS = ("folders", "exploded", "union", "made", "filtered")


def frame(spark, way, path):
    """The same forty documents, thirty texts among them, by way of different frames."""
    rows = [(i, f"text number {i % 30} " + " ".join(f"w{i % 30}x{j}" for j in range(12)), "en", f"s{i % 4}", 1) for i in range(40)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns = made.columns
    if way == "made":
        return made
    if way == "exploded":  # each stored row becomes four
        made.groupBy((F.col("doc_id") % 10).alias("k")).agg(F.collect_list(F.struct(*columns)).alias("d")).write.parquet(path)
        return spark.read.parquet(path).select(F.explode("d").alias("d")).select("d.*")
    made.coalesce(1).write.partitionBy("source").parquet(path)
    read = spark.read.parquet(path).select(*columns)
    if way == "union":
        return read.where("doc_id < 20").unionByName(read.where("doc_id >= 20"))
    return read.where("n_chars = 1") if way == "filtered" else read


@pytest.mark.parametrize("way", WAYS)
def test_every_stage_counts_each_row_once(spark, tmp_path, way):
    docs = frame(spark, way, str(tmp_path / "docs"))
    assert _is_scan(docs) == (way in ("folders", "filtered"))
    assert with_row_id(docs).select("__file", "__row").distinct().count() == 40
    placed = sharding.sharded_documents(docs, 8).collect()
    assert sorted(r["doc_id"] for r in placed) == list(range(40))
    assert sorted((r["slot"], r["shard"]) for r in placed) == [(i // 8, i % 8) for i in range(40)]
    mixed = mixing.mixed_documents(docs)
    taken = {r["doc_id"]: r["copies"] for r in mixing.document_mix(docs).collect()}
    counts = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {k: n for k, n in taken.items() if n}
    for one in (similar.one_of_each(docs), simhash.one_of_each(docs, distance=0)):
        assert sorted(r["doc_id"] for r in one.collect()) == list(range(30)) and one.columns == docs.columns


def test_equal_pages_in_folders_have_one_response(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "same " * 300, i % 3) for i in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string, k int").coalesce(1).write.partitionBy("k").parquet(str(tmp_path / "p"))
    out = warc.archived(spark.read.parquet(str(tmp_path / "p"))).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in out) == [*((i, "revisit", 5) for i in range(5)), (5, "response", None)]


def test_the_smallest_page_id(spark):
    least = -(1 << 63)
    pages = spark.createDataFrame([(least, "a", "z" * 2000), (least + 1, "b", "z" * 2000), (least, "c", "y" * 2000)], "page_id long, url string, html string")
    out = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archived(pages).collect())
    assert out == [(least, "response", None), (least, "revisit", least + 1), (least + 1, "response", None)]


def test_given_columns_may_have_any_name(spark, tmp_path):
    names = ["__file", "__row", "row", "_metadata", "copies", "_place", "_part", "_at", "_size", "id", "node", "a.b"]
    docs = frame(spark, "made", "").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    stored = str(tmp_path / "d")
    docs.write.parquet(stored)
    for given in (docs, spark.read.parquet(stored)):
        assert sharding.sharded_documents(given).columns == [*docs.columns, "shard", "slot"]
        for out in (mixing.mixed_documents(given), similar.one_of_each(given), simhash.one_of_each(given)):
            assert out.columns == docs.columns and out.select("`a.b`").first()[0] == 11 and out.count() > 0
    with pytest.raises(ValueError, match="rename the columns"):
        mixing.mixed(docs.withColumn("members", F.array("source")).withColumn("n", F.lit(1).cast("long")), "members", "n", ["doc_id"], lambda sizes: {})
