"""Paged tables and the trigram index against plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from estatelens.operators import paging, predicates, trigrams
from estatelens.sources import paged


def files_read(df):
    return {f.split("__range=")[1].split("/")[0] for f in df.inputFiles()}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(2)
    keys = [f"k{rng.randrange(10 ** 6):06d}" for _ in range(3000)] + ["k500000"] * 400 + [None, None]
    df = spark.createDataFrame([(k, i, f"r{i}") for i, k in enumerate(keys)], "id string, n int, first string")
    path = str(tmp_path_factory.mktemp("paged") / "t")
    paged.write_paged(df, path, "id", rows_a_range=200)
    return df, path


def test_pages_equal_those_of_the_whole_table(spark, table):
    df, path = table
    for after in (None, "", "k000000", "k123456", "k499999", "k500000", "k999990", "z"):
        for top in (1, 50, 300):
            want = paging.page(df, "id", after, top)
            got = paged.paged(spark, path, "id", after, top)
            assert sorted(map(str, got.select("id", "next_after").collect())) == sorted(map(str, want.select("id", "next_after").collect())), (after, top)
        behind = df if after is None else df.where(F.col("id") > after)
        assert paged.rows_behind(spark, path, "id", after) == behind.count()


def test_a_page_opens_few_ranges(spark, table):
    _, path = table
    assert paged.range_index(spark, path).count() >= 10
    for after in ("k100000", "k300123", "k900000"):
        numbers = paged.page_ranges(spark, path, after, 50)
        assert len(numbers) <= 2
        plan = paged.in_ranges(spark, path, numbers)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [__range" in plan or "PartitionFilters: [isnotnull(__range" in plan


def test_first_matches_stop_early(spark, table):
    df, path = table
    for condition, limit in ((F.col("n") % 7 == 3, 20), (F.col("n") == 2999, 5), (F.lit(False), 3)):
        want = df.where(condition).orderBy("id").limit(limit)
        got = paged.first_matching(spark, path, "id", condition, limit)
        assert [r["id"] for r in got.collect()] == [r["id"] for r in want.collect()]


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "id string, name string")
    paged.write_paged(df, str(tmp_path / "p"), "id")
    assert paged.paged(spark, str(tmp_path / "p"), "id", "a", 5).count() == 0
    assert paged.rows_behind(spark, str(tmp_path / "p"), "id") == 0
    assert paged.first_matching(spark, str(tmp_path / "p"), "id", F.lit(True), 5).count() == 0
    trigrams.write_index(df, str(tmp_path / "s"), ["name"], "id")
    assert trigrams.search(spark, str(tmp_path / "s"), "abc", ["name"]).count() == 0


NAMES = ["VM-Prod_01", "vm%prod", "vmXprod", "Straße-É", "strasse", "ab", "", None, "日本語テスト", "aaaa", "AAAaaa", "x_y%z", "İstanbul"]


def test_search_equals_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "ROWS_A_RANGE", 100)
    monkeypatch.setattr(trigrams, "BLOCK", 16)
    rng = random.Random(4)
    letters = "abcé%_-*1日"
    rows = [(i, NAMES[i] if i < len(NAMES) else "".join(rng.choice(letters) for _ in range(rng.randrange(9))), rng.choice(["Alpha", "beta%", None, "Ünder_score"])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, name string, type string")
    path = str(tmp_path / "index")
    trigrams.write_index(df, path, ["name", "type"], "id")
    terms = ["prod", "VM", "m%p", "m_p", "straß", "É", "日本語", "本語テ", "aaa", "aaaaa", "_sco", "BETA%", "zzz", "%", "a*b", "_-", "İst", "lpha"]
    terms += ["".join(rng.choice("abcé%_-1日") for _ in range(rng.randint(1, 5))) for _ in range(12)]
    for term in terms:
        wanted = predicates.normalise_term(term)
        want = df.where(predicates.holds_term("name", wanted) | F.coalesce(predicates.holds_term("type", wanted), F.lit(False)))
        got = trigrams.search(spark, path, term, ["name", "type"])
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()), term


def test_a_rare_term_opens_few_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "ROWS_A_RANGE", 50)
    df = spark.range(1000).select("id", F.concat(F.lit("common-"), F.when(F.col("id") == 777, "needle").otherwise("straw")).alias("name"))
    path = str(tmp_path / "index")
    trigrams.write_index(df, path, ["name"], "id")
    numbers = trigrams.candidates(spark, path, "on-needle")
    assert numbers.count() == 1
    assert [r["id"] for r in trigrams.search(spark, path, "on-needle", ["name"]).collect()] == [777]
    assert numbers.select(trigrams.range_of(F.col("__row"))).distinct().count() == 1
