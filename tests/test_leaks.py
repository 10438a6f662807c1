"""The leak scan against a plain reference matcher."""

import random

import pytest
from pyspark.sql import functions as F

from estatelens.bindings import whole
from estatelens.operators import bloom, leaks


def ident(c):
    return c.isalnum() or c == "_"


def stands_in(text, term):
    at = text.find(term)
    while at != -1:
        before = text[at - 1] if at else ""
        after = text[at + len(term)] if at + len(term) < len(text) else ""
        if not (before and ident(before)) and not (after and ident(after)):
            return True
        at = text.find(term, at + 1)
    return False


def run(spark, texts, terms):
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    w = spark.createDataFrame([(x,) for x in terms], "term string")
    return {(r.key, r.term) for r in leaks.leak_pairs(t, w, "id", "text").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_strings_agree_with_plain_matching(spark, seed):
    rng = random.Random(seed)
    alphabet = "ab_/-. 1"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(2000)]
    terms = {"".join(rng.choice(alphabet) for _ in range(1 + rng.randrange(6))) for _ in range(150)}
    want = {(i, w) for i, s in enumerate(texts) for w in terms if w.strip() and stands_in(s, w)}
    assert run(spark, texts, terms) == want


def test_terms_with_pattern_characters_and_other_scripts(spark):
    texts = ["see a.b*c now", "axb*c", "größe=1", "größer", "x\\Ey", "(a)", "日本 語", "A.B*C"]
    terms = ["a.b*c", "größe", "x\\Ey", "(a)", "日本", "\\E"]
    want = {(i, w) for i, s in enumerate(texts) for w in terms if stands_in(s, w)}
    assert run(spark, texts, terms) == want


def test_a_leak_is_reported_by_length_only(spark):
    t = spark.createDataFrame([(1, "the secret-name is out")], "id int, text string")
    w = spark.createDataFrame([("secret-name",)], "term string")
    with pytest.raises(leaks.LeakError) as raised:
        leaks.refuse_leaks(t, w, "id", "text")
    assert "secret" not in str(raised.value) and "11" in str(raised.value)
    leaks.refuse_leaks(t, w.where("false"), "id", "text")


def test_a_hot_token_gives_every_hit(spark):
    texts = [f"the cat {i}" for i in range(500)] + ["another"]
    assert len(run(spark, texts, ["the", "the cat", "cat 7", "missing one"])) == 1001


def test_hits_do_not_depend_on_the_planner_s_joins(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab_/-. 1") for _ in range(rng.randrange(25))) for _ in range(800)]
    terms = {"".join(rng.choice("ab_/-. 1") for _ in range(1 + rng.randrange(6))) for _ in range(80)}
    want = {(i, w) for i, s in enumerate(texts) for w in terms if w.strip() and stands_in(s, w)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in ("-1", "100m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            assert run(spark, texts, terms) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_leaks_of_every_profile_section(spark, folder):
    profile = whole.written_profile(spark, folder)
    strings = {(r["section"], r[k]) for r in profile.collect() for k in ("key1", "key2", "key3") if r[k] is not None}
    terms = {r[0] for t, c in (("nation", "n_name"), ("customer", "c_name")) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(c).collect() if r[0] and r[0].strip()}
    found = {(s, t) for s, x in strings for t in terms if stands_in(x, t)}
    want = {s: (len(own), max(map(len, own))) for s in {s for s, _ in found} if (own := [t for x, t in found if x == s])}
    got = {r["section"]: (r["leaks"], r["longest"]) for r in whole.profile_leaks_by_section(spark, folder).collect()}
    assert got == want and len(got) > 1


@pytest.mark.parametrize("n", [0, 1, 300, 20000])
def test_a_filter_passes_what_it_holds_and_little_else(spark, n):
    held = spark.range(n).select(F.concat(F.lit("held-"), "id").alias("v"))
    bits = bloom.bits_for(n)
    words = bloom.build(held, "v", bits)
    assert held.where(~bloom.might_hold(F.col("v"), words, bits)).count() == 0
    foreign = spark.range(20000).select(F.concat(F.lit("other-"), "id").alias("v"))
    assert foreign.where(bloom.might_hold(F.col("v"), words, bits)).count() <= 20000 * 0.0075


def test_a_filter_has_a_largest_size():
    assert bloom.bits_for(0) == bloom.LEAST_BITS and bloom.bits_for(10 ** 12) == bloom.MOST_BITS
    assert all(bloom.bits_for(n) >= 16 * n and bloom.bits_for(n).bit_count() == 1 for n in (1, 255, 256, 257, 10 ** 6))


def test_tokens_of_no_term_are_dropped_where_texts_are_split(spark):
    texts = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(200)) + (" needle" if i % 10 == 0 else "")) for i in range(100)], "key int, text string")
    terms = spark.createDataFrame([("needle", "needle"), ("straw", "straw")], "term string, token string")
    kept = leaks._held_tokens(texts, terms)
    found = kept.collect()
    assert sum(r.token == "needle" for r in found) == 10 and len(found) < 10 + 20000 * 0.0075
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0]


def test_neither_texts_nor_terms_travel_whole_through_the_driver(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=60)) + " -- / " for _ in range(300)]
    terms = vocabulary[:200] + [f"{a} {b}" for a, b in zip(vocabulary, vocabulary[7:])] + ["--", "/"]
    want = {(i, w) for i, s in enumerate(texts) for w in terms if stands_in(s, w)}
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    pairs = leaks.leak_pairs(t, spark.createDataFrame([(x,) for x in terms], "term string"), "id", "text")
    assert {(r.key, r.term) for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Subqueries")[0]
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
