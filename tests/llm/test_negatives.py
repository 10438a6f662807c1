"""Hard negatives against every pair by brute force."""

import random

import numpy as np
import pytest

from estatelens.llm import negatives

ROWS = "vec_id long, embedding array<double>, label int, row long, slot int, score double"


def brute(rows, every=50, relabelled=7):
    """(anchor, positive, rank, negative, positive_score, negative_score) by sorting all scores."""
    kept = []
    for id_, vector, label in rows:
        if id_ is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if id_ % relabelled == 0 else label
        kept.append((id_, [int(np.floor(256.0 * x)) for x in vector], label))
    out = []
    for a, u, label in kept:
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(u, v)), i, other) for i, v, other in kept if i != a)
        for ps, p, _ in [s for s in scores if s[2] == label][:5]:
            fit = [s for s in scores if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(a, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], ROWS)
    out = negatives.mined(frame, **how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def drawn(n, seed, wide=8, labels=4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.1, 0.3) for _ in range(wide)], rng.randrange(labels)) for i in range(n)]


def test_equals_brute_force_over_blocks_and_lists(spark, monkeypatch):
    rows = drawn(900, 1)
    assert mined(spark, rows, every=10, at_once=32) == brute(rows, every=10)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(1)
    with monkeypatch.context() as m:  # many lists to a task, many steps to a list
        for name, value in (("SHARD", 100), ("FIRST_STEP", 4), ("MOST_STEP", 16), ("MEMBERS", 5)):
            m.setattr(negatives, name, value)
        blocks = list(negatives.anchor_blocks(negatives.numbered(
            frame.where("vec_id % 10 = 0").select(negatives.F.col("vec_id").alias("id"), "label", negatives.scaled("embedding").alias("vector"))), 7))
        assert sum(len(b.row) for b in blocks) == 90 and sorted(r for b in blocks for r in b.row.tolist()) == list(range(90))


def test_walks_end_early_and_lose_nothing():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16)) * 100
    vectors = np.floor(centres[rng.integers(0, 6, 4000)] + rng.normal(size=(4000, 16)) * 8).astype(np.int64)
    ids, labels = np.arange(4000), rng.integers(0, 5, 4000)
    anchors = negatives.Anchors(np.arange(80), ids[:80], labels[:80], vectors[:80])
    walk, scored = negatives.Walk(anchors, 5), []
    plain = walk.scored
    walk.scored = lambda rows, *rest: (scored.append(rest[2].size), plain(rows, *rest))
    walk.over(ids, labels, vectors)
    assert sum(scored) < 0.6 * 80 * 4000
    products = vectors[:80] @ vectors.T
    for a in range(80):
        want = sorted((-int(products[a, i]), int(i)) for i in ids if i != a and labels[i] == labels[a])[:5]
        assert list(zip((-walk.best.scores[a]).tolist(), walk.best.ids[a].tolist())) == want


def test_bounds_hold_for_every_member():
    rng = np.random.default_rng(5)
    for wide in (1, 2, 7):
        anchors = np.floor(rng.normal(size=(50, wide)) * 40).astype(np.int64)
        candidates = np.floor(rng.normal(size=(300, wide)) * 60).astype(np.int64)
        groups = negatives.clusters(anchors, 8)
        assert sorted(np.concatenate([c.rows for c in groups]).tolist()) == list(range(50))
        for c in groups:
            order, bound = negatives.shared_list(candidates, c)
            exact = negatives.products(anchors[c.rows], candidates[order])
            assert (exact <= negatives.lengths(anchors[c.rows])[:, None] * bound[None, :] + 1e-3).all()
            assert (np.diff(bound) <= 0).all()


def test_ties_and_repeated_rows(spark):
    rng = random.Random(7)
    rows = [(i, [float(rng.randrange(3)), float(rng.randrange(2)), 1.0], rng.randrange(3)) for i in range(300)]
    assert mined(spark, rows, every=15) == brute(rows, every=15)
    rows += rows[10:60]  # repeated rows, anchors among them
    assert mined(spark, rows, every=15) == brute(rows, every=15)


def test_awkward_rows(spark):
    rows = drawn(120, 9, wide=3)
    rows += [(200, None, 1), (250, [0.1, None, 0.2], 1), (300, [float("nan"), 0.1, 0.2], 1), (350, [float("inf"), 0.0, 0.0], 1),
             (400, [0.1, 0.2, 0.3], None), (None, [9.0, 9.0, 9.0], 1), (450, [0.0, 0.0, 0.0], 1), (500, [], 2), (550, [0.4, 0.2], 1), (-50, [0.3, 0.3, 0.3], 1)]
    assert mined(spark, rows, every=10) == brute(rows, every=10)
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []
    assert mined(spark, [(i, [-1.0], 0) if i % 2 else (i, [1.0], 0) for i in range(40)], every=10) == []  # one label: no negatives


def test_large_numbers_are_exact_or_refused(spark):
    rows = [(i, [1e6 + i, 2e6 - 3 * i, 5.0], i % 3) for i in range(60)]
    assert mined(spark, rows, every=20) == brute(rows, every=20)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(i, [1e15, 1e15], i % 3) for i in range(60)], every=20)
