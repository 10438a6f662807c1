"""Near copies in one large family: most pairs are below the similarity, all have a centre in common."""

import random

import numpy as np

from estatelens.llm import similar


def family(n, words, changes, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(words)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        copy = list(base)
        for _ in range(rng.randint(1, changes)):
            copy[rng.randrange(words)] = word()
        rows.append((i, " ".join(copy)))
    return rows


def test_a_family_is_found_through_its_centre(spark, monkeypatch):
    # two changes leave a similarity of 0.84 to the base, and of 0.70 between two copies
    rows = family(400, 120, 2, 3)
    sets = {i: similar.shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked, ids = 0, sorted(sets)
    for x in ids:
        for y in ids[:x]:
            if similar.similarity(sets[x], sets[y]) >= 0.8:
                linked += 1
                a, b = sorted((find(x), find(y)))
                root[b] = a
    assert linked < 0.5 * 400 * 399 / 2
    counted, plain = [], similar.measured

    def measured(pairs, texts, width):
        counted.append(pairs.count())
        return plain(pairs, texts, width)

    monkeypatch.setattr(similar, "measured", measured)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in similar.one_of_each(docs).collect())
    assert kept == sorted({find(i) for i in ids})
    assert sum(counted) < 400 * 399 / 2 / 4, counted


def test_a_family_without_links_does_not_measure_all_its_pairs(spark, monkeypatch):
    # four changes and more leave a similarity of 0.7 to the base at most, and of 0.5 between two copies, which mostly share a bucket
    rows = [(i, t) for i, t in family(300, 120, 2, 5)[:1]] + [(i, t) for i, t in family(301, 120, 9, 5)[1:] if similar.similarity(
        similar.shingle_set(t), similar.shingle_set(family(1, 120, 1, 5)[0][1])) < 0.75]
    assert len(rows) > 150
    rows += [(1000, rows[5][1] + " tail"), (1001, rows[7][1] + " other")]
    counted, plain = [], similar.measured

    def measured(pairs, texts, width):
        counted.append(pairs.count())
        return plain(pairs, texts, width)

    monkeypatch.setattr(similar, "measured", measured)
    monkeypatch.setattr(similar, "CROWDED", 2, raising=False)  # every bucket that holds a pair
    kept = {r["doc_id"] for r in similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows} - {1000, 1001}
    assert sum(counted) < 10 * len(rows), counted


def test_wide_sketches_of_similar_sets_differ_in_few_bits():
    rng = np.random.default_rng(4)
    apart = []
    for n in (9, 18, 90, 900):
        for _ in range(100):
            every = rng.integers(0, 1 << 63, size=n + n // 9, dtype=np.uint64)  # 8 of 10 parts in both sets
            edge = n // 9
            a, b = similar.wide_sketch(every[edge:]), similar.wide_sketch(every[:-edge])
            apart.append(int(np.bitwise_count((a ^ b).view("u8")).sum()))
    assert max(apart) <= similar.MOST and abs(np.mean(apart) - 0.1 * similar.WIDE) < 3
    far = [similar.wide_sketch(rng.integers(0, 1 << 63, size=50, dtype=np.uint64)) for _ in range(2)]
    assert int(np.bitwise_count((far[0] ^ far[1]).view("u8")).sum()) > 2 * similar.MOST
    assert len(similar.wide_sketch(np.zeros(0, dtype="<u8"))) == similar.WIDE // 64


def test_simhash_pairs_are_sought_and_verified(spark, monkeypatch):
    # without bands only the fingerprints can find the copies
    rows = [(1, " ".join(f"w{i}" for i in range(3000))), (2, " ".join(f"w{i}" for i in range(3001))), (3, "something else altogether is written here")]
    monkeypatch.setattr(similar, "bands", lambda hashes: [])
    monkeypatch.setattr(similar.simhash, "CROWDED", 3)
    sets = [similar.shingle_set(t) for _, t in rows]
    prints = [similar.simhash.majority(s) for s in sets]
    frame = spark.createDataFrame([(bytes([i]), len(s), f) for i, (s, f) in enumerate(zip(sets, prints))], "node binary, size long, fp long")
    found = {(bytes(r["a"]), bytes(r["b"])) for r in similar.fingerprint_pairs(frame).collect()}
    assert found == {(b"\x00", b"\x01")}
    counted, plain = [], similar.fingerprint_pairs
    monkeypatch.setattr(similar, "fingerprint_pairs", lambda sets: counted.append(1) or plain(sets))
    similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert counted == [1]
