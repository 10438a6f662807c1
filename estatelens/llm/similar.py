"""Near copies by the Jaccard similarity of word shingles.

SimHash fingerprints seek the nearest copies, as `simhash` does; copies edited further, whose
fingerprints lie too far apart for that, are sought by MinHash bands. Exact shingle sets
verify every pair of either search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm import simhash
from estatelens.llm.common import with_row_id
from estatelens.llm.components import components
from estatelens.session import settle

SEED = 42  # of the shingle hash
ROWS, BANDS = 5, 40  # a pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 5) ** 40 = 1.2e-7
CHUNK = 256  # shingles whose hashes are permuted at once
CROWDED = 16  # nodes of a bucket from which its pairs are tested by wide sketches first
WIDE, MOST = 4096, 513  # bits of a wide sketch; more than MOST of them differ for a pair of similarity 0.8 with probability 8e-08
FACTORS, MIX = np.random.default_rng(11).integers(0, 1 << 63, size=(2, ROWS * BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WIDE_FACTORS, WIDE_MIX = np.random.default_rng(12).integers(0, 1 << 63, size=(2, WIDE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of a whole text's word shingles, ascending; fewer words make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both act on ASCII only
    if not words:
        return np.zeros(0, dtype="<u8")
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), SEED) for i in range(max(1, len(words) - width + 1))], dtype="<u8"))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two shingle sets; empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def bands(hashes: np.ndarray) -> list[int]:
    """One key for each band of least permuted hashes, as signed longs; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[at:at + CHUNK, None] * FACTORS).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * MIX
    return (mixed ^ (mixed >> np.uint64(31))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view("<i8").tolist()


def sketches(text: str | Column, width: int = 5) -> Column:
    """(node, size, fp, bands) of each text: a digest of its shingle set, how many shingles, their SimHash, the band keys."""

    @F.pandas_udf("node binary, size long, fp long, bands array<long>")
    def each(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in texts]
        return pd.DataFrame({"node": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "size": [len(s) for s in sets], "fp": [simhash.majority(s) for s in sets], "bands": [bands(s) for s in sets]})

    return each(text)


def wide_sketch(hashes: np.ndarray) -> np.ndarray:
    """WIDE bits, one of each of WIDE least permuted hashes, as signed longs.

    Whether two sets have the same least hash is a draw with their similarity as chance;
    with another one the bits still agree half of the time. So bits of sets of similarity
    0.8 differ with probability 0.1 each.
    """
    least = np.full(WIDE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK, None] * WIDE_FACTORS
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * WIDE_MIX
    return np.packbits((mixed >> np.uint64(63)).astype(np.uint8), bitorder="little").view("<i8")


def wide_sketches(text: str | Column, width: int) -> Column:
    @F.pandas_udf("array<long>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([wide_sketch(shingle_set(t, width)) for t in texts], dtype=object)

    return each(text)


def measured(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, similarity) of the pairs of nodes, exactly, from the whole texts."""

    @F.pandas_udf("double")
    def each(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = lru_cache(64)(lambda t: shingle_set(t, width))
        for a, b in parts:
            yield pd.Series([similarity(known(x), known(y)) for x, y in zip(a, b)], dtype="float64")

    of = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"_{c}"))
    return settle(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", each("_a", "_b").alias("similarity")))


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of nodes that SimHash finds, nodes of one fingerprint standing behind their least one."""
    prints = settle(sets.groupBy("fp").agg(F.min("node").alias("least")))
    at = lambda c: prints.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}"))
    apart = simhash.near_pairs(prints.select("fp")).join(at("a"), "a").join(at("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    equal = sets.select("fp", "node").join(prints, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return settle(apart.unionByName(equal).distinct())


def linked(sets: DataFrame, texts_of, least: float, width: int) -> DataFrame:
    """(node, component) of the nodes that pairs of similarity ``least`` or more connect.

    The pairs that SimHash finds are measured first. Copies of similarity 0.8 differ in 10
    of 64 bits on average, beyond what blocks of bits can seek; MinHash bands seek those.
    Nodes that share a band key share a bucket. Each bucket's nodes are first measured
    against its centre: the node whose keys are the most shared ones, which in a family of
    edited copies is the one nearest to what they have in common, so that nearly all of them
    link to it. The nodes that are not connected to the centre then get a centre among
    themselves, as long as a round of this at least halves the pairs left. Of the pairs left
    in a bucket, those are measured that no link connects yet and that can be similar: one
    minus the similarity is a metric, so the distances to any common centre differ by
    1 - ``least`` at most, and sizes by that factor. In buckets of CROWDED nodes or more
    left, wide sketches of both nodes must also differ in MOST bits at most; smaller ones
    have fewer than CROWDED / 2 pairs a node. What is left out is in one component already
    or is not similar.
    """
    spread = sets.select("node", "size", F.explode("bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = settle(spread.join(buckets, "key"))
    open_ = settle(shared.join(shared.groupBy("node").agg(F.sum("n").alias("score")), "node").select(
        "key", "node", "size", "score", F.col("node").alias("part"), F.array().cast("array<double>").alias("to")))
    near = fingerprint_pairs(sets)
    texts = texts_of(shared.select("node").unionByName(near.select(F.col("a").alias("node"))).unionByName(near.select(F.col("b").alias("node"))).distinct())
    seen, before = measured(near, texts, width), None
    while True:
        centres = open_.groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("centre"), F.count("*").alias("n")).where("n > 1")
        members = settle(open_.join(centres, "key"))
        stars = members.where("node <> centre").select(F.greatest("centre", "node").alias("b"), F.least("centre", "node").alias("a")).distinct()
        stars = measured(stars.join(seen, ["a", "b"], "left_anti"), texts, width)
        seen = settle(seen.unionByName(stars))
        links = seen.where(F.col("similarity") >= least).select("a", "b")
        nodes = components(links, "a", "b")
        of = seen.select(F.greatest("a", "b").alias("_b"), F.least("a", "b").alias("_a"), F.col("similarity").alias("_s"))
        pair = (F.greatest("centre", "node") == F.col("_b")) & (F.least("centre", "node") == F.col("_a"))
        rest = members.where("node <> centre").join(of, pair).drop("_a", "_b", "part")
        rest = rest.join(nodes, "node", "left").join(nodes.select(F.col("node").alias("centre"), F.col("component").alias("_c")), "centre", "left")
        part = F.coalesce("component", "node")
        rest = rest.select("key", "node", "size", "score", part.alias("part"), F.concat("to", F.array("_s")).alias("to"), (part == F.coalesce("_c", "centre")).alias("held"))
        rest = settle(rest)
        # pairs inside the centre's component are connected; all other pairs of a bucket may be left
        sizes = rest.groupBy("key").agg(F.count("*").alias("n"), F.count_if("held").alias("h"))
        left = sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("h") * F.col("h")).cast("double"))).first()[0] or 0.0
        if left == 0 or (before is not None and left > before / 2):
            break
        before = left
        if rest.where("not held").isEmpty():
            break
        # a bucket without open nodes is done; the held ones stay, since an open node may link to them
        going = sizes.where("h < n").select("key")
        open_ = settle(rest.join(going, "key", "left_semi").withColumn("score", F.when(F.col("held"), F.lit(0)).otherwise(F.col("score"))).drop("held"))
    crowds = sizes.where(F.col("n") >= CROWDED).select("key")
    crowd = settle(rest.join(crowds, "key", "left_semi"))
    wide = texts.join(crowd.select("node").distinct(), "node").select("node", wide_sketches("text", width).alias("wide"))
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda n, v: n + v)

    def pairs(of: DataFrame, *more) -> DataFrame:
        x, y = of.alias("x"), of.alias("y")
        near = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part"))
        near = near & F.forall(F.zip_with("x.to", "y.to", lambda i, j: F.abs(i - j)), lambda d: d <= 1 - least + 1e-9)
        near = near & (F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * (least - 1e-9))
        return x.join(y, reduce(and_, more, near)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    few = pairs(rest.join(crowds, "key", "left_anti"))
    many = pairs(crowd.join(settle(wide), "node"), apart(F.col("x.wide"), F.col("y.wide")) <= MOST)
    pairs = few.unionByName(many).distinct().join(seen, ["a", "b"], "left_anti")
    more = measured(pairs, texts, width).where(F.col("similarity") >= least).select("a", "b")
    return components(links.unionByName(more), "a", "b")


def one_of_each(docs: DataFrame, id_: str = "doc_id", text: str = "text", least: float = 0.8, width: int = 5) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays.

    Two documents are near copies if their sets of ``width``-word shingles have a Jaccard
    similarity of ``least`` or more; components are what near copies connect. Equal sets are
    merged before anything is compared; null and empty texts are equal. Null ids come last;
    of rows with the same id one stays. Columns stay as they are.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("the bands are made for a similarity of 0.8 or more")
    named = with_row_id(docs)
    rows = named.select(F.col(f"row.`{id_}`").alias("id"), "__file", "__row", sketches(F.col(f"row.`{text}`"), width).alias("s"))
    rows = settle(rows.select("id", "__file", "__row", "s.*"))
    best = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "__file", "__row"))
    sets = settle(rows.groupBy("node").agg(best.alias("best"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))

    def texts_of(nodes: DataFrame) -> DataFrame:
        where = sets.join(nodes, "node").select("node", "best.__file", "best.__row")
        return settle(named.select("__file", "__row", F.col(f"row.`{text}`").alias("text")).join(where, ["__file", "__row"]).select("node", "text"))

    placed = sets.join(linked(sets, texts_of, least, width), "node", "left").select("best", F.coalesce("component", "node").alias("root"))
    stay = placed.groupBy("root").agg(F.min("best").alias("best")).select("best.__file", "best.__row")
    return named.join(stay, ["__file", "__row"], "left_semi").select("row.*")
