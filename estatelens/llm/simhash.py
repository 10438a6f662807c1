"""SimHash near-duplicates, found through equal blocks of fingerprint bits."""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import with_row_id
from estatelens.llm.components import components
from estatelens.session import settle

BITS = 64
BLOCKS = 5
SEED = 42  # of the shingle hash
CHUNK = 1 << 15  # shingles whose bits are counted at once
CROWDED = 512  # fingerprints under one key from which the key is made finer


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a whole text over word shingles, repeats included, as a signed long."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both act on ASCII only
    if not words:
        return 0
    shingles = (b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    while chunk := [xxhash.xxh64_intdigest(s, SEED) for s in islice(shingles, CHUNK)]:
        hashes = np.array(chunk, dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(chunk)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def majority(hashes: np.ndarray) -> int:
    """The SimHash of given 64-bit shingle hashes, as a signed long; zero for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at:at + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: str | Column, width: int = 3) -> Column:
    """The fingerprint of each text; null counts as empty and gives zero."""

    @F.pandas_udf("long")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return each(text)


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def references(n: int, seed: int = 7) -> list[int]:
    """Reference fingerprints: the words of a seeded generator, each with half of the bits on average."""
    return [signed(xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed)) for i in range(n)]


def finer(mask: int, distance: int) -> list[int]:
    """Masks that fix more bits than ``mask``: of the free bits' BLOCKS blocks, all but ``distance`` are fixed.

    Two fingerprints that agree under ``mask`` and differ in at most ``distance`` bits agree
    under one of these masks at least.
    """
    free = [b for b in range(BITS) if not mask >> b & 1]
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(free, dtype=np.int64), BLOCKS)]
    return [mask | sum(chosen) for chosen in combinations(blocks, BLOCKS - distance)]


def near_pairs(prints: DataFrame, distance: int = 3, n_references: int = 8) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints ``fp`` that differ in at most ``distance`` bits.

    Pairs to test come from blocks of bits: of BLOCKS blocks a linked pair has all but
    ``distance`` equal, so it meets under one of the keys of such block sets. The join also
    tests each fingerprint's Hamming distances to the references: by the triangle inequality
    those of a linked pair differ by ``distance`` at most. This is no part of the search and
    discards nothing that the exact count of differing bits would not.

    A key that CROWDED or more fingerprints share is not joined: its fingerprints move to
    keys that also fix blocks of the bits still free, until no key is crowded or no bit is
    left. This loses no pair and keeps the pairs tested under a key bounded.
    """
    if not 0 <= distance < BLOCKS:
        raise ValueError("distance must be below the number of blocks")
    pivots = references(n_references)
    table = prints.select("fp", *[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte").alias(f"p{i}") for i, p in enumerate(pivots)])
    names = table.columns
    masks, found = finer(0, distance), None
    spread = table.select("*", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    while True:
        keyed = spread.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        last = max(m.bit_count() for m in masks) >= BITS - 1
        crowded = None
        if not last:
            crowded = settle(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") >= CROWDED).select("mask", "key"))
            if crowded.isEmpty():
                crowded = None
        open_ = keyed if crowded is None else keyed.join(crowded, ["mask", "key"], "left_anti")
        a, b = open_.alias("a"), open_.alias("b")
        near = F.col("a.mask").eqNullSafe(F.col("b.mask")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
        for i in range(n_references):
            near = near & (F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) <= distance)
        near = near & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
        pairs = a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
        if crowded is None:
            return found.distinct()
        more = {m: finer(m, distance) for m in masks}
        rows = [(signed(m), signed(f)) for m, fs in more.items() for f in fs]
        steps = prints.sparkSession.createDataFrame(rows, "mask long, finer long")  # 10 rows for each mask
        spread = keyed.join(crowded, ["mask", "key"], "left_semi").join(steps, "mask").select(*names, F.col("finer").alias("mask")).distinct()
        spread, masks = settle(spread), sorted({f for fs in more.values() for f in fs})


def grouped(df: DataFrame, id_: str, text: str, distance: int = 3, width: int = 3) -> DataFrame:
    """The rows without their text, with ``fp``, the component's ``root`` and ``component_id``."""
    keep = [c for c in df.columns if c != text]
    rows = settle(df.select(*keep, fingerprints(text, width).alias("fp")))
    prints = settle(rows.groupBy("fp").agg(F.min(id_).alias("least")))
    nodes = components(near_pairs(prints, distance), "a", "b").withColumnRenamed("node", "fp")
    placed = settle(prints.join(nodes, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.select("fp", "root").join(named, "root"), "fp")


def near_duplicates(df: DataFrame, id_: str, text: str, distance: int = 3, width: int = 3) -> DataFrame:
    """One row per row of ``df``: (id, fingerprint, component_id).

    Fingerprints link at ``distance`` or fewer differing bits; components are what links
    connect, named by the smallest id in them (null if they have none). Copies share a
    fingerprint and are merged before anything is compared. Null and empty texts have the
    fingerprint zero and link like any other. Other columns are not read; repeated rows
    give repeated results; an empty table gives an empty one.
    """
    found = grouped(df.select(F.col(id_).alias("id"), F.col(text).alias("text")), "id", "text", distance, width)
    return found.select(F.col("id").alias(id_), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_: str = "doc_id", text: str = "text", distance: int = 3, width: int = 3) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays.

    Null ids come last; of rows with the same id one stays. Columns stay as they are.
    """
    named = with_row_id(docs)
    rows = named.select(F.col(f"row.`{id_}`").alias("id"), F.col(f"row.`{text}`").alias("text"), "__file", "__row")
    found = grouped(rows, "id", "text", distance, width)
    best = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "__file", "__row"))
    stay = found.groupBy("root").agg(best.alias("best")).select("best.__file", "best.__row")
    return named.join(stay, ["__file", "__row"], "left_semi").select("row.*")
