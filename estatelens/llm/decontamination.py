"""Benchmark decontamination by spaced seeds over words."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import running, whole_text
from estatelens.session import settle

#: Word positions that each mask reads; the others may differ. Found by a greedy search: any two
#: changed words in a window of 13 leave some place where one of the masks sees none of them.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
WINDOW = 13
CHANGED = 2  # words of a window that may be substituted; shorter items may have their share of it
FEW = 4  # words below which an item must also be half of the document's words
BLOCK_WORDS = 500_000  # benchmark words that are held in memory at once
WORDS = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class Seeds:
    """The masked hashes of a block of benchmark texts, and the check of what they hit."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, changed: int = CHANGED):
        self.window, self.changed = window, changed
        alike: dict[tuple, list[int]] = {}
        for number, text in items:
            if tokens := tuple(words(text)):
                alike.setdefault(tokens, []).append(number)
        self.numbers = list(alike.values())
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in alike for w in t}), 1)}
        self.texts = [np.array([self.vocabulary[w] for w in t], dtype=np.int64) for t in alike]
        self.factors = np.random.default_rng(17).integers(1, 1 << 63, size=window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # texts shorter than a window are sought whole, by the run of words that k changed ones leave at least
        lengths = sorted({len(t) for t in self.texts if len(t) < window})
        runs = {n: -(-(n - self.allowed(n)) // (self.allowed(n) + 1)) for n in lengths}
        self.masks = [(m, None) for m in MASKS] + [(tuple(range(runs[n])), n) for n in lengths]
        self.tables = []
        for mask, length in self.masks:
            hashes, owners, places = [], [], []
            for i, t in enumerate(self.texts):
                if len(t) >= window if length is None else len(t) == length:
                    h = self._masked(t, mask)
                    hashes.append(h)
                    owners.append(np.full(len(h), i))
                    places.append(np.arange(len(h)))
            h, o, p = (np.concatenate(x) if x else np.array([], dtype=d) for x, d in ((hashes, np.uint64), (owners, np.int64), (places, np.int64)))
            by = np.argsort(h, kind="stable")
            self.tables.append((h[by], o[by], p[by]))

    def allowed(self, n: int) -> int:
        """How many words of an item of n words, or of a window of it, may be substituted."""
        return self.changed * min(n, self.window) // self.window

    def _masked(self, ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
        n = len(ids) - mask[-1]
        if n <= 0:
            return np.array([], dtype=np.uint64)
        out, ids = np.zeros(n, dtype=np.uint64), ids.astype(np.uint64)
        for k, m in enumerate(mask):
            mixed = ids[m:m + n] * self.factors[k]
            out += mixed ^ (mixed >> np.uint64(29))
        return out

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item number, its words, words of it within verified windows, first word in the text) for each item found."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words(text)], dtype=np.int64)
        lines = set()
        for (mask, _), (known, owners, places) in zip(self.masks, self.tables):
            if not len(known) or len(ids) <= mask[-1]:
                continue
            own = self._masked(ids, mask)
            low = np.searchsorted(known, own, "left")
            at = np.nonzero(known[np.minimum(low, len(known) - 1)] == own)[0]
            if not len(at):
                continue
            high = np.searchsorted(known, own[at], "right")
            for a, lo, hi in zip(at.tolist(), low[at].tolist(), high.tolist()):
                lines.update(zip(owners[lo:hi].tolist(), (a - places[lo:hi]).tolist()))
        covered: dict[int, tuple[np.ndarray, int]] = {}
        for owner, shift in sorted(lines):
            item = self.texts[owner]
            lo, hi = max(0, -shift), min(len(item), len(ids) - shift)
            width = min(self.window, len(item))
            if hi - lo < width:
                continue
            equal = (item[lo:hi] == ids[lo + shift:hi + shift]).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(equal)])
            if len(item) < FEW and 2 * len(item) < len(ids):
                continue
            need = width - self.allowed(len(item))
            good = np.nonzero(sums[width:] - sums[:-width] >= need)[0]
            if len(good):
                marks, first = covered.get(owner, (np.zeros(len(item), dtype=bool), len(ids)))
                for g in good.tolist():
                    marks[lo + g:lo + g + width] = True
                covered[owner] = marks, min(first, lo + shift + int(good[0]))
        return [(n, len(self.texts[o]), int(m.sum()), f) for o, (m, f) in covered.items() for n in self.numbers[o]]


def blocks(benchmark: DataFrame, item: str, text: str, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[int]]:
    """The benchmark's rows numbered, with the block each belongs to, and the blocks' numbers."""
    rows = benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("item_text"))
    rows = rows.withColumn("_hash", F.xxhash64("item_text"))
    rows = rows.withColumn("_words", F.regexp_count(whole_text("item_text"), F.lit(r"(?U)\w+")).cast("long"))
    rows = settle(running(rows, ["item_id", "_hash"], {"number": "1", "_before": "_words"}))
    rows = rows.withColumn("block", F.expr(f"cast(_before div {block_words} as int)"))
    return rows, sorted(r[0] for r in rows.select("block").distinct().collect())


def block_seeds(rows: DataFrame, block: int, window: int, changed: int):
    """One block's seeds, sent to the executors: at most BLOCK_WORDS words and one text more."""
    items = [(r["number"], r["item_text"]) for r in rows.where(F.col("block") == block).select("number", "item_text").collect()]
    return rows.sparkSession.sparkContext.broadcast(Seeds(items, window, changed))


def _hits(seeds):
    @F.pandas_udf("array<array<long>>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([[list(h) for h in seeds.value.hits(t)] for t in texts])

    return each


def overlaps(docs: DataFrame, benchmark: DataFrame, id_: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
             window: int = WINDOW, changed: int = CHANGED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item_id, item_words, covered_words, share, first_word) for each document and benchmark item that it holds.

    An item is found in a document where a window of ``window`` words of one agrees with the
    other in all but ``changed`` words, word by word; items shorter than a window must occur
    whole, in all but their share of ``changed`` (rounded down) words, and items of fewer
    than FEW words must also make up half of the document's words. Words are lower-cased runs of letters, digits and underscores.
    ``covered_words`` counts the item's words within such windows, ``share`` is their part of
    the item. Fixed masks that skip some words are hashed at each place of both sides; equal
    hashes are verified along their diagonal, so nothing is reported on a hash alone.

    Benchmark texts are held in blocks of bounded size, each against all documents in one
    pass. Null or empty texts on either side match nothing; repeated rows on either side
    give repeated results; an empty table on either side gives an empty result.
    """
    rows, numbers = blocks(benchmark, item, item_text, block_words)
    found = None
    for block in numbers:
        hits = _hits(block_seeds(rows, block, window, changed))
        part = docs.select(F.col(id_).alias("_id"), F.explode(hits(F.col(text))).alias("_hit"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.select(F.col(id_).alias("_id"), F.array().cast("array<bigint>").alias("_hit")).limit(0)
    at = lambda i: F.get("_hit", F.lit(i))
    found = found.select("_id", at(0).alias("number"), at(1).alias("item_words"), at(2).alias("covered_words"), at(3).alias("first_word"))
    return found.join(rows.select("number", "item_id"), "number").select(
        F.col("_id").alias(id_), "item_id", "item_words", "covered_words",
        F.round(F.col("covered_words") / F.col("item_words"), 6).alias("share"), "first_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, changed: int = CHANGED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which `overlaps` finds no item; rows and columns stay as they are."""
    rows, numbers = blocks(benchmark, item, item_text, block_words)
    for block in numbers:
        docs = docs.where(F.size(_hits(block_seeds(rows, block, window, changed))(F.col(text))) == 0)
    return docs
