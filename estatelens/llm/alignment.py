"""Alignment of two tokenizers' tokens over the same bytes.

Each token ends at a byte offset. Offsets where tokens of both tokenizers end cut a text into
groups. They are found by galloping: each end of the shorter list is sought in the longer one
from where the last was found, by doubling steps and then a binary search within the last step.
The ranks of the common ends slice the tokens into groups, and their differences are the
groups' token ranges.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from estatelens.llm.common import array_column, in_slices
from estatelens.session import settle

NEVER = float("inf")
LONG = 1 << 15  # characters from which the rank library's pattern search could run out of stack on one run of spaces
SENT_ROWS = 1 << 20  # pair counts sent to every task; more are joined by shuffling
SALTS = 16  # ways in which the links of one pair are split in that join
WIDE = 1 << 12  # pairs of a group from which equal ids are counted first


def gallop(short: list[int], long: list[int]) -> tuple[list[int], list[int]]:
    """How many numbers of each ascending list end at or before each number that both hold."""
    in_short, in_long, at, n = [], [], 0, len(long)
    here = long[0] if n else NEVER
    for place, x in enumerate(short, 1):
        if here < x:
            step = 1
            while at + step < n and long[at + step] < x:
                step <<= 1
            at = bisect_left(long, x, at + (step >> 1) + 1, min(at + step, n))
            here = long[at] if at < n else NEVER
        if here == x:
            at += 1
            in_short.append(place)
            in_long.append(at)
            here = long[at] if at < n else NEVER
    return in_short, in_long


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of each side end at or before each common end; the shorter list drives the search."""
    return gallop(a, b) if len(a) <= len(b) else gallop(b, a)[::-1]


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others, in order, are the characters from
    U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def merges_by_rank(data: str) -> bool:
    """Whether merging by ids gives the same as the merge list of a byte-level BPE in JSON.

    A merge list joins only the pairs that it names; merging by rank joins whatever makes a
    token, the lowest id first. The two agree if the list makes tokens in the order of
    their ids, and if merging a token's own bytes by lower ids ends at the pair that the
    list names for it: what lies in the bytes of a token is merged alike wherever it stands.
    """
    model, letters = json.loads(data)["model"], byte_level_bytes()
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if any(i >= j for i, j in zip(ids, ids[1:])) or len(ids) + len(letters) != len(model["vocab"]):
        return False
    for (left, right), top in zip(pairs, ids):
        parts = list(left + right)
        while len(parts) > 2:
            rank, i = min((model["vocab"].get(a + b, top), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= top:
                return False
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if parts != [left, right]:
            return False
    return True


class ByteLevel:
    """A byte-level BPE tokenizer from its JSON file; strings of special tokens are plain text.

    If merging by ranks is known to give the same (``by_rank``, for a tokenizer that splits
    texts by ``pattern``), texts below LONG characters are encoded that way, which is faster.
    """

    def __init__(self, data: str, pattern: str, by_rank: bool = False):
        self.whole = Tokenizer.from_str(data)
        self.whole.encode_special_tokens = True
        letters, vocabulary = byte_level_bytes(), self.whole.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        ranks = {self.tokens[i]: i for i in self.whole.get_vocab(with_added_tokens=False).values()}
        self.ranked = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if by_rank else None

    def encoded(self, text: str) -> list[int]:
        if self.ranked is not None and len(text) < LONG:
            return self.ranked.encode_ordinary(" " + text)
        return self.whole.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """A SentencePiece tokenizer from its model file; it puts the space before a text itself."""

    def __init__(self, data: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)]

    def encoded(self, text: str) -> list[int]:
        return self.model.encode(text)


class Sides:
    """Two tokenizers over the same texts."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.sides = [(side, np.array([len(t) for t in side.tokens], dtype=np.int64)) for side in (a, b)]

    def aligned(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
        """(A ids, B ids, A's ranks of the common ends, B's) of each text.

        Texts that are null or empty, or whose tokens' bytes are not a space and the text,
        have no tokens.
        """
        none = np.zeros(0, dtype=np.int32)
        for text in texts:
            ids, ends = [], []
            for side, size in self.sides if text else ():
                found = side.encoded(text)
                if b"".join(map(side.tokens.__getitem__, found)) != b" " + text.encode():
                    break
                ids.append(np.array(found, dtype=np.int32))
                ends.append(np.cumsum(size[ids[-1]]).tolist())
            else:
                if text:
                    yield *ids, *(np.array(e, dtype=np.int32) for e in common_ends(*ends))
                    continue
            yield none, none, none, none


@lru_cache(2)
def _sides(a: str, b: bytes, pattern: str, by_rank: bool) -> Sides:
    return Sides(ByteLevel(a, pattern, by_rank), Pieces(b))


@lru_cache(2)
def _marked(n: int) -> np.ndarray:
    """A row of characters, padded with zeros, for each number below ``n`` followed by a comma, a bar or a semicolon."""
    return np.array([f"{i}{mark}" for i in range(n) for mark in ",|;"], dtype=np.bytes_).view(np.uint8).reshape(3 * n, -1)


def group_text(x: np.ndarray, y: np.ndarray, to_x: np.ndarray, to_y: np.ndarray) -> str:
    """The groups as `a1,a2|b1;a3|b2,b3`: ids in order, A's before B's."""
    if not len(to_x):
        return ""
    na, nb = np.diff(to_x, prepend=0), np.diff(to_y, prepend=0)
    code = np.empty(len(x) + len(y), dtype=np.int64)
    before_a, before_b = np.repeat(to_y - nb, na), np.repeat(to_x, nb)  # tokens of the other side that stand before
    code[np.arange(len(x)) + before_a] = 3 * x.astype(np.int64)
    code[np.arange(len(y)) + before_b] = 3 * y.astype(np.int64)
    code[to_x + to_y - nb - 1] += 1
    code[to_x + to_y - 1] += 2
    text = _marked((int(max(x.max(), y.max())) >> 16) + 1 << 16)[code].ravel()
    return text[text != 0].tobytes().decode()[:-1]


def linked(x: np.ndarray, y: np.ndarray, to_x: np.ndarray, to_y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A id, B id, times) of the pairs that share a group, each pair once, ascending.

    In a group each A token meets each B token. In a wide group equal ids are counted
    first, so a group of few different ids never becomes the product of its tokens.
    """
    if not len(to_x):
        return (np.zeros(0, np.int64),) * 3
    na, nb = np.diff(to_x, prepend=0), np.diff(to_y, prepend=0)
    begin_x, begin_y = to_x - na, to_y - nb
    slim = na * nb < WIDE
    per_x = np.repeat(np.where(slim, nb, 0), na)  # how many B tokens each A token meets
    begin = np.repeat(begin_y, na)
    left = np.repeat(x, per_x)
    place = np.arange(len(left)) - np.repeat(np.cumsum(per_x) - per_x, per_x)
    keys = np.sort(left.astype(np.int64) << 32 | y[np.repeat(begin, per_x) + place])
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, times = keys[begins], np.diff(begins, append=len(keys))
    if not slim.all():
        keys, times = [keys], [times]
        for g in np.flatnonzero(~slim):
            i, n = np.unique(x[begin_x[g]:to_x[g]], return_counts=True)
            j, m = np.unique(y[begin_y[g]:to_y[g]], return_counts=True)
            keys.append((i.astype(np.int64)[:, None] << 32 | j).ravel())
            times.append(np.outer(n, m).ravel())
        keys, which = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.bincount(which, weights=np.concatenate(times)).astype(np.int64)
    return keys >> 32, keys & 0xFFFFFFFF, times


TOKENS = "a array<int>, b array<int>, a_ends array<int>, b_ends array<int>"
LINKS = "n_a long, n_b long, n_groups long, n_links long, groups string, link_a array<int>, link_b array<int>, times array<long>"


class Tokenizers:
    """Two tokenizers from their files, which the driver reads and sends to each executor once."""

    def __init__(self, spark: SparkSession, byte_level: str, pieces: str, pattern: str):
        data = Path(byte_level).read_text("utf-8")
        self.files = spark.sparkContext.broadcast((data, Path(pieces).read_bytes(), pattern, merges_by_rank(data)))

    def alignments(self, df: DataFrame, text: str) -> DataFrame:
        """The columns of ``df`` but ``text``, with TOKENS: ids of each side, and how many of them end at or before each common end."""
        files = self.files

        def make(texts: list[str | None]) -> list[pa.Array]:
            return [array_column(side, pa.int32()) for side in zip(*_sides(*files.value).aligned(texts))]

        return in_slices(df, text, TOKENS, make)

    def links(self, df: DataFrame, text: str) -> DataFrame:
        """The columns of ``df`` but ``text``, with LINKS: sizes, the groups as text, and each linked pair once with how often it is linked."""

        files = self.files

        def make(texts: list[str | None]) -> list[pa.Array]:
            rows = [(row, linked(*row)) for row in _sides(*files.value).aligned(texts)]
            sizes = [[len(r[i]) for r, _ in rows] for i in range(3)] + [[int(k[2].sum()) for _, k in rows]]
            groups = pa.array([group_text(*r) for r, _ in rows], type=pa.string())
            pairs = [array_column([k[i] for _, k in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))]
            return [*(pa.array(s, type=pa.int64()) for s in sizes), groups, *pairs]

        return in_slices(df, text, LINKS, make)


def pair_counts(each: DataFrame) -> DataFrame:
    """(link_a, link_b, docs, best) of linked pairs: how many rows of ``each`` hold a pair, and whether no other pair of its A id has more."""
    pairs = each.select(F.inline(F.arrays_zip("link_a", "link_b")))
    counts = settle(pairs.groupBy("link_a", "link_b").agg(F.count("*").alias("docs")))
    most = counts.groupBy("link_a").agg(F.max("docs").alias("most"))
    return settle(counts.join(most, "link_a").select("link_a", "link_b", "docs", (F.col("docs") == F.col("most")).alias("best")))


def link_sums(each: DataFrame, counts: DataFrame, sent_rows: int = SENT_ROWS) -> DataFrame:
    """(row, n_best, count_sum): per row, its links whose pair is best, and the counts of all its links.

    Up to ``sent_rows`` counts are sent to every task. More are joined by shuffling: links
    of one pair are split SALTS ways, since a pair may be in every text. Both give the same.
    """
    pairs = each.select("row", F.inline(F.arrays_zip("link_a", "link_b", "times")))
    if counts.count() <= sent_rows:
        met = pairs.join(F.broadcast(counts), ["link_a", "link_b"])
    else:
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = pairs.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["link_a", "link_b", "salt"])
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)))
    return met.groupBy("row").agg(best.alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))


def document_alignment(documents: DataFrame, byte_level: str, pieces: str, pattern: str, sent_rows: int = SENT_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    Whole texts are aligned. Texts that are null or empty, or that one of the tokenizers
    does not give back byte for byte, have no tokens: zeros, and an empty digest. Each row
    is a document, so repeated rows count each and have equal results; null ids stay null;
    an empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    both = Tokenizers(documents.sparkSession, byte_level, pieces, pattern)
    rows = both.links(documents.select("doc_id", "text"), "text")
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    each = settle(rows.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "link_a", "link_b", "times"))
    sums = link_sums(each, pair_counts(each), sent_rows)
    zero = F.lit(0).cast("long")
    return each.drop("link_a", "link_b", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
