"""Byte-level BPE encoding and decoding by merge ranks.

The bytes of pre-tokens are a linked list. Mergeable pairs wait in a queue with a bucket of
list positions for each rank; a bitmap over the buckets, with a bitmap over its words and so
on, finds the lowest rank by find-first-set on each level. Work for n bytes is of the order
n log n, however long a pre-token is.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path
from struct import Struct

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm.common import array_column, in_slices

WORD_BITS = 6  # a word of the bitmap has 64 bits
NONE = -1  # no rank, no id
KEPT, KEPT_CHARS = 1 << 18, 32  # encoded pre-tokens a worker remembers, and the longest of them
ID = Struct("=i")
GROUP, TOGETHER = 128, 1 << 18  # texts split at once, and bytes of pre-tokens from which a list is merged


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a rank file: each line is a token in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class RankQueue:
    """Buckets of positions by rank; `lowest` finds the first bucket that holds something.

    ``levels[0]`` has one bit for each rank, set while its bucket holds something; each
    further level has one bit for each word below it, set while that word is not zero.
    """

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels, size = [], max(1, ranks)
        while True:
            size = -(-size // (1 << WORD_BITS))
            self.levels.append([0] * size)
            if size == 1:
                break

    def open(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        for level in self.levels:
            word = rank >> WORD_BITS
            was = level[word]
            level[word] = was | 1 << (rank & 63)
            if was:
                break
            rank = word

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.open(rank, [position])
        else:
            bucket.append(position)

    def lowest(self) -> int | None:
        """The lowest rank with a bucket: the first set bit of each level, from the top down."""
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << WORD_BITS | (word & -word).bit_length() - 1
        return rank

    def take(self, rank: int) -> list[int]:
        """Remove a rank's bucket and give its positions in order."""
        bucket = self.buckets.pop(rank)
        for level in self.levels:
            word = rank >> WORD_BITS
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                break
            rank = word
        bucket.sort()
        return bucket


def merged(pieces: list[bytes], ranks: dict[bytes, int], pairs: np.ndarray, queue: RankQueue) -> list[memoryview]:
    """The ids of each pre-token, as 32-bit numbers: the pair of the lowest rank, and of these the first, is merged until none is left.

    The pre-tokens lie end to end in one linked list and share the queue; no pair reaches
    over an end, so they do not affect each other. ``pairs`` has the rank of each pair of
    bytes, or NONE. A bucket is worked off from left to right; if a merge makes a pair of a
    lower rank, the rest of the bucket waits until that one is done. An entry is stale, and
    skipped, if the pair at its position has another rank by now: a pair's bytes only ever
    grow, so no pair gets a rank that it had before. ``queue`` must be empty, and is again
    at the end.
    """
    data = b"".join(pieces)
    n = len(data)
    octets = np.frombuffer(data, dtype=np.uint8).astype(np.int32)
    ends = np.cumsum([len(p) for p in pieces])
    first = bytearray(n + 1)  # whether a pre-token begins at a position
    first[0] = 1
    for end in ends.tolist():
        first[end] = 1
    filled = np.full(n, NONE, dtype=np.int32)
    filled[:-1] = pairs[octets[:-1] << 8 | octets[1:]]
    filled[ends - 1] = NONE
    waiting = np.flatnonzero(filled != NONE)
    waiting = waiting[np.argsort(filled[waiting], kind="stable")]
    cuts = np.flatnonzero(np.diff(filled[waiting], prepend=NONE))
    for part in np.split(waiting, cuts[1:]) if len(waiting) else []:
        queue.open(int(filled[part[0]]), part.tolist())
    rank_at, id_at = array("i", filled.tobytes()), array("i", [ranks[bytes([b])] for b in range(256)])
    id_at = array("i", np.frombuffer(id_at, dtype=np.int32)[octets].tobytes())
    after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    get, buckets, open_ = ranks.get, queue.buckets, queue.open
    while (rank := queue.lowest()) is not None:
        bucket = queue.take(rank)
        for place, i in enumerate(bucket, 1):
            if rank_at[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            rank_at[gone] = NONE
            id_at[gone] = NONE
            id_at[i] = rank
            low = rank
            new = NONE
            if not first[end]:
                before[end] = i
                new = get(data[i:after[end]], NONE)
                if new != NONE:
                    if (held := buckets.get(new)) is None:
                        open_(new, [i])
                    else:
                        held.append(i)
                    if new < low:
                        low = new
            rank_at[i] = new
            if not first[i]:
                h = before[i]
                new = rank_at[h] = get(data[h:end], NONE)
                if new != NONE:
                    if (held := buckets.get(new)) is None:
                        open_(new, [h])
                    else:
                        held.append(h)
                    if new < low:
                        low = new
            if low < rank:
                for left in bucket[place:]:
                    queue.push(rank, left)
                break
    ids = np.frombuffer(id_at, dtype=np.int32)
    kept = ids != NONE
    counts = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])].tolist()
    ids = memoryview(ids[kept])
    return [ids[a:b] for a, b in zip(counts, counts[1:])]


class Encoder:
    """Texts to ids. A pre-token that is a token itself has its id; any other is merged."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} bytes have no rank")
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.pairs = np.full(1 << 16, NONE, dtype=np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers, so a text's ids are joined without looking at each

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pre-tokens into ``known``, as many at once as TOGETHER bytes hold."""
        some, size = {}, 0
        for piece in pieces:
            data = piece.encode("utf-8")
            whole = self.ranks.get(data)
            if whole is not None:
                self.known[piece] = ID.pack(whole)
                continue
            some[piece] = data
            size += len(data)
            if size >= TOGETHER:
                self.keep(some)
                some, size = {}, 0
        if some:
            self.keep(some)

    def keep(self, some: dict[str, bytes]) -> None:
        found = merged(list(some.values()), self.ranks, self.pairs, self.queue)
        self.known.update(zip(some, map(memoryview.tobytes, found)))

    def texts(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, GROUP texts at a time; null counts as empty."""
        texts = iter(texts)
        while group := [self.split(t or "") for t in islice(texts, GROUP)]:
            if len(self.known) >= KEPT:
                self.known.clear()
            pieces = set().union(*group).difference(self.known)
            self.learn(pieces)
            known = self.known.__getitem__
            for split in group:
                yield np.frombuffer(b"".join(map(known, split)), dtype=np.int32)
            for piece in pieces:
                if len(piece) > KEPT_CHARS:
                    del self.known[piece]


class Decoder:
    """Ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: token for token, i in ranks.items()}

    def ids(self, ids) -> bytes:
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except KeyError as unknown:
            raise ValueError(f"{unknown} is no id of this vocabulary") from None


@lru_cache(2)
def _encoder(data: bytes, pattern: str) -> Encoder:
    """A worker reads a vocabulary once; the key is the file's content."""
    return Encoder(read_ranks(data), pattern)


@lru_cache(2)
def _decoder(data: bytes) -> Decoder:
    return Decoder(read_ranks(data))


class Vocabulary:
    """The columns that one rank file gives. The file is read on the driver and sent to each executor once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.data, self.pattern = spark.sparkContext.broadcast(Path(path).read_bytes()), pattern

    def encoded(self, text: str | Column) -> Column:
        """The ids of each whole text as an array of int; null counts as empty and gives no ids."""
        data, pattern = self.data, self.pattern

        @F.pandas_udf("array<int>")
        def each(texts: pd.Series) -> pd.Series:
            encoder = _encoder(data.value, pattern)
            return pd.Series(list(encoder.texts(texts)), dtype=object)

        return each(text)

    def decoded(self, ids: str | Column) -> Column:
        """The bytes of each array of ids; null gives null, an id that the vocabulary lacks fails the job."""
        data = self.data

        @F.pandas_udf("binary")
        def each(arrays: pd.Series) -> pd.Series:
            decoder = _decoder(data.value)
            return pd.Series([None if a is None else decoder.ids(a.tolist()) for a in arrays], dtype=object)

        return each(ids)

    def tokens(self, df: DataFrame, text: str) -> DataFrame:
        """The columns of ``df`` but ``text``, with `ids` as `encoded` gives them and `bytes`, what these ids decode to."""
        data, pattern = self.data, self.pattern

        def make(texts: list[str | None]) -> list[pa.Array]:
            ids, decoder = list(_encoder(data.value, pattern).texts(texts)), _decoder(data.value)
            return [array_column(ids, pa.int32()), pa.array([decoder.ids(i.tolist()) for i in ids], type=pa.binary())]

        return in_slices(df, text, "ids array<int>, bytes binary", make)


def document_tokens(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: the ids of the whole text, and what they decode to.

    A null text counts as empty: no ids, and the digests of nothing. Texts are not cut,
    however long they or their pre-tokens are. Each row is encoded on its own, so repeated
    rows give repeated results, null ids stay null and an empty table gives an empty
    result; columns other than doc_id and text are not read.
    """
    words = Vocabulary(documents.sparkSession, path, pattern)
    rows = words.tokens(documents.select("doc_id", "text"), "text")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
