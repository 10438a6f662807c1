"""Byte-level BPE against the tiktoken library and against merging by plain search."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from estatelens.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def digests(rows):
    return sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows), key=repr)


def expected(library, rows):
    out = []
    for id_, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((id_, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def plainly_merged(piece, ranks):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_queue_gives_the_lowest_rank_and_its_positions_in_order():
    rng, queue, held = random.Random(1), bpe.RankQueue(300_000), {}
    for _ in range(4000):
        if held and rng.random() < 0.45:
            top = min(held)
            assert queue.lowest() == top and queue.take(top) == sorted(held.pop(top))
        else:
            rank = rng.choice([0, 63, 64, 4095, 4096, 262_143, 262_144, 299_999, rng.randrange(300_000)])
            position = rng.randrange(10 ** 6)
            held.setdefault(rank, []).append(position)
            queue.push(rank, position)
    while held:
        assert queue.take(queue.lowest()) == sorted(held.pop(min(held)))
    assert queue.lowest() is None and not queue.buckets and not any(map(any, queue.levels))


def test_merges_equal_plain_search_also_where_a_merge_allows_a_lower_rank():
    rng = random.Random(3)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        tokens = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(25)})
        rng.shuffle(tokens)  # a longer token may rank below its parts
        ranks |= {t: 256 + i for i, t in enumerate(tokens)}
        encoder = bpe.Encoder(ranks, r"\S+")
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60))) for _ in range(30)]
        found = bpe.merged(pieces, ranks, encoder.pairs, encoder.queue)
        assert [list(ids) for ids in found] == [plainly_merged(p, ranks) for p in pieces]


def test_texts_equal_the_library(library):
    encoder, rng = bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(5)
    alphabet = "abcdefgh  '\n\t0123.,!é漢字\U0001F600▁\x00\x1c\u3000\u0301АБВ"
    texts = ["", " ", "  a", "a  ", "it's  we'll\n\n x", "<|endoftext|>", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(900))]
    for text, ids in zip(texts, encoder.texts(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe.Decoder(RANKS).ids(ids.tolist()) == text.encode()


def test_long_pre_tokens(library):
    rng = random.Random(7)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    texts = ["x" * 30_000, " " * 20_000, "".join(rng.choice("abcdefghijklmnop") for _ in range(600_000)), "漢" * 5_000, "=-" * 9_000]
    assert [ids.tolist() for ids in encoder.texts(texts)] == [library.encode_ordinary(t) for t in texts]
    assert not any(len(k) > bpe.KEPT_CHARS for k in encoder.known)


def test_what_is_remembered_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    monkeypatch.setattr(bpe, "GROUP", 2)
    monkeypatch.setattr(bpe, "TOGETHER", 16)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    texts = [f"wordy{i} others{i % 7}" for i in range(50)]
    assert [ids.tolist() for ids in encoder.texts(texts)] == [library.encode_ordinary(t) for t in texts]
    assert len(encoder.known) <= 5 + 4


def test_awkward_rows_and_clashing_columns(spark, library):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (4, "one two"), (None, "é\U0001F600"), (None, None), (5, "alpha beta, gamma " * 9000)]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, ids int, bytes string, n_tokens double")
    found = bpe.document_tokens(docs, PATH, public_tokenizers.PATTERN)
    assert digests(found.collect()) == expected(library, rows)
    assert bpe.document_tokens(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_columns_round_trip_and_unknown_ids(spark):
    words = bpe.Vocabulary(spark, PATH, public_tokenizers.PATTERN)
    docs = spark.createDataFrame([("naïve café\r\n",), ("",), (None,)], "t string")
    rows = docs.select("t", words.encoded("t").alias("ids")).select("t", words.decoded("ids").cast("string").alias("back")).collect()
    assert [r["back"] for r in rows] == ["naïve café\r\n", "", ""]
    bad = spark.createDataFrame([([60_000],), (None,)], "ids array<int>")
    assert bad.where("ids is null").select(words.decoded("ids").alias("b")).first()["b"] is None
    with pytest.raises(Exception, match="no id of this vocabulary"):
        bad.select(words.decoded("ids")).collect()
    with pytest.raises(ValueError, match="have no rank"):
        bpe.Encoder({b"a": 0}, public_tokenizers.PATTERN)


def test_the_query_equals_the_library(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert digests(queries.QUERIES["op11_byte_bpe"](spark, folder).collect()) == expected(library, docs)


def test_known_pieces_are_kept_as_packed_ids():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    texts = ["the cat, the hat", "", None, "qzxv qzxv the"]
    found = list(encoder.texts(texts))
    assert [f.dtype for f in found] == [np.int32] * 4 and [len(f) for f in found][1:3] == [0, 0]
    for text, ids in zip(texts, found):
        pieces = regex.findall(public_tokenizers.PATTERN, text or "")
        assert ids.tolist() == [i for p in pieces for i in plainly_merged(p.encode(), RANKS)]
        assert all(isinstance(encoder.known[p], bytes) and len(encoder.known[p]) % 4 == 0 for p in pieces)
