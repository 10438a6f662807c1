"""Token alignment against brute force over byte offsets."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from estatelens.llm import alignment, queries

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """The rows of the query: every offset compared, every pair of a group written out."""
    whole = Tokenizer.from_file(FILES[0])
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    inverse = alignment.byte_level_bytes()
    assert len(inverse) == 256 and sorted(inverse.values()) == list(range(256))

    def bytes_a(i):
        return bytes(inverse[c] for c in whole.id_to_token(i))

    def bytes_b(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for id_, text in rows:
        a = whole.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode(text or "")
        want = (" " + (text or "")).encode()
        if not text or b"".join(map(bytes_a, a)) != want or b"".join(map(bytes_b, b)) != want:
            docs.append((id_, [], [], []))
            continue
        ends = lambda ids, of: np.cumsum([len(of(i)) for i in ids]).tolist()
        ea, eb = ends(a, bytes_a), ends(b, bytes_b)
        groups, start = [], 0
        for cut in sorted(set(ea) & set(eb)):
            groups.append(([i for i, e in zip(a, ea) if start < e <= cut], [i for i, e in zip(b, eb) if start < e <= cut]))
            start = cut
        docs.append((id_, a, b, groups))
    counts = Counter(p for _, _, _, groups in docs for p in {(i, j) for x, y in groups for i in x for j in y})
    top = {}
    for (i, _), n in counts.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for id_, a, b, groups in docs:
        pairs = [(i, j) for x, y in groups for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((id_, len(a), len(b), len(groups), len(pairs), sum(counts[p] == top[p[0]] for p in pairs), sum(counts[p] for p in pairs),
                    hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def found(frame):
    assert frame.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_gallop_equals_intersection():
    rng = random.Random(1)
    for _ in range(400):
        top = rng.choice([5, 50, 5000])
        short, long = (sorted(rng.sample(range(top), rng.randint(0, min(top, n)))) for n in (20, 300))
        x, y = alignment.gallop(short, long)
        both = sorted(set(short) & set(long))
        assert [short[i - 1] for i in x] == both == [long[i - 1] for i in y]
        x, y = alignment.common_ends(long, short)
        assert [long[i - 1] for i in x] == both == [short[i - 1] for i in y]


def test_gallop_compares_few_numbers():
    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return list.__getitem__(self, i)

    long = Counted(range(100_000))
    assert alignment.gallop([10, 50_000, 99_999], long) == ([1, 2, 3], [11, 50_001, 100_000])
    assert Counted.reads < 150


def test_wide_groups_count_like_slim_ones(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(50):
        x, y = rng.integers(0, 9, 60).astype(np.int32), rng.integers(0, 9, 40).astype(np.int32)
        cuts = rng.integers(1, 6)
        to_x = np.append(np.sort(rng.choice(np.arange(1, 60), cuts, replace=False)), 60)
        to_y = np.append(np.sort(rng.choice(np.arange(1, 40), cuts, replace=False)), 40)
        want = Counter()
        for i, k, j, m in zip(np.append(0, to_x), to_x, np.append(0, to_y), to_y):
            want.update((int(p), int(q)) for p in x[i:k] for q in y[j:m])
        for wide in (1, 50, 1 << 12):
            monkeypatch.setattr(alignment, "WIDE", wide)
            a, b, n = alignment.linked(x, y, to_x, to_y)
            assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == want and (np.diff(a << 32 | b) > 0).all()


def test_merging_by_rank_is_the_merge_list():
    data = open(FILES[0], encoding="utf-8").read()
    assert alignment.merges_by_rank(data)
    side, rng = alignment.ByteLevel(data, public_tokenizers.PATTERN, by_rank=True), random.Random(5)
    alphabet = "abcdefgh    '\n\t0123.,!é漢字\U0001F600\x00\x1c\u3000\u0301АБВﬁ"
    texts = ["<|endoftext|>", "a<|endoftext|> b", "a ", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 150))) for _ in range(600))]
    for text in [*texts, *("".join(rng.choice("abcdeinorst") for _ in range(200)) for _ in range(600))]:
        assert side.encoded(text) == side.whole.encode(" " + text, add_special_tokens=False).ids
    assert len(side.encoded(" " * 500_000 + "a")) == 500_001


def test_merge_lists_that_ranks_do_not_give_are_told_apart():
    def said(merges, tokens):
        vocabulary = {c: b for c, b in alignment.byte_level_bytes().items()} | {t: 256 + i for i, t in enumerate(tokens)}
        return alignment.merges_by_rank(json.dumps({"model": {"vocab": vocabulary, "merges": merges}}))

    assert said([["b", "c"], ["a", "bc"]], ["bc", "abc"]) and said(["b c", "a bc"], ["bc", "abc"])
    assert not said([["a", "b"], ["b", "c"], ["a", "bc"]], ["ab", "bc", "abc"])  # ranks reach abc from ab
    assert not said([["a", "b"], ["b", "c"]], ["bc", "ab"])  # not in the order of ids


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "one two"), (4, "one two"), (None, "naïve café\r\n\tx"), (None, None), (5, "a▁b"), (6, "<|endoftext|> </s> <s> <0x41>"),
    (7, "漢字\U0001F600́ mixed 12,345.67"), (8, "\x00\x01 control"), (9, "word " * 4000 + "x" * 3000), (10, "  lead\n\n\n  and   trail  "), (11, "ﬁ ① 　 ½")]


def test_awkward_rows_clashing_columns_and_both_joins(spark):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS], "doc_id long, text string, row int, a string, salt int")
    want = brute(ROWS)
    for sent in (alignment.SENT_ROWS, 0):
        assert found(alignment.document_alignment(docs, *FILES, public_tokenizers.PATTERN, sent_rows=sent)) == want
    assert alignment.document_alignment(docs.limit(0), *FILES, public_tokenizers.PATTERN).count() == 0


def test_the_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.QUERIES["op13_token_alignment"](spark, folder)) == brute(rows)


def test_alignments_slice_the_tokens(spark):
    both = alignment.Tokenizers(spark, *FILES, public_tokenizers.PATTERN)
    rows = both.alignments(spark.createDataFrame(ROWS, "doc_id long, text string"), "text").collect()
    for r in rows:
        assert len(r["a_ends"]) == len(r["b_ends"]) and (not r["a"] or (r["a_ends"][-1], r["b_ends"][-1]) == (len(r["a"]), len(r["b"])))
