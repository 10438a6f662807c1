"""Toxicity by the nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.quality import fold
from estatelens.session import settle

EXAMPLES = 4000  # labelled examples of each class in the index, at most
TERMS = 1500  # terms of the index, at most
LEAST_G = 15.0  # log-likelihood ratio by which a term must be more frequent in toxic examples
LEAST_LIFT = 4.0  # times by which its share of toxic examples must exceed that of the others
PREFIXES = (4, 5, 6)  # word beginnings that are terms besides whole words, so inflected words meet
NEIGHBOURS = 15
BLOCK = 64
POWER = 3  # of the cosine in a vote, so that far examples hardly count
SMOOTHING = 1.0  # votes that the class share without any term counts for
REMEMBERED = 20_000  # vectors whose result a task keeps
WORDS = re.compile(r"\w+")


def term_counts(text: str | None) -> dict[str, int]:
    """Words of the whole lower-cased text and their beginnings (marked by a trailing star)."""
    words: dict[str, int] = {}
    for w in WORDS.findall((text or "").lower()):
        words[w] = words.get(w, 0) + 1
    out = dict(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                p = w[:k] + "*"
                out[p] = out.get(p, 0) + n
    return out


def distinct_terms(text: str | Column) -> Column:
    @F.pandas_udf("array<string>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([list(term_counts(t)) for t in texts])

    return each(text)


def vectors(text: str | Column, vocabulary: dict[str, int]) -> Column:
    """Counts of the vocabulary's terms as [term, count, term, count, ...], terms ascending."""
    words = {t for t in vocabulary if not t.endswith("*")}
    stems = {t[:-1]: i for t, i in vocabulary.items() if t.endswith("*")}

    def one(t: str | None) -> list[int]:
        counts: dict[int, int] = {}
        for w in WORDS.findall((t or "").lower()):
            if w in words:
                counts[vocabulary[w]] = counts.get(vocabulary[w], 0) + 1
            for k in PREFIXES:
                if len(w) > k and (i := stems.get(w[:k])) is not None:
                    counts[i] = counts.get(i, 0) + 1
        return [x for pair in sorted(counts.items()) for x in pair]

    @F.pandas_udf("array<int>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts])

    return each(text)


@dataclass
class Index:
    """A block-max inverted index over unit vectors of the labelled examples."""

    idf: np.ndarray
    starts: np.ndarray  # terms x blocks + 1: where the term's postings of the block begin
    examples: np.ndarray  # of the postings, by term and ascending
    weights: np.ndarray
    bounds: np.ndarray  # terms x blocks: the largest weight of the term in the block
    ids: np.ndarray
    toxic: np.ndarray
    share: np.ndarray  # rows of the class that each example stands for
    empty: float  # toxic share of examples without any term

    @classmethod
    def built(cls, rows: list[tuple[int, list[int], int]], idf: np.ndarray, share: dict[int, float]) -> Index:
        rows = sorted(rows, key=lambda r: (r[1][::2], r[2], r[0]))  # alike examples share blocks, which makes bounds tight
        n = len(rows)
        owner = np.concatenate([np.full(len(r[1]) // 2, i) for i, r in enumerate(rows)] or [np.zeros(0)]).astype(np.int64)
        term = np.concatenate([np.array(r[1][::2]) for r in rows] or [np.zeros(0)]).astype(np.int64)
        count = np.concatenate([np.array(r[1][1::2]) for r in rows] or [np.zeros(0)]).astype(np.float64)
        weight = (1 + np.log(np.maximum(count, 1))) * idf[term]
        norm = np.sqrt(np.bincount(owner, weights=weight ** 2, minlength=n))
        weight = weight / norm[owner] if n else weight
        by = np.lexsort((owner, term))
        owner, term, weight = owner[by], term[by], weight[by]
        n_blocks = -(-max(n, 1) // BLOCK)
        edges = (np.arange(len(idf))[:, None] * n_blocks + np.arange(n_blocks + 1)).astype(np.int64)
        starts = np.searchsorted(term * n_blocks + owner // BLOCK, edges).astype(np.int32)
        bounds = np.zeros((len(idf), n_blocks))
        np.maximum.at(bounds, (term, owner // BLOCK), weight)
        toxic = np.array([r[2] for r in rows], dtype=np.float64)
        per = np.array([share[r[2]] for r in rows], dtype=np.float64)
        without = np.array([not r[1] for r in rows], dtype=bool)
        empty = float((toxic * per)[without].sum() / max(per[without].sum(), 1e-9)) if n else 0.0
        return cls(idf, starts, owner, weight, bounds, np.array([r[0] for r in rows], dtype=np.int64), toxic, per, empty)

    def nearest(self, vector: list[int], k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k nearest examples as (cosine, example), exactly; ties go to the lower example.

        Blocks are taken by descending bound until no block left can hold a nearer example.
        """
        if not vector:
            return []
        terms, counts = np.array(vector[::2]), np.array(vector[1::2], dtype=np.float64)
        q = (1 + np.log(counts)) * self.idf[terms]
        q /= math.sqrt(q @ q)
        bound = q @ self.bounds[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 1e-12]
        near, at, step = np.zeros((0, 2)), 0, 1
        while at < len(order) and not (len(near) == k and bound[order[at]] < -near[-1, 0] - 1e-12):
            taken = order[at:at + step]  # steps double, so bounds that do not prune cost few rounds
            at, step = at + len(taken), 2 * step
            lo, hi = self.starts[terms][:, taken].ravel(), self.starts[terms][:, taken + 1].ravel()
            long = hi - lo
            place = np.repeat(lo - np.concatenate([[0], np.cumsum(long)[:-1]]), long) + np.arange(long.sum())
            found, which = np.unique(self.examples[place], return_inverse=True)
            sums = np.bincount(which, weights=np.repeat(np.repeat(q, len(taken)), long) * self.weights[place], minlength=len(found))
            near = np.concatenate([near, np.stack([-np.round(sums, 12), found], axis=1)])
            near = near[np.lexsort((near[:, 1], near[:, 0]))][:k]
        best = [(s, int(e)) for s, e in near.tolist()]
        return [(-s, e) for s, e in best]

    def score(self, vector: list[int]) -> tuple[float, list[tuple[float, int]]]:
        """Votes weighted by similarity and by what each example stands for, and the evidence."""
        near = self.nearest(vector)
        yes, every = SMOOTHING * self.empty, SMOOTHING
        scale = sum(self.share[e] for _, e in near) / len(near) if near else 1
        for s, e in near:
            vote = s ** POWER * self.share[e] / scale
            yes += vote * self.toxic[e]
            every += vote
        return round(yes / every, 6), near


def labelled(labels: DataFrame, held: int = 0, folds: int = 5) -> DataFrame:
    """(doc_id, toxic) of the rows outside the held-out fold; ids with both labels are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", folds) != held))
    one = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    return one.where("toxic = _most and toxic in (0, 1)").drop("_most")


def selected_terms(texts: DataFrame) -> dict[str, int]:
    """Terms that toxic examples hold more often, numbered; ``texts`` has text and toxic."""
    held = texts.select("toxic", F.explode(distinct_terms("text")).alias("term"))
    counts = held.groupBy("term").agg(F.sum("toxic").alias("yes"), F.count("*").alias("n"))
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}
    base = n1 / (n1 + n0)
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * p))).otherwise(0.0)
    g = 2 * (part(F.col("yes"), base) + part(F.col("n") - F.col("yes"), 1 - base))
    lift = (F.col("yes") + 0.5) / (n1 + 1) / ((F.col("n") - F.col("yes") + 0.5) / (n0 + 1))
    kept = counts.withColumn("g", F.round(g, 6)).where((lift >= LEAST_LIFT) & (F.col("g") >= LEAST_G))
    rows = kept.orderBy(F.desc("g"), "term").limit(TERMS).select("term").collect()
    return {r["term"]: i for i, r in enumerate(rows)}


def scored(docs: DataFrame, examples: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, evidence) for each row of ``docs``; ``examples`` has id and toxic (0 or 1).

    At most EXAMPLES labelled documents of each class, drawn by a hash of their id, make the
    index; votes are weighted so that each class counts by its full size. Terms are chosen on
    the examples; how many documents hold a term is counted over all documents. A document
    without any of the terms gets the toxic share of such examples. ``evidence`` lists the
    nearest examples as (cosine, id, toxic).
    """
    spark = docs.sparkSession
    drawn = F.xxhash64(F.lit(11).cast("long"), id_)
    counts = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = None
    for label in (0, 1):
        part = examples.where(F.col("toxic") == label).orderBy(drawn, id_).limit(EXAMPLES)
        sample = part if sample is None else sample.unionByName(part)
    sample = settle(sample.select(F.col(id_).alias("_example"), "toxic"))
    texts = docs.select(F.col(id_).alias("_id"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("_id") == F.col("_example"))
    vocabulary = selected_terms(settle(texts.select("text", "toxic").dropDuplicates()))
    rows = settle(docs.select(F.col(id_).alias("_id"), vectors(text, vocabulary).alias("vector")))
    total = rows.count()
    held = rows.select(F.explode(F.expr("filter(vector, (x, i) -> i % 2 = 0)")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    df = np.zeros(len(vocabulary))
    for r in held.collect():  # a row for each term of the vocabulary
        df[r["term"]] = r["n"]
    idf = np.log((total + 1) / (df + 1)) + 1e-3
    known = rows.join(F.broadcast(sample), F.col("_id") == F.col("_example")).select("_id", "vector", "toxic")
    known = known.dropDuplicates(["_id"]).collect()  # twice EXAMPLES rows at most
    size = {label: max(1, sum(r["toxic"] == label for r in known)) for label in (0, 1)}
    share = {label: counts.get(label, 0) / size[label] for label in (0, 1)}
    index = spark.sparkContext.broadcast(Index.built([(r["_id"], list(r["vector"]), r["toxic"]) for r in known], idf, share))

    @F.pandas_udf("score double, near array<struct<cosine:double,id:long,toxic:int>>")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held, seen = index.value, {}
        for part in parts:
            out = []
            for v in part:
                key = tuple(v)
                if key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    score, near = held.score(list(key))
                    seen[key] = score, [{"cosine": s, "id": int(held.ids[e]), "toxic": int(held.toxic[e])} for s, e in near]
                out.append(seen[key])
            yield pd.DataFrame({"score": [s for s, _ in out], "near": [n for _, n in out]})

    return rows.withColumn("_out", each("vector")).select(F.col("_id").alias(id_), F.col("_out.score").alias("score"), F.col("_out.near").alias("evidence"))


def document_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for each document.

    Examples are labelled rows outside the fold crc32(doc_id) mod 5 = 0. Null and empty
    texts have no terms; null ids are scored but are no examples; repeated rows are scored
    alike. Without examples of both classes every score is the share of toxic examples
    without any term, or 0.
    """
    out = scored(documents.select("doc_id", "text"), labelled(labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
