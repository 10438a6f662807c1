"""Hard negatives by exact inner products: anchors in clusters walk shared lists of candidates.

The anchors are a stated query set. They are clustered by direction, and for each cluster the
candidates of a task are sorted once by a bound that holds for every member: the angle between
a candidate and the cluster's centre, less the cluster's own angle, is the least angle that any
member can have to it. Every member walks that list until the next bound is below what it
still needs. Scores are whole numbers, so results are exact, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.session import settle

AT_ONCE = 8192  # anchors sent to all tasks at once; further ones take another pass
MEMBERS = 64  # anchors of a cluster, on average
SHARD = 1 << 15  # candidates of a shared list; a task sorts its next candidates into the next list
FIRST_STEP, MOST_STEP = 256, 4096  # candidates a cluster scores at once: steps double
CLUSTER_ROUNDS = 6
SLACK = 1e-6  # relative; far above the rounding of bounds, so a walk never ends early
LEAST = np.iinfo(np.int64).min


def scaled(vector: str | Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of each component as an array of long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(label: str, vector: str) -> Column:
    """Whether a row has a label and a vector whose components are all finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, finite)


def matrix(vectors, width: int | None = None) -> np.ndarray:
    """Vectors as rows; those that are shorter than the longest end in zeros."""
    long = [len(v) for v in vectors]
    out = np.zeros((len(long), max(long, default=0) if width is None else width), dtype=np.int64)
    for row, v in zip(out, vectors):
        row[:min(len(v), len(row))] = v[:len(row)]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of rows of ``a`` and rows of ``b``, exactly; an error if 64 bits cannot hold them."""
    most = int(np.abs(a.astype(object)).max(initial=0)) * int(np.abs(b.astype(object)).max(initial=0)) * max(1, a.shape[1])
    if most >= 1 << 63:
        raise OverflowError("an inner product does not fit into 64 bits")
    if most < 1 << 53:  # every partial sum is a whole number that a double holds
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


@dataclass
class Cluster:
    """Anchors of like direction: their rows, their centre (of length one), and their greatest angle to it."""

    rows: np.ndarray
    centre: np.ndarray
    angle: float


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(rows.astype(np.float64)).sum(axis=1))


def angles(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The angle between each row and the centre; a zero row has angle 0."""
    long = lengths(rows)
    cosine = rows.astype(np.float64) @ centre / np.where(long > 0, long, 1)
    return np.where(long > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)


def clusters(vectors: np.ndarray, members: int = MEMBERS) -> list[Cluster]:
    """Clusters by direction: a few rounds of spherical means from evenly spaced anchors."""
    if not len(vectors):
        return []
    long = lengths(vectors)
    unit = vectors / np.where(long > 0, long, 1)[:, None]
    centres = unit[:: max(1, members)].copy()
    for _ in range(CLUSTER_ROUNDS):
        nearest = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        size = lengths(sums)
        centres = np.where(size[:, None] > 1e-9, sums / np.where(size > 1e-9, size, 1)[:, None], centres)
    nearest = np.argmax(unit @ centres.T, axis=1)
    out = []
    for c, centre in enumerate(centres):
        rows = np.flatnonzero(nearest == c)
        if not len(rows):
            continue
        if not centre.any():  # zero vectors only: any direction is as good
            centre = np.eye(1, max(1, vectors.shape[1]))[0][:vectors.shape[1]]
        out.append(Cluster(rows, centre, float(angles(vectors[rows], centre).max(initial=0.0))))
    return out


def shared_list(candidates: np.ndarray, cluster: Cluster) -> tuple[np.ndarray, np.ndarray]:
    """Candidates by falling bound, and the bounds: no member of length one has a greater product with them."""
    apart = np.maximum(angles(candidates, cluster.centre) - cluster.angle, 0.0)
    long = lengths(candidates)
    bound = long * np.cos(np.minimum(apart, np.pi)) + SLACK * long
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


class Best:
    """The first ``k`` (score, id) of each of ``n`` slots: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), LEAST, dtype=np.int64), np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.held = np.zeros(n, dtype=np.int64)
        self.k = k

    def worst(self) -> np.ndarray:
        """The score that a further entry must reach; the least number while a slot has room."""
        return np.where(self.held == self.k, self.scores[:, -1], LEAST)

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Entries (slot, score, id); a slot's entries may come in any order."""
        old = np.arange(self.k)[None, :] < self.held[:, None]
        mine = np.zeros(len(self.held), dtype=bool)
        mine[slots] = True
        old &= mine[:, None]
        at = np.nonzero(old)[0]
        slots, scores, ids = np.concatenate([at, slots]), np.concatenate([self.scores[old], scores]), np.concatenate([self.ids[old], ids])
        order = np.lexsort((ids, -scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        begins = np.flatnonzero(np.diff(slots, prepend=-1))
        place = np.arange(len(slots)) - np.repeat(begins, np.diff(np.append(begins, len(slots))))
        kept = place < self.k
        self.scores[slots[kept], place[kept]] = scores[kept]
        self.ids[slots[kept], place[kept]] = ids[kept]
        self.held[slots[begins]] = np.minimum(np.diff(np.append(begins, len(slots))), self.k)


@dataclass
class Anchors:
    """A bounded block of anchors. ``windows`` holds each anchor's positive scores, once these are known."""

    row: np.ndarray  # a number that names the anchor
    id: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    windows: np.ndarray | None = None  # anchors x positives; an absent positive is -1

    def __post_init__(self):
        self.clusters = clusters(self.vectors)
        self.lengths = lengths(self.vectors)


class Walk:
    """One task's walks: the best entries so far stay from list to list, so later walks end sooner."""

    def __init__(self, anchors: Anchors, k: int, least: int = 0, most: int = 0):
        self.anchors, self.least, self.most = anchors, least, most
        self.wide = 1 if anchors.windows is None else anchors.windows.shape[1]
        self.best = Best(len(anchors.row) * self.wide, k)

    def needs(self, rows: np.ndarray) -> np.ndarray:
        """What a score must reach, by member and slot, to change the member's entries; infinity if none can."""
        slots = (rows[:, None] * self.wide + np.arange(self.wide)).ravel()
        worst = self.best.worst()[slots].reshape(len(rows), self.wide).astype(np.float64)
        if self.anchors.windows is None:
            return worst
        positive = self.anchors.windows[rows]
        floor = np.where(positive >= 0, positive * (self.least / 100.0), np.inf)  # negative positives have an empty window
        return np.maximum(worst, floor)

    def over(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Walk the shared list of these candidates for every cluster."""
        for cluster in self.anchors.clusters:
            order, bound = shared_list(vectors, cluster)
            rows, at, step = cluster.rows, 0, FIRST_STEP
            while at < len(order):
                # a member ends, for certain, when the greatest score left is below all it needs
                reach = self.anchors.lengths[rows] * bound[at] + SLACK * (1 + np.abs(self.anchors.lengths[rows] * bound[at]))
                rows = rows[reach >= self.needs(rows).min(axis=1)]
                if not len(rows):
                    break
                taken = order[at:at + step]
                at, step = at + len(taken), min(2 * step, MOST_STEP)
                self.scored(rows, ids[taken], labels[taken], products(self.anchors.vectors[rows], vectors[taken]))

    def scored(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        alike = self.anchors.label[rows][:, None] == labels[None, :]
        other = self.anchors.id[rows][:, None] != ids[None, :]
        worst = self.best.worst()
        for slot in range(self.wide):
            slots = rows * self.wide + slot
            fits = scores >= worst[slots][:, None]
            if self.anchors.windows is None:
                fits &= alike & other
            else:
                positive = self.anchors.windows[rows, slot][:, None]
                fits &= ~alike & other & (positive >= 0)
                fits &= (100 * scores >= self.least * positive) & (100 * scores <= self.most * positive)
            r, c = np.nonzero(fits)
            if len(r):
                self.best.add(slots[r], scores[r, c], ids[c])

    def found(self) -> pd.DataFrame:
        held = np.arange(self.best.k)[None, :] < self.best.held[:, None]
        slots = np.nonzero(held)[0]
        return pd.DataFrame({
            "row": self.anchors.row[slots // self.wide], "slot": (slots % self.wide).astype(np.int32),
            "id": self.best.ids[held], "score": self.best.scores[held]})


FOUND = "row long, slot int, id long, score long"


def walked(candidates: DataFrame, blocks: Iterator[Anchors], k: int, least: int = 0, most: int = 0) -> DataFrame | None:
    """Each anchor's best entries within each task, as FOUND; candidates have id, label and vector.

    Candidates stay where they are: each pass reads them once against one block of anchors,
    which every executor receives. None if there are no anchors.
    """
    context, out = candidates.sparkSession.sparkContext, None
    for block in blocks:
        sent = context.broadcast(block)

        def walk(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            task = Walk(sent.value, k, least, most)
            width = sent.value.vectors.shape[1]
            for part in parts:
                for at in range(0, len(part), SHARD):
                    some = part.iloc[at:at + SHARD]
                    task.over(some["id"].to_numpy(np.int64), some["label"].to_numpy(np.int64), matrix(list(some["vector"]), width))
            yield task.found()

        each = candidates.mapInPandas(walk, FOUND)
        out = each if out is None else out.unionByName(each)
    return out


def first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` entries of each anchor and slot over all tasks, with their ``rank`` from 1."""
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def anchor_blocks(anchors: DataFrame, at_once: int, positives: DataFrame | None = None, width: int = 0) -> Iterator[Anchors]:
    """The anchors in blocks of ``at_once`` at most; ``row`` numbers them without gaps.

    Only one block is on the driver at a time. ``positives`` (row, rank, score) gives the
    windows; anchors without any positive are left out then.
    """
    most = anchors.agg(F.max("row")).first()[0]
    for begin in range(0, 0 if most is None else most + 1, at_once):
        within = (F.col("row") >= begin) & (F.col("row") < begin + at_once)
        block = anchors.where(within).orderBy("row").toPandas()
        windows = None
        if positives is not None:
            scores = positives.where(within).select("row", "rank", "score").toPandas()
            windows = np.full((len(block), width), -1, dtype=np.int64)
            place = np.searchsorted(block["row"].to_numpy(), scores["row"].to_numpy())
            windows[place, scores["rank"].to_numpy() - 1] = scores["score"]
            some = (windows >= 0).any(axis=1)
            block, windows = block[some], windows[some]
        if len(block):
            yield Anchors(
                block["row"].to_numpy(np.int64), block["id"].to_numpy(np.int64), block["label"].to_numpy(np.int64),
                matrix(list(block["vector"])), windows)


def numbered(anchors: DataFrame) -> DataFrame:
    """Settled anchors with ``row``, numbered without gaps: each range of ids counts on from those before it."""
    rows = settle(anchors.repartitionByRange("id").sortWithinPartitions("id").withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return settle(rows.join(starts, "_part").select("id", "label", "vector", (F.col("_at") - F.col("_first") + F.col("_before")).alias("row")))


def hard_negatives(candidates: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
                   at_once: int = AT_ONCE) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score) for frames of id, label and vector (array of long).

    An anchor's positives are its first ``positives`` candidates of its label; a positive's
    negatives are the first ``negatives`` candidates of other labels whose score is from
    ``least`` to ``most`` percent of the positive's. Higher scores come first, ties by
    smaller id. Candidates with the anchor's own id take no part for that anchor. Rows are
    numbered, not named by id, so repeated anchors give repeated results and repeated
    candidates count each. Vectors of different lengths meet as if the shorter ended in
    zeros. Scores that 64 bits cannot hold fail the job.
    """
    candidates, rows = settle(candidates), numbered(anchors)
    empty = candidates.sparkSession.createDataFrame([], FOUND)
    found = walked(candidates, anchor_blocks(rows, at_once), positives)
    best = settle(first(empty if found is None else found, positives))
    found = walked(candidates, anchor_blocks(rows, at_once, best, positives), negatives, least, most)
    hard = first(empty if found is None else found, negatives)
    of = best.select("row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    hard = hard.select("row", "slot", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    return hard.join(of, ["row", "slot"]).join(rows.select("row", F.col("id").alias("anchor")), "row").select(
        "anchor", "positive", "rank", "negative", "positive_score", "negative_score")


def mined(embeddings: DataFrame, every: int = 50, relabelled: int = 7, labels: int = 10, factor: float = 256.0, **how) -> DataFrame:
    """Hard negatives of ``embeddings`` (vec_id, embedding, label): the digest of the query.

    Rows without a label or vector, or with a component that is null or not finite, take no
    part, nor do rows without a vec_id, which nothing could name. Where vec_id divides by
    ``relabelled`` the label moves on by one of ``labels``. Anchors are the rows whose
    vec_id divides by ``every``. Other columns are not read; an empty table gives an empty
    result.
    """
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable("label", "embedding"))
    moved = F.when(F.col("vec_id") % relabelled == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long"))
    rows = rows.select(F.col("vec_id").alias("id"), moved.alias("label"), scaled("embedding", factor).alias("vector"))
    out = hard_negatives(rows, rows.where(F.col("id") % every == 0), **how)
    return out.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
        "positive_score", "negative_score")


MINED_SQL = """
WITH raw AS (
  SELECT vec_id, embedding,
    CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM raw),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
    CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 3
"""
