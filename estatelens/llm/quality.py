"""Quality scores learnt from trusted positives and unlabelled text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.session import settle

BINS = 400  # of the score histograms
RIDGE = 5e-4  # plus 1 / number of positives
LEAST_TAIL = 0.3  # share of positives in the tails that the prior is read from
SURE = 2.0  # standard errors added to each tail's ratio
SLOPES = np.geomspace(1, 40, 40)
STEPS = 300

# --- features -------------------------------------------------------------------------

_CLASSES = 9
_CLASS = np.full(256, 7, dtype=np.int64)  # 7: other ASCII signs
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[ord(c) for c in " \t"]] = 3
_CLASS[[ord(c) for c in "\n\r\x0b\x0c"]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[[ord(c) for c in "!"]] = 6
_CLASS[128:] = 8  # bytes of letters outside ASCII, mostly
N_RAW = _CLASSES * _CLASSES + 8
N_FEATURES = 2 * N_RAW + 1


def raw_features(text: str | None) -> np.ndarray:
    """Shares of character-class pairs, and how varied and how long words and lines are."""
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(N_RAW, dtype=np.float32)
    if not data:
        return out
    kinds = _CLASS[np.frombuffer(data, dtype=np.uint8)]
    pairs = np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=_CLASSES * _CLASSES)
    out[:_CLASSES * _CLASSES] = pairs / max(1, len(data) - 1)
    tokens = data.split()
    n = max(1, len(tokens))
    lines = [x for x in data.split(b"\n") if x.strip()]
    thirds = {b" ".join(tokens[i:i + 3]) for i in range(len(tokens) - 2)}
    out[-8:] = (
        min(1, len(data) / n / 20), len(set(tokens)) / n, len(thirds) / max(1, len(tokens) - 2), len(set(lines)) / max(1, len(lines)),
        min(1, np.log1p(n) / 10), min(1, len(data) / max(1, len(lines)) / 1000), sum(len(t) > 25 for t in tokens) / n, 1.0)
    return out


def features(text: str | Column) -> Column:
    """The raw features of whole texts; null counts as empty."""

    @F.pandas_udf("array<float>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([raw_features(t) for t in texts])

    return each(text)


def expanded(raw: np.ndarray) -> np.ndarray:
    """Features and their square roots, which tell rare from absent, and a constant."""
    raw = raw.astype(np.float64)
    return np.concatenate([raw, np.sqrt(np.maximum(raw, 0)), np.ones((len(raw), 1))], axis=1)


# --- learning -------------------------------------------------------------------------


@dataclass
class Moments:
    """Mean vectors and mean products of the features of positives and of all texts."""

    positive: np.ndarray
    positive2: np.ndarray
    all: np.ndarray
    all2: np.ndarray
    ridge: float


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    prior: float

    def score(self, raw: np.ndarray) -> np.ndarray:
        return np.round(sigmoid(self.slope * (expanded(raw) @ self.weights)), 6)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def moments(rows: DataFrame, batch: int = 4096) -> Moments | None:
    """Moments over all rows; ``rows`` has ``raw`` and ``positive``. None without positives.

    Each task adds up its own rows and hands on one number for each pair of features, so
    what is shuffled does not depend on how many rows a task has.
    """

    def sums(parts):
        total = {}
        for part in parts:
            raw = np.stack(part["raw"].to_numpy()) if len(part) else np.zeros((0, N_RAW))
            x, p = expanded(raw), part["positive"].to_numpy(dtype=bool)
            for name, rows_ in ((0, x), (1, x[p])):
                first, second = total.get(name, (0, 0))
                total[name] = first + rows_.sum(0), second + rows_.T @ rows_
        up = np.triu_indices(N_FEATURES)
        for name, (first, second) in total.items():
            yield pd.DataFrame({"of": name, "i": -1, "j": np.arange(N_FEATURES), "v": first})
            yield pd.DataFrame({"of": name, "i": up[0], "j": up[1], "v": second[up]})

    added = rows.select("raw", "positive").mapInPandas(sums, "of int, i int, j int, v double").groupBy("of", "i", "j").agg(F.sum("v").alias("v"))
    got = added.toPandas()  # a fixed number of rows: two sets of pairs of features
    out = []
    for name in (1, 0):
        own = got[got["of"] == name]
        first, second = np.zeros(N_FEATURES), np.zeros((N_FEATURES, N_FEATURES))
        one, two = own[own["i"] < 0], own[own["i"] >= 0]
        first[one["j"]] = one["v"]
        second[two["i"], two["j"]] = two["v"]
        second[two["j"], two["i"]] = two["v"]
        n = first[-1]  # the constant feature counts rows
        if not n:
            return None
        out += [first / n, second / n]
        if name:
            ridge = RIDGE + 1 / n
    return Moments(*out, ridge)


def non_negative_fit(m: Moments, prior: float) -> np.ndarray:
    """Weights of least non-negative positive-unlabelled risk under the squared loss.

    With loss (1 - z)^2 / 4 the risk of a linear score needs the moments only. The unbiased
    risk has its least value at the solution of a linear system. Where the part that stands
    for the negatives, E_all - prior * E_positive, falls below zero the fit is to noise:
    from there gradient steps raise it while it is negative and lower the whole risk
    otherwise, and the weights of the least non-negative risk are kept.
    """
    ridge = m.ridge * np.eye(N_FEATURES)
    w = np.linalg.solve(m.all2 + ridge, 2 * prior * m.positive - m.all)

    def parts(w):
        positive = prior * (1 - 2 * w @ m.positive + w @ m.positive2 @ w) / 4
        negative = (1 + 2 * w @ m.all + w @ m.all2 @ w - prior * (1 + 2 * w @ m.positive + w @ m.positive2 @ w)) / 4
        return positive, negative

    def risk(w):
        positive, negative = parts(w)
        return positive + max(0.0, negative) + m.ridge * w @ w / 4

    if parts(w)[1] >= 0:
        return w
    rate = 1 / max(1e-9, np.linalg.eigvalsh(m.all2 + ridge)[-1])
    best, least = w, risk(w)
    for _ in range(STEPS):
        down_positive = prior * (-m.positive + m.positive2 @ w) / 2
        down_negative = (m.all + m.all2 @ w - prior * (m.positive + m.positive2 @ w)) / 2
        w = w + rate * down_negative if parts(w)[1] < 0 else w - rate * (down_positive + down_negative + m.ridge * w / 2)
        if risk(w) < least:
            best, least = w, risk(w)
    return best


def histograms(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin centres of the linear score, and the counts of all rows and of positives in them."""

    @F.pandas_udf("int")
    def bin_(raw: pd.Series) -> pd.Series:
        g = expanded(np.stack(raw.to_numpy())) @ weights
        return pd.Series(np.clip(np.floor((g + 2) / 4 * BINS), 0, BINS - 1).astype("int32"))

    counted = rows.select(bin_("raw").alias("bin"), "positive").groupBy("bin").agg(
        F.count("*").alias("n"), F.count_if("positive").alias("p")).toPandas()
    every, positive = np.zeros(BINS), np.zeros(BINS)
    every[counted["bin"]], positive[counted["bin"]] = counted["n"], counted["p"]
    return (np.arange(BINS) + 0.5) / BINS * 4 - 2, every, positive


def class_prior(every: np.ndarray, positive: np.ndarray) -> float:
    """The share of positives among all texts: the least ratio of both sets' upper tails.

    All texts hold positives in proportion to the prior plus negatives, so each upper tail
    of the score bounds the prior from above, and tails free of negatives meet it. Each
    ratio is raised by its sampling error, else the least of many would be too low.
    """
    tail_all, tail_pos = np.cumsum(every[::-1]), np.cumsum(positive[::-1])
    usable = tail_pos >= LEAST_TAIL * positive.sum()
    a, p = tail_all[usable], tail_pos[usable]
    share_a, share_p = a / every.sum(), p / positive.sum()
    error = np.sqrt((1 - share_p) / p + (1 - share_a) / a)
    return float(np.clip((share_a / share_p * (1 + SURE * error)).min(), 0.01, 0.99))


def calibrated_slope(centres: np.ndarray, every: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The slope of a logistic link of least non-negative risk under the log loss.

    The linear score estimates 2 P(positive) - 1, so its zero is even odds and stays there.
    """
    p_all, p_pos = every / every.sum(), positive / positive.sum()

    def risk(slope):
        s = np.clip(sigmoid(slope * centres), 1e-4, 1 - 1e-4)
        negative = p_all @ -np.log(1 - s) - prior * (p_pos @ -np.log(1 - s))
        return prior * (p_pos @ -np.log(s)) + max(0.0, negative)

    return float(min(SLOPES, key=risk))


def trained(rows: DataFrame) -> Model | None:
    """The model of rows with ``raw`` features and ``positive`` flags; None without positives."""
    m = moments(rows)
    if m is None:
        return None
    prior = 0.5
    for _ in range(2):
        _, every, positive = histograms(rows, non_negative_fit(m, prior))
        prior = class_prior(every, positive)
    weights = non_negative_fit(m, prior)
    return Model(weights, calibrated_slope(*histograms(rows, weights), prior), prior)


def fold(id_: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit("")).cast("binary")) % n


def learnt(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[DataFrame, Model | None]:
    """The documents' settled features and the model; positives are the ids in ``labels``."""
    known = labels.select(F.col("doc_id").alias("_known")).distinct()
    raw = docs.select("doc_id", features(text).alias("raw"))
    rows = settle(raw.join(known, F.col("doc_id") == F.col("_known"), "left").select("doc_id", "raw", F.col("_known").isNotNull().alias("positive")))
    return rows, trained(rows)


def trusted(labels: DataFrame, held: int = 2, folds: int = 4) -> DataFrame:
    """Ids labelled good, and only good, outside the held-out fold."""
    rows = labels.where(F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    return rows.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def _scorer(model: Model | None):
    @F.pandas_udf("double")
    def each(raw: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(raw.to_numpy())) if model else np.full(len(raw), 0.5))

    return each


def document_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document.

    Positives come from labels outside the fold crc32(doc_id) mod 4 = 2; every document,
    labelled or not, is unlabelled text. Moments, prior and calibration use all rows. The
    score is the calibrated chance of label 1 from the text alone. Null texts count as
    empty; a null doc_id is not held out and has no label; ids with contradicting labels
    are no positives; repeated rows are scored alike. Without any positive nothing can be
    learnt and each score is 0.5.
    """
    rows, model = learnt(documents.select("doc_id", "text"), trusted(labels))
    score = _scorer(model)
    return rows.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score("raw").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score reaches ``threshold``; all of them if nothing could be learnt."""
    _, model = learnt(docs.select("doc_id", "text"), trusted(labels))
    if model is None:
        return docs
    score = _scorer(model)
    return docs.where(score(features("text")) >= threshold)
