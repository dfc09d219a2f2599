"""Quality classifier: ordinal cumulative-link regression on graded ratings, with hashed text features."""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hashed features.
BUCKETS = 1 << 18
#: Rated documents of a grade that the fit may read at most; the ones with the least hashes of their ids.
SAMPLE_A_GRADE = 3000
#: A feature takes part if it is in enough sampled documents and moves their mean grade by so many standard errors.
LEAST_SHARE, LEAST_DOCS, LEAST_Z = 0.003, 3, 5.0
ROUNDS, RATE, RIDGE = 1000, 0.3, 1e-5
#: A document is kept if its chance of the best grade is at least that.
KEEP_FROM = 0.5

_MARKS = string.punctuation.encode()
#: Hashes of ids fall on so many places.
_PLACES = 1 << 62


#: Shares of a text count as features from these values on.
STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_FIELD, _NONE = 20, (1 << 20) - 1


class _Features(dict):
    """Buckets of a word in one number: of its letters, of the first four of them, and of the marks behind them if two or more."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        core = word.strip(_MARKS)
        tail = word[len(word.rstrip(_MARKS)) :]
        own, start, marks = (xxhash.xxh3_64_intdigest(x, n) % BUCKETS for n, x in enumerate((core, core[:4], tail)))
        out = self[word] = (own << 2 * _FIELD) | (start << _FIELD) | (marks if len(tail) > 1 else _NONE)
        return out


def features(text: str | None, seen: _Features) -> np.ndarray:
    """Sorted distinct buckets of a text: its words in lower case, their starts, trailing marks, and coarse shares of the whole; none for no words."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    packed = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    again = (packed[1:] == packed[:-1]).sum() / len(packed)
    distinct, times = np.unique(packed, return_counts=True)
    core, start, marks = distinct >> 2 * _FIELD, (distinct >> _FIELD) & _NONE, distinct & _NONE
    letters = np.frombuffer(raw, np.uint8)
    shares = (
        ((letters >= 65) & (letters <= 90)).mean(),  # capitals
        again,  # words said again at once
        times[marks != _NONE].sum() / len(packed),  # words with marks behind them
        times[core == seen[b"|"] >> 2 * _FIELD].sum() / len(packed),  # nothing but marks
        1 - len(distinct) / len(packed) if len(packed) > 50 else 0.0,
    )
    coarse = [10 * k + j for k, v in enumerate(shares) for j in range(int((STEPS <= v).sum()))]  # the first buckets, shared with few words
    return np.unique(np.concatenate([core, start, marks[marks != _NONE], np.array(coarse, np.int64)]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - sum of the weights of a document's buckets)."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.weights = np.zeros(BUCKETS, np.float32)
        self.weights[buckets] = weights
        self.thresholds = thresholds

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """Chance of each grade, a row a document."""
        below = _sigmoid(self.thresholds[None, :] - scores[:, None])
        return np.diff(np.hstack([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))]), axis=1)


def fit(rows: list[np.ndarray], grades: np.ndarray, share: np.ndarray) -> OrdinalModel:
    """The model of sampled documents: their buckets, their grades 0.. and the share of each grade among all rated ones."""
    n, k = len(rows), len(share)
    at, feature = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    weight = (share / np.maximum(np.bincount(grades, minlength=k), 1))[grades]
    weight = weight / weight.sum()
    df = np.bincount(feature, minlength=BUCKETS)
    mean, spread = grades.mean(), grades.std() or 1.0
    moved = np.abs(np.bincount(feature, grades[at], BUCKETS) / np.maximum(df, 1) - mean) * np.sqrt(df) / spread
    chosen = np.nonzero((df >= max(LEAST_DOCS, LEAST_SHARE * n)) & (df < n) & (moved >= LEAST_Z))[0]
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    own = column[feature] >= 0
    at, column = at[own], column[feature[own]]
    below = np.clip(np.cumsum(share)[:-1], 1e-4, 1 - 1e-4)
    first, gaps = np.log(below[0] / (1 - below[0])), np.log(np.maximum(np.diff(np.log(below / (1 - below))), 1e-3))
    theta = np.concatenate([[first], gaps])  # the first threshold and the logarithms of the steps, so they stay in order
    w, sums = np.zeros(len(chosen)), np.full(len(chosen) + len(theta), 1e-8)
    for _ in range(ROUNDS):
        thresholds = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])
        score = np.bincount(at, w[column], n)
        upto = np.hstack([np.zeros((n, 1)), _sigmoid(thresholds[None, :] - score[:, None]), np.ones((n, 1))])
        hi, lo = upto[np.arange(n), grades + 1], upto[np.arange(n), grades]
        p = np.maximum(hi - lo, 1e-12)
        by_score = weight * (hi + lo - 1)
        by_threshold = np.array([(weight * ((grades == j) * hi * (1 - hi) - (grades == j + 1) * lo * (1 - lo)) / p).sum() for j in range(k - 1)])
        grad = np.concatenate([np.bincount(column, by_score[at], len(chosen)) - RIDGE * w, [by_threshold.sum()], [by_threshold[j:].sum() * np.exp(theta[j]) for j in range(1, k - 1)]])
        sums += grad**2
        step = RATE * grad / np.sqrt(sums)
        w, theta = w + step[: len(w)], theta + step[len(w) :]
    return OrdinalModel(chosen, w, np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))]))


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3) -> OrdinalModel | None:
    """The model of ratings (doc_id, grade 0 .. grades - 1) over docs; None if fewer than two grades are rated.

    Of several ratings of a document the least counts; null grades and ids don't. Shares of grades are counted
    over all ratings; the weights are fitted to at most SAMPLE_A_GRADE documents of each grade, the only rows
    that reach the driver, as numbers of buckets; of several rows of an id the least text counts. They are ranked by hash among the lowest hashes only, about
    four times as many, so a grade of any size has a small ranking.
    """
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    share, near = np.zeros(grades), F.lit(False)
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(_PLACES - 1))
    for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect():
        share[int(r["grade"])] = r["n"]
        near |= (F.col("grade") == r["grade"]) & (place < F.lit(min(_PLACES, _PLACES * 4 * SAMPLE_A_GRADE // r["n"])))
    nth = F.row_number().over(Window.partitionBy("grade").orderBy(place, "doc_id"))
    sample = rated.where(near).withColumn("nth", nth).where(F.col("nth") <= SAMPLE_A_GRADE).select("doc_id", "grade")

    def of_batch(batches):
        seen = _Features()
        for batch in batches:
            yield pd.DataFrame({"grade": batch["grade"], "buckets": [features(t, seen) for t in batch["text"]]})

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    found = texts.select("grade", "text").mapInPandas(of_batch, "grade int, buckets array<int>").toPandas()
    known = found["grade"].to_numpy(np.int64)
    if len(np.unique(known)) < 2:
        return None
    return fit([np.asarray(b, np.int64) for b in found["buckets"]], known, np.maximum(share, 1e-3) / np.maximum(share, 1e-3).sum())


def grader(model: OrdinalModel | None, keep_from: float = KEEP_FROM) -> Callable:
    """Column function of text: struct of expected_grade, tail_prob (chance of the best grade) and kept.

    Null texts and texts without words get grade 0 and chance 0. Without a model every text with words is kept.
    """

    @F.pandas_udf("expected_grade double, tail_prob double, kept boolean")
    def grade(batches: pd.Series) -> pd.DataFrame:
        seen = _Features()
        rows = [features(t, seen) for t in batches]
        words = np.array([len(r) > 0 for r in rows], bool)
        if model is None:
            return pd.DataFrame({"expected_grade": words.astype(float), "tail_prob": words.astype(float), "kept": words})
        chance = model.chances(np.array([model.weights[r].sum(dtype=np.float64) for r in rows], np.float64).reshape(-1))
        best = np.where(words, chance[:, -1], 0.0)
        return pd.DataFrame({"expected_grade": np.where(words, chance @ np.arange(chance.shape[1]), 0.0), "tail_prob": best, "kept": best >= keep_from})

    return grade


def ratings_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels: 0 for toxic, 1 for low quality, 2 for the rest; null marks count as 0."""
    toxic, quality = F.coalesce("toxic", F.lit(0)), F.coalesce("quality", F.lit(0))
    return labels.select("doc_id", F.when(toxic > 0, 0).when(quality < 1, 1).otherwise(2).alias("grade"))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, expected_grade, tail_prob, kept) of each row of docs. No row moves: the text is graded in place.

    Null and empty texts, and texts of white space, have grade 0, chance 0 and aren't kept; a text of any length is
    graded whole. Alike texts get alike grades, whatever their ids, and a null doc_id is kept as it is; a chance of just
    KEEP_FROM is kept. Ratings without an id or of unknown documents teach nothing, of several of an id the least
    counts; without ratings of two grades every text with words is kept. Repeated rows repeat. Other columns are
    ignored; an empty table gives an empty result.
    """
    model = train(docs, ratings_of(labels))
    return docs.select("doc_id", grader(model)("text").alias("q")).select("doc_id", "q.*")


def good_ones(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose chance of the best grade is too low; the columns stay as they are. Rows without words go, as graded says."""
    return docs.where(grader(train(docs, ratings_of(labels)))("text")["kept"])
