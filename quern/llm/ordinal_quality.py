"""Ordinal cumulative-link regression of text quality on graded ratings.

Grades are ordered; P(grade <= k) = sigmoid(threshold_k - score), the score is one
linear function of hashed text features that all grades share, and thresholds
ascend.  A text gets its expected grade and the probability of each tail; it is
kept when P(grade >= the top one) reaches ``KEEP``.

Cost at scale.  The fit takes at most ``FIT_ROWS`` rated documents, those with the
smallest hashed ids: a broadcast of that fixed size picks them from the texts, and
only their hashed features reach the driver.  Scoring is one pass over all texts
without a shuffle; the weights are 2**BITS floats, whatever the input.

Defined results.  A null text has no features and is scored by its length of 0.
Rows are scored each on its own, whatever their ids.  Ratings that repeat an id
count by their lowest grade, and of texts that share a rated id the first in order is
fitted; without ratings of two grades everything is kept.
Other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed_text import Features, adam, sigmoid, word_features
from .words import chunked_words

BITS = 17
FIT_ROWS = 8000
MIN_SHARE = 1 / 12
STEPS, RATE, L2 = 150, 0.1, 3e-4
KEEP = 0.5
FEATURES = "id long, n_features int, buckets array<int>, values array<float>"


@dataclass
class Model:
    """Weights and ascending thresholds; None where nothing could be fitted."""

    weights: np.ndarray | None
    thresholds: np.ndarray

    def tails(self, x: Features) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each row."""
        if self.weights is None:
            return np.ones((x.count, max(1, len(self.thresholds))))
        return sigmoid(x.scores(self.weights)[:, None] - self.thresholds[None, :])


def likelihood(w: np.ndarray, x: Features, grade: np.ndarray, grades: int) -> tuple[float, np.ndarray]:
    """(mean negative log-likelihood with its penalty, gradient) at weights, first threshold and logarithms of the gaps."""
    size, n, k = len(w) - (grades - 1), x.count, grades - 1
    theta = _thresholds(w[size:])
    upper = np.concatenate([np.ones((n, 1)), sigmoid(x.scores(w[:size])[:, None] - theta), np.zeros((n, 1))], 1)
    slope = upper * (1 - upper)
    row = np.arange(n)
    chance = np.maximum(upper[row, grade] - upper[row, grade + 1], 1e-9)
    by_score = -(slope[row, grade] - slope[row, grade + 1]) / chance / n
    by_theta = np.zeros(k)
    for i in range(k):
        low, high = grade == i + 1, grade == i
        by_theta[i] = (slope[low, i + 1] / chance[low]).sum() / n - (slope[high, i + 1] / chance[high]).sum() / n
    g = np.zeros_like(w)
    g[:size] = x.gradient(by_score, size) + L2 * w[:size]
    tail = np.cumsum(by_theta[::-1])[::-1]
    g[size] = tail[0]
    g[size + 1 :] = tail[1:] * np.exp(w[size + 1 :])
    return float(-np.log(chance).mean() + L2 / 2 * (w[:size] ** 2).sum()), g


def _thresholds(w: np.ndarray) -> np.ndarray:
    return np.cumsum(np.append(w[0], np.exp(w[1:])))


def fit(x: Features, grade: np.ndarray, grades: int) -> Model:
    """Maximum likelihood with an L2 penalty; features of fewer texts than ``MIN_SHARE`` of the rarest grade's stay at 0."""
    size = 1 << BITS
    if x.count == 0 or grade.min() == grade.max():
        return Model(None, np.zeros(grades - 1))
    counts = np.bincount(grade, minlength=grades)
    seen = np.bincount(x.buckets, minlength=size) >= MIN_SHARE * counts[counts > 0].min()
    keep = seen[x.buckets]
    if not keep.all():
        x = Features(x.rows[keep], x.buckets[keep], x.values[keep], x.count)
    share = np.array([(grade >= i + 1).mean() for i in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    start = np.concatenate([np.zeros(size), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    w = adam(lambda w: likelihood(w, x, grade, grades), start, STEPS, RATE)
    return Model(w[:size].astype(np.float32), _thresholds(w[size:]))


def _featurise(batches):
    for batch in batches:
        for a, b, words in chunked_words(batch.column(1)):
            x = word_features(words, BITS)
            order = np.argsort(x.rows, kind="stable")
            counts = np.bincount(x.rows, minlength=b - a)
            cut = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int32)), pa.ListArray.from_arrays(cut, pa.array(x.buckets[order].astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(x.values[order].astype(np.float32)))],
                ["id", "n_features", "buckets", "values"],
            )


def fit_on(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """Fit to ``docs`` that ``ratings`` (id, grade from 0) rate."""
    rated = ratings.select(F.col(id_col).cast("long").alias("id"), F.col("grade").cast("int").alias("grade")).where("id is not null and grade is not null")
    rated = rated.groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id")).limit(rows)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # A broadcast of at most ``rows`` pairs of numbers.
    chosen = own.join(F.broadcast(rated.select("id")), "id").groupBy("id").agg(F.min("text").alias("text"))
    features = chosen.select("id", "text").mapInArrow(_featurise, FEATURES)
    table = features.orderBy("id").toArrow()
    grade = dict(zip(*(c.to_pylist() for c in rated.toArrow().select(["id", "grade"]).columns), strict=True))
    counts, ids = table["n_features"].to_numpy(), table["id"].to_pylist()
    flat = lambda name, kind: np.concatenate([pa.compute.list_flatten(c).to_numpy(zero_copy_only=False) for c in table[name].chunks] or [np.zeros(0, kind)])
    buckets, values = flat("buckets", np.int32), flat("values", np.float32)
    del table
    x = Features(np.repeat(np.arange(len(counts), dtype=np.int32), counts), buckets, values, len(counts))
    return fit(x, np.array([grade[i] for i in ids], np.int64), grades)


def with_grades(docs: DataFrame, model: Model, text_col: str = "text", into: str = "grades") -> DataFrame:
    """``docs`` with an array column of P(grade >= k), k = 1.., named ``into``."""

    @F.arrow_udf("array<double>")
    def tails(column: pa.Array) -> pa.Array:
        parts = [model.tails(word_features(words, BITS)) for _, _, words in chunked_words(column)]
        p = np.concatenate(parts) if parts else np.zeros((0, 1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))

    return docs.withColumn(into, tails(F.col(text_col).cast("string")))


def expected_grade(tails: Column) -> Column:
    return F.aggregate(tails, F.lit(0.0), lambda s, x: s + x)


def grade_of_labels(labels: DataFrame) -> DataFrame:
    """Three grades of the labels table: toxic, poor, good; rows without a quality are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def graded(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """(doc_id, expected_grade, p_above_lowest, p_top, kept), one row per row of ``docs``."""
    own = with_grades(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    top = F.element_at("grades", -1)
    return own.select("doc_id", F.round(expected_grade(F.col("grades")), 6).alias("expected_grade"), F.round(F.get("grades", F.lit(0)), 6).alias("p_above_lowest"), F.round(top, 6).alias("p_top"), (top >= keep).alias("kept"))


def select_documents(docs: DataFrame, model: Model, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they came with."""
    return with_grades(docs, model, text_col, "_quern_grades").where(F.element_at("_quern_grades", -1) >= keep).select(*docs.columns)
