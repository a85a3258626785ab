"""A linear probe: multinomial logistic regression on fixed vectors, its penalty chosen by stratified folds.

All models, one a fold and penalty and one a penalty over all rows, are fitted in step.  A pass over the rows takes
the loss and gradient of every model at the point where it stands, as products of one block of rows with the weights
of all models; sums are added by groups of tasks first.  Each model's own quasi-Newton search then says where it
stands next, on the driver, which holds weights and nothing of the rows.  A pass is one job however many models there are.

The loss is that of ``C * sum(weight * -log p) + |w|^2 / 2`` without a penalty on intercepts, where a row's weight
balances the classes of the model's training rows.
"""

from __future__ import annotations

import json
from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import stages
from .sampling import unit_hash

# Penalties tried, and folds.
C_GRID = (0.1, 1.0, 10.0)
FOLDS = 5
MEMORY, MOST_PASSES, TOLERANCE = 10, 100, 1e-4
MOST_CLASSES, SALTS, ADDERS = 1000, 64, 16


def lbfgs(start: np.ndarray, tolerance: float = TOLERANCE, memory: int = MEMORY) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """A minimiser that yields points and is sent (loss, gradient) there; returns the minimum.

    Steps are cut back until the loss falls enough, so several points may be asked for along one direction.
    """
    x = start
    f, g = yield x
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    scale = max(1.0, float(np.abs(g).max()))
    while np.abs(g).max() > tolerance * scale:
        d, kept = g.copy(), []
        for s, y in zip(reversed(steps), reversed(changes), strict=True):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d -= a * y
        if steps:
            d *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
        for s, y, a in zip(steps, changes, reversed(kept), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        slope = -(g @ d)
        if slope >= 0:
            d, slope, steps, changes = g.copy(), -(g @ g), [], []
        t = 1.0 if steps else min(1.0, 1.0 / np.abs(g).sum())
        while True:
            near = x - t * d
            fn, gn = yield near
            if fn <= f + 1e-4 * t * slope:
                break
            t *= 0.5 if not np.isfinite(fn) else min(0.5, max(0.1, -slope * t / (2 * (fn - f - slope * t))))
            if t < 1e-12:
                return x
        s, y = near - x, gn - g
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            steps, changes = [*steps, s][-memory:], [*changes, y][-memory:]
        x, f, g = near, fn, gn
    return x


def softmax(z: np.ndarray) -> np.ndarray:
    """Over the last axis."""
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def losses(x: np.ndarray, y: np.ndarray, weights: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted losses (models) and gradients (models, columns, classes) of rows x (with a column of ones) at ``points``.

    ``weights`` (rows, models) is 0 where a row is not of a model's training rows.
    """
    models, columns, classes = points.shape
    z = (x @ points.transpose(1, 0, 2).reshape(columns, models * classes)).reshape(len(x), models, classes)
    z -= z.max(2, keepdims=True)
    e = np.exp(z)
    total = e.sum(2)
    own = np.take_along_axis(z, np.broadcast_to(y[:, None, None], (len(y), models, 1)), 2)[:, :, 0]
    loss = (weights * (np.log(total) - own)).sum(0)
    e /= total[:, :, None]
    e[np.arange(len(y)), :, y] -= 1
    e *= weights[:, :, None]
    return loss, (x.T @ e.reshape(len(x), models * classes)).reshape(columns, models, classes).transpose(1, 0, 2)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    x = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.concatenate([x, np.ones((len(x), 1))], 1)


def _passes(points: np.ndarray, table: np.ndarray, chunk: int = 2048):
    """Losses and gradients of a task's rows; ``table`` (folds, classes, models) has a row's weight in each model."""

    def run(batches):
        loss, gradient = np.zeros(len(points)), np.zeros(points.shape)
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                part = batch.slice(i, chunk)
                y = part.column(1).to_numpy()
                own = losses(_rows(part), y, table[part.column(2).to_numpy(), y], points)
                loss, gradient = loss + own[0], gradient + own[1]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([loss, gradient.ravel()]).tobytes()], pa.binary())], ["sums"])

    return run


def _add(batches):
    total = None
    for batch in batches:
        for sums in batch.column(0).to_pylist():
            own = np.frombuffer(sums)
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _guesser(points: np.ndarray, fold_of: np.ndarray):
    """(model, label, guess, n) of the rows that a model has not seen."""

    def run(batches):
        seen = np.zeros((len(points), points.shape[2], points.shape[2]), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, y, fold = _rows(batch), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for m, w in enumerate(points):
                    own = fold == fold_of[m]
                    np.add.at(seen[m], (y[own], (x[own] @ w).argmax(1)), 1)
        m, y, p = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (m, y, p, seen[m, y, p])], ["model", "y", "p", "n"])

    return run


def macro_f1(cells: np.ndarray) -> float:
    """Of a table (label, guess): the mean over labels that occur or are guessed."""
    hit, rows, guessed = np.diag(cells), cells.sum(1), cells.sum(0)
    occurs = rows + guessed > 0
    return float((2 * hit[occurs] / (rows + guessed)[occurs]).mean()) if occurs.any() else 0.0


@dataclass
class Probe:
    """Labels in order, weights (columns and an intercept, by label), the penalty chosen, and (C, mean, deviation) of each."""

    labels: list[str]
    weights: np.ndarray
    c: float
    scores: list[tuple[float, float, float]]

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``label`` and its ``confidence``; null without features."""
        weights, names = self.weights, np.array(self.labels, object)

        @F.arrow_udf("struct<label: string, confidence: double>")
        def guess(column: pa.Array) -> pa.Array:
            known = np.array(column.is_valid())
            x = pc.list_flatten(column.drop_null()).to_numpy(zero_copy_only=False).reshape(known.sum(), -1) if known.any() else np.zeros((0, len(weights) - 1))
            p = softmax(x @ weights[:-1] + weights[-1])
            best, sure = np.full(len(column), None, object), np.full(len(column), np.nan)
            if known.any():
                best[known], sure[known] = names[p.argmax(1)], p.max(1)
            return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(sure, pa.float64(), mask=~known)], ["label", "confidence"])

        return df.withColumn("_guess", guess(F.col(features).cast("array<double>"))).select(*df.columns, "_guess.label", "_guess.confidence")

    def save(self, spark: SparkSession, path: str) -> None:
        row = (json.dumps({"labels": self.labels, "c": self.c, "scores": self.scores}), self.weights.tobytes(), self.weights.shape[0])
        spark.createDataFrame([row], "about string, weights binary, columns int").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Probe:
        row = spark.read.parquet(path).first()
        about = json.loads(row.about)
        return Probe(about["labels"], np.frombuffer(row.weights).reshape(row["columns"], -1).copy(), about["c"], [tuple(s) for s in about["scores"]])


def stratified(rows: DataFrame, label: Column, key: Column, k: int = FOLDS, seed: int = 42) -> DataFrame:
    """``rows`` with ``fold``, dealt in hash order within a label's hash slices, so that no label is ever in one task."""
    u = unit_hash(seed, key)
    own = Window.partitionBy("_label", "_slice").orderBy("_u")
    wide = rows.withColumns({"_label": label, "_u": u, "_slice": F.floor(u * SALTS)})
    return wide.withColumn("fold", F.pmod(F.row_number().over(own) - 1 + F.col("_slice"), F.lit(k)).cast("int")).drop("_label", "_u", "_slice")


def fit(rows: DataFrame, features: str, label: str, key: str, name: str, grid: tuple[float, ...] = C_GRID, k: int = FOLDS, seed: int = 42) -> Probe:
    """The probe of the rows that have features and a label; ``name`` names their table among those made once."""
    spark = rows.sparkSession
    known = rows.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("string").alias("label"), F.col(key).alias("key"))
    known = stages.staged(spark, "probe", name, lambda: stratified(known, F.col("label"), F.col("key"), k, seed).select("x", "label", "fold"))
    counted = known.groupBy("label", "fold").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).limit(MOST_CLASSES * k + 1).collect()
    labels = sorted({r.label for r in counted})
    if not labels or len(labels) > MOST_CLASSES:
        raise ValueError(f"{len(labels)} labels; between 1 and {MOST_CLASSES} are needed")
    counts = np.zeros((k, len(labels)))
    for r in counted:
        counts[r.fold, labels.index(r.label)] = r.n
    width = counted[0].width + 1
    # One model a penalty and fold, that fold left out; fold k stands for none, the model of all rows.
    models = [(c, fold) for c in grid for fold in range(k + 1)]
    table = np.zeros((k, len(labels), len(models)))
    for m, (_, left) in enumerate(models):
        own = counts[[f for f in range(k) if f != left]].sum(0)
        balance = np.where(own > 0, own.sum() / (max(1, (own > 0).sum()) * np.maximum(own, 1)), 0)
        table[[f for f in range(k) if f != left], :, m] = balance
    place = F.array_position(F.array(*(F.lit(v) for v in labels)), F.col("label")) - 1
    data = known.select("x", place.alias("y"), F.col("fold").cast("int"))
    shape = (len(models), width, len(labels))
    searches = [lbfgs(np.zeros(width * len(labels))) for _ in models]
    points = np.stack([next(s).reshape(shape[1:]) for s in searches])
    done: dict[int, np.ndarray] = {}
    for _ in range(MOST_PASSES):
        sums = data.mapInArrow(_passes(points, table), "sums binary").repartition(ADDERS).mapInArrow(_add, "sums binary").collect()
        total = sum(np.frombuffer(bytes(r.sums)) for r in sums)
        loss, gradient = total[: len(models)], total[len(models) :].reshape(shape)
        for m, (c, _) in enumerate(models):
            if m in done:
                continue
            w = points[m].copy()
            w[-1] = 0
            try:
                points[m] = searches[m].send((c * loss[m] + 0.5 * (w * w).sum(), (c * gradient[m] + w).ravel())).reshape(shape[1:])
            except StopIteration as stop:
                done[m] = points[m] = stop.value.reshape(shape[1:])
        if len(done) == len(models):
            break
    cells = np.zeros((len(models), len(labels), len(labels)), np.int64)
    fold_of = np.array([fold for _, fold in models])
    for r in data.mapInArrow(_guesser(points, fold_of), "model long, y long, p long, n long").groupBy("model", "y", "p").agg(F.sum("n").alias("n")).collect():
        cells[r.model, r.y, r.p] = r.n
    scores = []
    for c in grid:
        own = [macro_f1(cells[m]) for m, (other, fold) in enumerate(models) if other == c and fold < k]
        scores.append((float(c), float(np.mean(own)), float(np.std(own))))
    best = max(scores, key=lambda s: s[1])[0]
    return Probe(labels, points[models.index((best, k))], best, scores)
