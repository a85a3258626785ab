"""Linear models from sums of products, the modelling table, searches over settings, and bootstraps in one pass."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stages
from . import quantiles
from .models import CAP_QUANTILE, MIN_SALARY, trainer
from .sampling import folds, is_test

# Penalties tried, and the ranges that boosted trees are searched in.
ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
BOOSTED_RANGES = {"maxIter": (200, 1500), "maxDepth": (3, 9), "stepSize": (0.01, 0.3), "subsamplingRate": (0.6, 1.0), "minInstancesPerNode": (1, 20)}
TRIALS, FOLDS = 50, 5
ADDERS = 16
MAE_REPLICATES, F1_REPLICATES = 500, 1000


# --- the modelling table ----------------------------------------------------------------


def modelling_table(jobs: DataFrame, real: Column, features: list[str], target: str = "salary_max_usd_yearly", seed: int = 42, share: float = 0.2) -> DataFrame:
    """(id, features.., y, y_raw, stratum, is_test): real postings with a plausible disclosed target, its upper tail capped.

    The cap is the quantile of what is left after all filters; y is the target's log10.  Features that the table
    lacks are left out.
    """
    left = jobs.where(real & F.col("salary_disclosed") & (F.col(target) >= MIN_SALARY))
    cap = quantiles.aggregate(left.select(target), [], [], {"_cap": (target, CAP_QUANTILE)})
    named = left.join(F.broadcast(cap)).withColumn("y_raw", F.least(target, "_cap"))
    stratum = F.concat(F.coalesce("country", F.lit("None")), F.lit("/"), F.coalesce("source", F.lit("None")))
    kept = [c for c in features if c in jobs.columns]
    return named.select("id", *kept, F.log10("y_raw").alias("y"), "y_raw", stratum.alias("stratum"), is_test(seed, F.col("id"), share).alias("is_test"))


def scored_salaries(jobs: DataFrame, model: Callable[[DataFrame], DataFrame], into: str = "predicted_salary_usd_v1") -> DataFrame:
    """``jobs`` with 10 to the power of the model's prediction."""
    done = model(jobs)
    return done.withColumn(into, F.round(F.pow(F.lit(10.0), "prediction"), 2)).select(*(c for c in jobs.columns if c != into), into)


# --- linear models ----------------------------------------------------------------------


@dataclass
class Moments:
    """Sums over complete rows: of products of (1, columns.., label), as one symmetric matrix."""

    columns: list[str]
    matrix: np.ndarray

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.columns, self.matrix - other.matrix)

    def ridge(self, alpha: float) -> tuple[float, np.ndarray]:
        """(intercept, coefficients); the intercept has no penalty."""
        m = self.matrix
        mean = m[0, 1:] / self.n
        centred = m[1:, 1:] - self.n * np.outer(mean, mean)
        coef = np.linalg.pinv(centred[:-1, :-1] + alpha * np.eye(len(self.columns)), hermitian=True) @ centred[:-1, -1]
        return float(mean[-1] - mean[:-1] @ coef), coef

    def squared_error(self, intercept: float, coef: np.ndarray) -> float:
        w = np.concatenate([[-intercept], -coef, [1.0]])
        return float(max(0.0, w @ self.matrix @ w))


def moments(df: DataFrame, columns: list[str], label: str, by: str | None = None) -> dict[object, Moments]:
    """Moments of each level of ``by`` (a few), or of all rows under None: sums of block products, one matrix a task and level."""
    names = [*columns, label]
    level = F.col(by) if by else F.lit(None).cast("int")
    values = F.transform(F.array(*(F.col(f"`{c}`").cast("double") for c in names)), lambda v: F.nanvl(v, F.lit(None).cast("double")))
    full = df.select(level.alias("level"), F.concat(F.array(F.lit(1.0)), values).alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    # Tasks return one matrix a level; a few tasks add them before the driver does.
    products = full.mapInArrow(_products(len(names) + 1), f"level {full.schema['level'].dataType.simpleString()}, matrix binary")
    rows = products.repartition(ADDERS).mapInArrow(_add_matrices, products.schema).collect()
    out: dict[object, Moments] = {}
    for row in rows:
        matrix = np.frombuffer(bytes(row.matrix)).reshape(len(names) + 1, -1)
        out[row.level] = Moments(columns, out[row.level].matrix + matrix if row.level in out else matrix)
    return out


def _products(width: int):
    def run(batches):
        sums: dict[object, np.ndarray] = {}
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            x = pa.compute.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).reshape(-1, width)
            for level in batch.column(0).unique().to_pylist():
                own = x if level is None else x[np.array(pa.compute.fill_null(pa.compute.equal(batch.column(0), level), False))]
                sums[level] = sums.get(level, 0.0) + own.T @ own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), kind), pa.array([m.tobytes() for m in sums.values()], pa.binary())], ["level", "matrix"])

    return run


def _add_matrices(batches):
    sums: dict[object, np.ndarray] = {}
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for level, matrix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[level] = sums.get(level, 0.0) + np.frombuffer(matrix)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), kind), pa.array([m.tobytes() for m in sums.values()], pa.binary())], ["level", "matrix"])


@dataclass
class LinearModel:
    columns: list[str]
    intercept: float
    coef: np.ndarray
    alpha: float = 0.0

    def column(self) -> Column:
        return sum((F.col(f"`{c}`").cast("double") * float(w) for c, w in zip(self.columns, self.coef, strict=True)), F.lit(self.intercept))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.column())

    def save(self, spark: SparkSession, path: str) -> None:
        """One row in whatever store Spark writes to."""
        row = (self.columns, float(self.intercept), [float(w) for w in self.coef], float(self.alpha))
        spark.createDataFrame([row], "columns array<string>, intercept double, coef array<double>, alpha double").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        row = spark.read.parquet(path).first()
        return LinearModel(list(row["columns"]), row.intercept, np.array(row.coef), row.alpha)


def ridge_cv(df: DataFrame, columns: list[str], label: str, key: str, alphas: tuple[float, ...] = ALPHAS, k: int = FOLDS, seed: int = 42) -> LinearModel:
    """Ridge at the penalty of least squared error over k folds; all fits come from one aggregate by fold."""
    by_fold = moments(folds(df, k, seed, key), columns, label, "fold")
    whole = Moments(columns, sum(m.matrix for m in by_fold.values()))

    def error(alpha: float) -> float:
        return sum(m.squared_error(*(whole - m).ridge(alpha)) for m in by_fold.values() if (whole - m).n > 0)

    alpha = min(alphas, key=lambda a: (error(a), a))
    return LinearModel(columns, *whole.ridge(alpha), alpha)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d or 1e-300)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + top * d) or 1e-300)
            c = (1.0 + top / c) or 1e-300
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    if math.isinf(t):
        return 0.0
    a, b, x = dof / 2, 0.5, dof / (dof + t * t)
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(p: float, dof: float) -> float:
    """t with P(|T| >= t) = p."""
    low, high = 0.0, 1.0
    while t_two_sided(high, dof) > p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, dof) > p else (low, mid)
    return (low + high) / 2


def ols_table(df: DataFrame, columns: list[str], label: str, level: float = 0.05) -> DataFrame:
    """(term, coef, std_err, t_value, p_value, ci_low, ci_high) of least squares with an intercept."""
    m = moments(df, columns, label)
    spark = df.sparkSession
    schema = "term string, coef double, std_err double, t_value double, p_value double, ci_low double, ci_high double"
    if not m:
        return spark.createDataFrame([], schema)
    whole = m[None]
    x, y = whole.matrix[:-1, :-1], whole.matrix[:-1, -1]
    inverse = np.linalg.pinv(x, hermitian=True)
    coef = inverse @ y
    dof = whole.n - len(coef)
    error = whole.squared_error(float(coef[0]), coef[1:]) / dof if dof > 0 else math.nan
    reach = t_quantile(level, dof) if dof > 0 else math.nan
    rows = []
    for name, b, v in zip(["intercept", *columns], coef, np.diag(inverse), strict=True):
        se = math.sqrt(error * v) if dof > 0 else math.nan
        t = b / se if se > 0 else math.inf
        rows.append((name, *(float(v) for v in (b, se, t, t_two_sided(t, dof) if dof > 0 else math.nan, b - reach * se, b + reach * se))))
    return spark.createDataFrame(rows, schema)


def coefficients(signed: DataFrame, n: int = 15) -> DataFrame:
    """Of (name, coef): the n largest by size, with their size and their sign."""
    sizes = signed.select("name", F.abs("coef").alias("abs_coef"))
    top = sizes.orderBy(F.desc("abs_coef"), "name").limit(n)
    return top.join(signed, "name", "left").orderBy(F.desc("abs_coef"), "name")


# --- searches ---------------------------------------------------------------------------


def boosted_settings(trial: int, seed: int = 42, ranges: dict[str, tuple[float, float]] = BOOSTED_RANGES) -> dict[str, float]:
    """The settings of a trial: hashed points of the ranges, the step on a logarithmic scale."""
    rng = np.random.default_rng([seed, trial])
    out: dict[str, float] = {}
    for name, (low, high) in ranges.items():
        u = rng.random()
        if name == "stepSize":
            out[name] = float(math.exp(math.log(low) + u * (math.log(high) - math.log(low))))
        elif isinstance(low, int):
            out[name] = int(low + u * (high - low + 1)) // (100 if name == "maxIter" and high >= 100 else 1) * (100 if name == "maxIter" and high >= 100 else 1)
        else:
            out[name] = low + u * (high - low)
    return out


@dataclass
class Trial:
    """One setting: the last rung that it reached, and its mean squared error over that rung's folds."""

    number: int
    settings: dict[str, float]
    rung: int = -1
    error: float = math.inf


@dataclass
class Search:
    model: object
    best: Trial
    trials: list[Trial]


#: Of each rung: the share of a setting's trees, and of the folds, that it is tried with.
RUNGS = ((1 / 9, 0.2), (1 / 3, 0.4), (1.0, 1.0))
KEPT, WORKERS = 1 / 3, 8


def boosted_search(df: DataFrame, label: str, key: str, trials: int = TRIALS, k: int = FOLDS, seed: int = 42, ranges: dict[str, tuple[float, float]] = BOOSTED_RANGES, rungs: tuple[tuple[float, float], ...] = RUNGS, workers: int = WORKERS) -> Search:
    """Boosted trees at the best of ``trials`` settings, refitted to all rows.

    Settings are halved rung by rung: all are tried with few trees on few folds, the best third with more, and what is left with
    all of its trees on all ``k`` folds.  Trials of a rung run at once, each from a thread and scheduler pool of its own, so a
    cluster is filled by many small fits.  Folds are written once.  Ties go to the lower number, so a rerun has the same winner.
    """
    spark = df.sparkSession
    dealt = stages.temporary(folds(df.select(label, key, "features"), k, seed, key), "folds")

    def error(trial: Trial, rung: int) -> float:
        share, of_folds = rungs[rung]
        settings = trial.settings | {"maxIter": max(1, round(trial.settings["maxIter"] * share))}
        errors = []
        for fold in range(max(1, round(of_folds * k))):
            train, held = dealt.where(F.col("fold") != fold), dealt.where(F.col("fold") == fold)
            fitted = trainer("boosted", label, seed, **settings).fit(train)
            one = fitted.transform(held).agg(F.avg(F.pow(F.col(label) - F.col("prediction"), 2)).alias("e")).first()
            errors += [one.e] if one.e is not None else []
        return sum(errors) / len(errors) if errors else math.inf

    def run(trial: Trial, rung: int) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{trial.number}")
        trial.rung, trial.error = rung, error(trial, rung)

    every = [Trial(i, boosted_settings(i, seed, ranges)) for i in range(trials)]
    left = every
    for rung in range(len(rungs)):
        with ThreadPoolExecutor(workers) as pool:
            list(pool.map(inheritable_thread_target(spark)(run), left, [rung] * len(left)))
        left = sorted(left, key=lambda t: (t.error, t.number))
        if rung < len(rungs) - 1:
            left = left[: max(1, math.ceil(len(left) * KEPT))]
    return Search(trainer("boosted", label, seed, **left[0].settings).fit(dealt), left[0], every)


# --- bootstraps -------------------------------------------------------------------------


def _poisson(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(rows, replicates): weights drawn as Poisson(1) from hashes of row and replicate, so that any task draws the same."""
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(replicates, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    return np.searchsorted(steps, (x >> np.uint64(11)) / float(1 << 53), "right").astype(np.float64)


def _resampled(replicates: int, seed: int):
    """Sums of a whole partition: as many numbers as replicates and cells."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                weights = _poisson(part.column(0).to_numpy(), replicates, seed)
                values = part.column(2).to_numpy(zero_copy_only=False)
                which = part.column(1).to_numpy()
                for cell in np.unique(which).tolist():
                    own = which == cell
                    sums[cell] = sums.get(cell, 0.0) + np.stack([weights[own].sum(0), values[own] @ weights[own]])
        for cell, (w, wx) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(np.full(replicates, cell, np.int64)), pa.array(w), pa.array(wx)], ["r", "cell", "w", "wx"])

    return run


def resampled(df: DataFrame, key: str, cell: Column, value: Column, replicates: int, seed: int = 42) -> DataFrame:
    """(r, cell, w, wx): per replicate and cell, the sums of Poisson weights and of weighted values, in one pass without a row a replicate."""
    rows = df.select(F.xxhash64(key).alias("key"), cell.cast("long").alias("cell"), value.cast("double").alias("value")).where("cell is not null and value is not null")
    parts = rows.mapInArrow(_resampled(replicates, seed), "r long, cell long, w double, wx double")
    return parts.groupBy("r", "cell").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"))


def _interval(metric: DataFrame, name: str) -> DataFrame:
    return metric.agg(F.avg(name).alias("mean"), F.percentile(name, 0.025).alias("low"), F.percentile(name, 0.975).alias("high"), F.count("*").alias("replicates"))


def bootstrap_mean(df: DataFrame, value: str, key: str, replicates: int = MAE_REPLICATES, seed: int = 42) -> DataFrame:
    """(mean, low, high, replicates) of a mean."""
    sums = resampled(df, key, F.lit(0), F.col(value), replicates, seed)
    return _interval(sums.where("w > 0").select((F.col("wx") / F.col("w")).alias("mean_of")), "mean_of")


def bootstrap_mae(df: DataFrame, y: str, p: str, key: str, replicates: int = MAE_REPLICATES, seed: int = 42) -> DataFrame:
    """(mean, low, high, replicates) of the back-transformed absolute error of log10 predictions."""
    error = F.abs(F.pow(F.lit(10.0), F.col(y)) - F.pow(F.lit(10.0), F.col(p)))
    sums = resampled(df, key, F.lit(0), error, replicates, seed)
    return _interval(sums.where("w > 0").select((F.col("wx") / F.col("w")).alias("mae")), "mae")


def bootstrap_f1(df: DataFrame, label: str, predicted: str, key: str, labels: list, replicates: int = F1_REPLICATES, seed: int = 42) -> DataFrame:
    """(mean, low, high, replicates) of the macro F1 over ``labels``; a label that a replicate lacks counts 0."""
    names = F.array(*(F.lit(x) for x in labels))
    place = lambda c: F.array_position(names, F.col(c)) - 1
    sums = resampled(df, key, place(label) * (len(labels) + 1) + place(predicted), F.lit(1.0), replicates, seed)
    y, p = F.floor(F.col("cell") / (len(labels) + 1)), F.col("cell") % (len(labels) + 1)
    cells = sums.select("r", "w", y.alias("y"), p.alias("p"))
    share = lambda i: F.try_divide(2 * F.sum(F.when((F.col("y") == i) & (F.col("p") == i), F.col("w")).otherwise(0.0)), F.sum(F.when(F.col("y") == i, F.col("w")).otherwise(0.0)) + F.sum(F.when(F.col("p") == i, F.col("w")).otherwise(0.0)))
    f1 = sum((F.coalesce(share(i), F.lit(0.0)) for i in range(len(labels))), F.lit(0.0)) / len(labels)
    return _interval(cells.groupBy("r").agg(f1.alias("f1")), "f1")


# --- labels -----------------------------------------------------------------------------

# Labels that say too little to learn from.
VAGUE = {"seniority": ("mid",), "role_family": ("Other", "Manager")}


def confident(df: DataFrame, label: str, vague: tuple[str, ...]) -> DataFrame:
    return df.where(F.col(label).isNotNull() & ~F.col(label).isin(*vague))


def vocabulary_split(df: DataFrame, label: str, known: list[str]) -> DataFrame:
    """(in_vocabulary, n) of labelled rows."""
    inside = F.col(label).isin(*known)
    return df.where(F.col(label).isNotNull()).groupBy(inside.alias("in_vocabulary")).agg(F.count("*").alias("n"))


def with_label(rows: DataFrame, labels: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Rows that have a label, with the first label of their key."""
    fields = [c for c in labels.columns if c != key]
    first = labels.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_l"))
    return rows.join(first, key).select(*rows.columns, *(F.col(f"_l.{c}").alias(c) for c in fields))


def review_packet(shard: DataFrame, proposals: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every row of the shard with its proposal and its prediction; nulls where there is none."""
    return shard.join(proposals, key, "left").join(predictions, key, "left")


def label_counts(reviewed: DataFrame, label: str, source: str, skipped: str = "skipped") -> DataFrame:
    """(label, source, n) of what was reviewed and not skipped."""
    return reviewed.where(F.col(label).isNotNull() & (F.col(label).cast("string") != skipped)).groupBy(F.col(label).cast("string").alias("label"), F.col(source).alias("source")).agg(F.count("*").alias("n"))
