"""The model ladder: baselines as aggregations, trainers from the ML library, metrics as expressions."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stages
from .encode import smoothed_mean

# The target's floor and cap.
MIN_SALARY, CAP_QUANTILE = 30_000, 0.995


def constant_baseline(df: DataFrame, train: Column, target: str, into: str = "prediction") -> DataFrame:
    return df.join(F.broadcast(df.where(train).agg(F.avg(target).alias(into))))


def stratified_baseline(df: DataFrame, train: Column, keys: list[str], target: str, into: str = "prediction") -> DataFrame:
    return smoothed_mean(df, train, keys, target, into)


def regression_metrics(df: DataFrame, y: str, p: str) -> list[Column]:
    """Back-transformed MAE and MAPE (per cent, over at least 1) and R2 of log10 values."""
    actual, guess = F.pow(F.lit(10.0), F.col(y)), F.pow(F.lit(10.0), F.col(p))
    sse = F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    sst = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count(y)
    return [F.count("*").alias("n"), F.round(F.avg(F.abs(actual - guess)), 2).alias("mae"), F.round(F.avg(F.abs(actual - guess) / F.greatest(actual, F.lit(1.0))) * 100, 4).alias("mape"), F.round(1 - sse / sst, 4).alias("r2")]


def overall(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(*regression_metrics(df, y, p))


def by_stratum(df: DataFrame, y: str, p: str, *strata: str, least: int = 5) -> DataFrame:
    return df.groupBy(*strata).agg(*regression_metrics(df, y, p)).where(F.col("n") >= least).orderBy(F.desc("n"), *strata)


def leaderboard(rows: DataFrame) -> DataFrame:
    """Models by MAE, the winner first."""
    return rows.orderBy("mae", "model")


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1); 0 where a denominator is 0."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    per = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = ratio(F.col("hit"), F.col("guessed")), ratio(F.col("hit"), F.col("support"))
    return per.select("label", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(ratio(2 * precision * recall, precision + recall), 6).alias("f1"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) of each class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_c"))
    total = counts.agg(F.sum("n_c").alias("_n"), F.count("*").alias("_k"))
    return counts.join(F.broadcast(total)).select(label, "n_c", F.round(F.col("_n") / (F.col("_k") * F.col("n_c")), 6).alias("weight"))


def simple_ols(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.round(F.regr_slope(y, x), 8).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def assemble(df: DataFrame, columns: list[str], into: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=into, handleInvalid="skip").transform(df)


def trainer(kind: str, label: str, seed: int = 42, **settings):
    """ols, ridge, forest or boosted trees over a ``features`` column."""
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "prediction"}
    if kind == "ols":
        return LinearRegression(**common, regParam=0.0, solver="normal", **settings)
    if kind == "ridge":
        return LinearRegression(**common, regParam=settings.pop("regParam", 0.1), elasticNetParam=0.0, **settings)
    if kind == "forest":
        return RandomForestRegressor(**common, numTrees=settings.pop("numTrees", 500), featureSubsetStrategy="sqrt", minInstancesPerNode=5, maxDepth=settings.pop("maxDepth", 30), seed=seed, **settings)
    if kind == "boosted":
        return GBTRegressor(**common, maxIter=settings.pop("maxIter", 20), maxDepth=settings.pop("maxDepth", 4), seed=seed, **settings)
    raise ValueError(f"no trainer {kind}")


def importances(names: list[str], weights) -> list[tuple[str, float]]:
    """Names by importance or size of coefficient, greatest first."""
    return sorted(zip(names, (float(w) for w in weights), strict=True), key=lambda x: (-abs(x[1]), x[0]))


def out_of_fold(df: DataFrame, fold: str, k: int, fit) -> DataFrame:
    """Predictions of each fold by a model of the others; ``fit(train)`` returns a function of a DataFrame."""
    out = None
    for i in range(k):
        one = fit(df.where(F.col(fold) != i))(df.where(F.col(fold) == i))
        out = one if out is None else out.unionByName(one)
    return out


def text_classifier(label: str, text: str, features: int = 1 << 12, weight: str | None = None) -> Pipeline:
    """Hashed words and multinomial logistic regression: the probe over a frozen text embedding."""
    steps = [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x")]
    steps += [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=20, regParam=0.01, **({"weightCol": weight} if weight else {}))]
    return Pipeline(stages=steps)


def reread(spark: SparkSession, model: PipelineModel) -> PipelineModel:
    """``model`` saved and read again, which leaves its training summary behind.

    The summary of a classifier of two labels keeps the session and goes to tasks with the model; a session that has had a
    tag or an observation cannot be sent.  What is read is in the driver, so the files are deleted.
    """
    path = f"{stages.shared_folder(spark)}/temporary/model-{uuid.uuid4().hex}"
    model.save(path)
    try:
        return PipelineModel.load(path)
    finally:
        stages.delete(spark, path)


def predicted_label(scored: DataFrame, labels: list[str]) -> DataFrame:
    """``label`` and ``confidence`` of a scored table."""
    names = F.array(*(F.lit(x) for x in labels))
    return scored.withColumns({"label": F.get(names, F.col("prediction").cast("int")), "confidence": F.array_max(vector_to_array("probability"))})


def unknown_scores(df: DataFrame) -> DataFrame:
    """What the enriched columns hold when no model is at hand."""
    return df.withColumns({"predicted_salary_usd_v1": F.lit(float("nan")), "seniority_label_v1": F.lit("unknown"), "role_family_v1": F.lit("unknown")})


def salary_band(point: Column, band: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), point - band), point + band
