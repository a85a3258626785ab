"""Feature encodings as expressions; what must be learnt comes from one aggregation of the training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lets import unnested
from . import quantiles


def scaled(df: DataFrame, train: Column, columns: list[str]) -> DataFrame:
    """Median-imputed and standardised (population deviation) ``<c>_z``, learnt on the rows of ``train``."""
    known = df.where(train)
    medians = quantiles.medians(known, columns)
    filled = lambda c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}"))
    moments = known.join(F.broadcast(medians)).agg(*(a for c in columns for a in (F.avg(filled(c)).alias(f"_avg_{c}"), F.stddev_pop(filled(c)).alias(f"_sd_{c}"))))
    wide = df.join(F.broadcast(medians)).join(F.broadcast(moments))
    sd = lambda c: F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(1.0)
    return wide.withColumns({f"{c}_z": (filled(c) - F.col(f"_avg_{c}")) / sd(c) for c in columns}).select(*df.columns, *(f"{c}_z" for c in columns))


def ordinal(value: Column, levels: tuple[str, ...]) -> Column:
    """Place in the order from 0; -1 for unknown and null."""
    return F.coalesce(F.array_position(F.array(*(F.lit(x) for x in levels)), value) - 1, F.lit(-1)).cast("long")


def one_hot(value: Column, categories: list[str], prefix: str) -> dict[str, Column]:
    """Indicators of training categories; null is a level, unknown ones are all 0."""
    out = {f"{prefix}_{c}": F.coalesce(value == c, F.lit(False)).cast("long") for c in categories}
    return out | {f"{prefix}_missing": value.isNull().cast("long")}


def smoothed_mean(df: DataFrame, train: Column, keys: list[str], target: str, into: str, weight: float = 30.0) -> DataFrame:
    """(n * mean + m * global) / (n + m) of the training rows of a group; groups not seen there get the global mean."""
    known = df.where(train)
    total = known.agg(F.avg(target).alias("_g"))
    groups = known.groupBy(*keys).agg(F.count(target).alias("_n"), F.avg(target).alias("_m")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        match = same if match is None else match & same
    joined = df.join(groups, match, "left").join(F.broadcast(total))
    value = F.coalesce((F.col("_n") * F.col("_m") + weight * F.col("_g")) / (F.col("_n") + weight), F.col("_g"))
    return joined.withColumn(into, value).select(*df.columns, into)


def boolean(value: Column, name: str) -> dict[str, Column]:
    return {name: F.coalesce(value.cast("int"), F.lit(0)).cast("long"), f"{name}__isna": value.isNull().cast("long")}


def tri_state(value: Column, prefix: str, levels: tuple[str, ...] = ("yes", "no", "unspecified")) -> dict[str, Column]:
    """Indicators; any other level counts as missing."""
    out = {f"{prefix}_{x}": F.coalesce(value == x, F.lit(False)).cast("long") for x in levels}
    return out | {f"{prefix}_missing": (~F.coalesce(value.isin(*levels), F.lit(False))).cast("long")}


def vocabulary(df: DataFrame, train: Column, list_col: str, n: int) -> list[str]:
    """The n most frequent tokens of the training rows: the driver gets n of them."""
    rows = unnested(df.where(train), list_col, "t").groupBy("t").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "t").limit(n)
    return [r.t for r in rows.collect()]


def multi_hot(values: Column, vocab: list[str], prefix: str) -> dict[str, Column]:
    known = F.coalesce(values, F.array().cast("array<string>"))
    words = F.array(*(F.lit(v) for v in vocab)) if vocab else F.array().cast("array<string>")
    return {f"{prefix}_{v}": F.array_contains(known, v).cast("long") for v in vocab} | {f"{prefix}__has_any": F.arrays_overlap(known, words).cast("long")}


def tech_block(values: Column, vocab: list[str], modern: tuple[str, ...]) -> dict[str, Column]:
    known = F.coalesce(values, F.array().cast("array<string>"))
    return multi_hot(values, vocab, "tech") | {"tech__count": F.size(known).cast("long"), "tech__modern_ml": F.arrays_overlap(known, F.array(*(F.lit(m) for m in modern))).cast("long")}


def datetime_block(df: DataFrame, train: Column, column: str) -> DataFrame:
    """Days since the latest training date (median where missing, at least 0), month on a circle, missing flag."""
    reference = df.where(train).agg(F.max(column).cast("date").alias("_ref"))
    days = F.when(F.col(column).isNotNull(), F.greatest(F.date_diff("_ref", F.col(column).cast("date")), F.lit(0)))
    wide = df.join(F.broadcast(reference)).withColumn("_days", days)
    wide = wide.join(F.broadcast(quantiles.medians(wide, ["_days"]))).withColumnRenamed("_med__days", "_mid")
    angle = 2 * 3.141592653589793 * F.coalesce(F.month(column), F.lit(6)) / 12
    return wide.withColumns({"days_since": F.coalesce(F.col("_days").cast("double"), "_mid"), "month_sin": F.sin(angle), "month_cos": F.cos(angle), "posted_missing": F.col(column).isNull().cast("long")}).select(*df.columns, "days_since", "month_sin", "month_cos", "posted_missing")


def experience_block(df: DataFrame, train: Column, column: str) -> DataFrame:
    """Years (median where missing), their square, missing flag."""
    mid = quantiles.medians(df.where(train), [column]).withColumnRenamed(f"_med_{column}", "_mid")
    value = F.coalesce(F.col(column).cast("double"), "_mid")
    return df.join(F.broadcast(mid)).withColumns({"yoe": value, "yoe_sq": value * value, "yoe__isna": F.col(column).isNull().cast("long")}).select(*df.columns, "yoe", "yoe_sq", "yoe__isna")
