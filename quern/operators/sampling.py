"""Deterministic splits, samples and folds: every random choice is a hash of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MAX = 1.8446744073709552e19


def unit_hash(seed: str | int, key: Column) -> Column:
    """A number in [0, 1] from the first 16 hex digits of sha256(seed::key)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}::"), key.cast("string")), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("double") / F.lit(_MAX)


def is_test(seed: int, key: Column, share: float = 0.2) -> Column:
    return unit_hash(seed, key) < share


def strata_counts(df: DataFrame, test: Column, *strata: str) -> DataFrame:
    out = df.groupBy(*strata).agg(F.count("*").alias("n"), F.count_if(test).alias("n_test"))
    return out.withColumn("n_train", F.col("n") - F.col("n_test")).withColumn("test_ratio", F.round(F.col("n_test") / F.col("n"), 4))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return df.orderBy(unit_hash(seed, F.col(key)), key).limit(n)


def quota(df: DataFrame, n: int, seed: int, key: str, *strata: str) -> DataFrame:
    """At most n rows a stratum, by hash order."""
    order = Window.partitionBy(*strata).orderBy(unit_hash(seed, F.col(key)), key)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def review_sample(df: DataFrame, fallback: Column, n: int, seed: int, key: str, stratum: str) -> DataFrame:
    """Half from fallback rows, half by stratum, each id once."""
    half = n // 2
    groups = max(1, df.select(stratum).distinct().count())
    first = sample_n(df.where(fallback), half, seed, key)
    rest = quota(df.where(~F.coalesce(fallback, F.lit(False))), -(-half // groups), seed, key, stratum)
    return sample_n(first.unionByName(rest).dropDuplicates([key]), n, seed, key)


def folds(df: DataFrame, k: int, seed: int, key: str, *strata: str) -> DataFrame:
    """``df`` with ``fold``, dealt in hash order within each stratum.

    Without strata the fold is the hash itself, which needs no order of all rows.
    """
    if not strata:
        return df.withColumn("fold", F.least(F.floor(unit_hash(seed, F.col(key)) * k), F.lit(k - 1)).cast("long"))
    order = Window.partitionBy(*strata).orderBy(unit_hash(seed, F.col(key)), key)
    return df.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("long"))


def halves(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.withColumn("half", F.when(unit_hash(seed, F.col(key)) < 0.5, "reference").otherwise("current"))
