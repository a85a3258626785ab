"""Audit statistics in closed form: each is one or two aggregations, never a collected sample."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ROLES
from ..sources import stages
from . import quantiles


def column_roles(df: DataFrame) -> DataFrame:
    """(column, role, kind) of the columns that have a role; a column's place in the table does not matter."""
    rows = [(c, role, kind) for c, kind in df.dtypes for role, names in ROLES.items() if c in names]
    return df.sparkSession.createDataFrame(rows, "column string, role string, kind string")


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.round(F.col(c) * 100 / F.col("_n"), 1).alias("missing_pct")) for c in columns))
    return one.select(F.explode(rows).alias("s")).select("s.*")


def co_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): correlation of null indicators of each pair; 0 where one does not vary."""
    flag = lambda c: F.col(c).isNull().cast("double")
    pairs = list(combinations(columns, 2))
    one = df.agg(*(F.corr(flag(a), flag(b)).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.coalesce(F.nanvl(F.col(f"`{a}|{b}`"), F.lit(0.0)), F.lit(0.0)), 6).alias("r")) for a, b in pairs))
    return one.select(F.explode(rows).alias("s")).select("s.*")


def target_summary(df: DataFrame, column: str) -> DataFrame:
    """Moments and quantiles; skewness and kurtosis are bias-corrected, and null for no more than two and three values."""
    n, g1, g2 = F.count(column).cast("double"), F.skewness(column), F.kurtosis(column)
    plain = [
        F.count(column).alias("n"),
        F.round(F.avg(column), 4).alias("mean"),
        F.round(F.stddev_samp(column), 4).alias("sd"),
        F.round(F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2), 6).alias("skewness"),
        F.round(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6), 6).alias("kurtosis"),
    ]
    shares = (10, 25, 75, 90, 99)
    one = quantiles.aggregate(df.select(column), [], plain, {"median": (column, 0.5)} | {f"p{q}": (column, q / 100) for q in shares})
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), "mean", "median", "sd", *(F.round(f"p{q}", 4).alias(f"p{q}") for q in shares), "skewness", "kurtosis")


def _running(batches):
    """Of (column, side, v, n) in order: the rows of smaller values of the same column and side in this partition."""
    held, total = None, 0
    part = TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
        n = batch.column(3).to_numpy()
        if held != key[0]:
            total = 0
        sums = np.cumsum(n) - n
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        base = sums[starts].copy()
        base[0] -= total
        before = sums - np.repeat(base, np.diff(np.append(starts, len(key))))
        held, total = key[-1], before[-1] + n[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(np.full(len(key), part, np.int32))], ["column", "side", "v", "n", "before", "part"])


def ranks(values: DataFrame) -> DataFrame:
    """(column, side, v, rank): average ranks of the distinct values of every (column, side) at once.

    Values are counted, dealt by range and numbered within their range; how many rows lie in the ranges before is one sum a
    range.  Rows of one value are one row here, however many they are.
    """
    counts = values.groupBy("column", "side", "v").agg(F.count("*").alias("n"))
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = counts.repartitionByRange(parts, "column", "side", "v").sortWithinPartitions("column", "side", "v")
    local = stages.temporary(ordered.mapInArrow(_running, "column int, side int, v double, n long, before long, part int"), "ranks")
    # As many rows as ranges, a column and side.
    own = Window.partitionBy("column", "side").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = local.groupBy("column", "side", "part").agg(F.sum("n").alias("rows")).withColumn("offset", F.coalesce(F.sum("rows").over(own), F.lit(0))).drop("rows")
    return local.join(F.broadcast(ranges), ["column", "side", "part"]).select("column", "side", "v", (F.col("offset") + F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def correlations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(column, pearson, spearman) of each column with the target, over rows that have both values."""
    value = lambda c: F.col(c).cast("double")
    pairs = F.array(*(F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), F.struct(F.lit(i).alias("column"), value(c).alias("x"), value(target).alias("y"))) for i, c in enumerate(columns)))
    rows = df.select(F.inline(F.array_compact(pairs)))
    sides = F.inline(F.array(F.struct("column", F.lit(0).alias("side"), F.col("x").alias("v")), F.struct("column", F.lit(1).alias("side"), F.col("y").alias("v"))))
    placed = ranks(rows.select(sides))
    of = lambda side, v, name: placed.where(F.col("side") == side).select("column", F.col("v").alias(v), F.col("rank").alias(name))
    both = rows.join(of(0, "x", "rx"), ["column", "x"]).join(of(1, "y", "ry"), ["column", "y"])
    found = both.groupBy("column").agg(F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))
    names = F.array(*(F.lit(c) for c in columns))
    return found.select(F.get(names, F.col("column")).alias("column"), "pearson", "spearman")


def anova(df: DataFrame, group: str, value: str, least: int = 5) -> DataFrame:
    """One-way F over groups of at least ``least`` rows."""
    groups = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where(F.col("n") >= least)
    one = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")
    return one.select("k", "n", F.round((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))), 4).alias("f"))


def welch_t(df: DataFrame, side: Column, value: str) -> DataFrame:
    """Welch's t of the rows where ``side`` holds against the others; a null side is a false one."""
    side = F.coalesce(side, F.lit(False))
    a, b = F.when(side, F.col(value)), F.when(~side, F.col(value))
    one = df.agg(*(f(x).alias(n) for x, s in ((a, "a"), (b, "b")) for f, n in ((F.count, f"n_{s}"), (F.avg, f"m_{s}"), (F.var_samp, f"v_{s}"))))
    t = (F.col("m_a") - F.col("m_b")) / F.sqrt(F.col("v_a") / F.col("n_a") + F.col("v_b") / F.col("n_b"))
    return one.select("n_a", "n_b", F.round(t, 6).alias("t"))


def chi_square(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(statistic, dof) of independence; nulls are a level, and 2 x 2 tables take Yates' correction."""
    level = lambda x: F.coalesce(x.cast("string"), F.lit("<NA>"))
    cells = df.groupBy(level(a).alias("a"), level(b).alias("b")).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    total = cells.agg(F.sum("o").alias("n"))
    expected = F.col("ra") * F.col("cb") / F.col("n")
    known = cells.join(rows, "a").join(cols, "b").crossJoin(total).select("*", expected.alias("e"), F.abs(F.col("o") - expected).alias("gap"))
    spared = lambda gap: F.least(F.lit(0.5), gap) * (2 * gap - F.least(F.lit(0.5), gap))
    one = known.agg(
        ((F.count_distinct("a") - 1) * (F.count_distinct("b") - 1)).alias("dof"),
        F.sum(F.col("gap") * F.col("gap") / F.col("e")).alias("seen"),
        (F.max("n") - F.sum("e")).alias("empty"),
        F.sum(spared(F.col("gap")) / F.col("e")).alias("yates"),
        F.max("gap").alias("g"),
        (4 - F.count("*")).alias("unseen"),
    )
    # Pairs of levels that nobody has add what is expected of them, in all n less the others' expectations, and are never rows.
    # In a 2 x 2 table all four gaps are one number, so it is also what is expected of an empty cell.
    yates = F.col("yates") + F.when(F.col("unseen") > 0, F.col("unseen") * spared(F.col("g")) / F.col("g")).otherwise(0.0)
    statistic = F.col("seen") + F.col("empty") - F.when(F.col("dof") == 1, yates).otherwise(0.0)
    return one.where(F.col("dof").isNotNull() & F.col("seen").isNotNull()).select("dof", F.round(statistic, 4).alias("statistic"))


def vif_two(df: DataFrame, x: str, y: str) -> DataFrame:
    """Variance inflation of two predictors, without intercept."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    one = both.agg(F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(F.col(x) * F.col(y)).alias("xy"))
    return one.select(F.round(1 / (1 - F.col("xy") * F.col("xy") / (F.col("xx") * F.col("yy"))), 6).alias("vif"))


def gram_matrix(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Sums of products of all pairs, over complete rows: as many numbers as pairs of columns."""
    full = df.na.drop(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = full.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs)).first()
    return {(a, b): row[f"{a}|{b}"] for a, b in pairs} | {(b, a): row[f"{a}|{b}"] for a, b in pairs}


def vif(df: DataFrame, columns: list[str]) -> tuple[dict[str, float], float]:
    """Variance inflation of each predictor, and the condition number, from the Gram matrix."""
    import numpy as np

    gram = gram_matrix(df, columns)
    g = np.array([[gram[a, b] for b in columns] for a in columns], float)
    inverse = np.linalg.pinv(g)
    scale = np.sqrt(np.diag(g))
    values = np.linalg.svd(g / np.outer(scale, scale), compute_uv=False)
    return {c: float(g[i, i] * inverse[i, i]) for i, c in enumerate(columns)}, float(np.sqrt(values[0] / values[-1]))


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, low, high, n_iqr, n_z) with fences at 1.5 interquartile ranges and z beyond 3."""
    moments = [a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]
    stats = quantiles.aggregate(df.select(*columns), [], moments, {f"{side}_{c}": (c, q) for c in columns for side, q in (("a", 0.25), ("b", 0.75))})
    wide = df.select(*columns).join(F.broadcast(stats))
    fence = {c: (F.col(f"a_{c}"), F.col(f"b_{c}")) for c in columns}
    low = {c: a - 1.5 * (b - a) for c, (a, b) in fence.items()}
    high = {c: b + 1.5 * (b - a) for c, (a, b) in fence.items()}
    one = wide.agg(*(x for c in columns for x in (F.max(low[c]).alias(f"low_{c}"), F.max(high[c]).alias(f"high_{c}"), F.count_if((F.col(c) < low[c]) | (F.col(c) > high[c])).alias(f"i_{c}"), F.count_if(F.abs(F.col(c) - F.col(f"m_{c}")) > 3 * F.col(f"s_{c}")).alias(f"z_{c}"))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.round(f"low_{c}", 4).alias("low"), F.round(f"high_{c}", 4).alias("high"), F.col(f"i_{c}").alias("n_iqr"), F.col(f"z_{c}").alias("n_z")) for c in columns))
    return one.select(F.explode(rows).alias("s")).select("s.*")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    known = df.where(F.col(column).isNotNull())
    return known.groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def grouped_medians(df: DataFrame, group: str, value: str, n: int = 10) -> DataFrame:
    known = df.where(F.col(value).isNotNull()).select(group, value)
    return quantiles.aggregate(known, [group], [], {"median": (value, 0.5)}).withColumn("median", F.round("median", 4)).orderBy(F.desc("median"), group).limit(n)


def principal_plane(df: DataFrame, columns: list[str]) -> DataFrame:
    """Two principal components of complete, standardised rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    full = df.na.drop(subset=columns)
    stages = [VectorAssembler(inputCols=columns, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), PCA(k=2, inputCol="_z", outputCol="_p")]
    p = vector_to_array(F.col("_p"))
    return Pipeline(stages=stages).fit(full).transform(full).select(*df.columns, F.get(p, F.lit(0)).alias("pc1"), F.get(p, F.lit(1)).alias("pc2"))
