"""Distribution drift, the promotion gate and pipeline health."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stages
from . import quantiles

# Thresholds.
DRIFT, DRIFT_SHARE, EPSILON = 0.20, 0.30, 1e-6
MIN_LIFT, MAX_LOSS = 0.01, -0.02


# What is watched for drift.
TRACKED_NUMERIC = (
    "salary_min_usd_yearly",
    "salary_max_usd_yearly",
    "predicted_salary_usd_v1",
    "min_years_experience",
    "seniority_confidence_v1",
    "role_family_confidence_v1",
)
TRACKED_CATEGORICAL = (
    "country",
    "remote_policy",
    "source",
    "seniority_extracted",
    "role_family_extracted",
    "seniority_label_v1",
    "role_family_v1",
    "salary_disclosed",
)


def tracked(df: DataFrame) -> tuple[list[str], list[str]]:
    """Of the watched columns, the numeric and the categorical ones that the table has."""
    return [c for c in TRACKED_NUMERIC if c in df.columns], [c for c in TRACKED_CATEGORICAL if c in df.columns]


def drift(rows: DataFrame, is_reference: Column, numeric: list[str], categorical: list[str], bins: int = 10, accuracy: int = quantiles.ACCURACY) -> DataFrame:
    """(column, psi) of each column, between the rows that are of the reference and the others, in two scans for any number of columns.

    Population stability: the sum of (p - q) ln(p / q) over levels.  Numbers fall in bins by quantiles of the
    reference, null in a bin of its own.  The first scan sketches all quantiles and counts both sides.  The
    second counts (column, level, side): a number that lies in the bracket of a quantile stays itself, another is the
    gap between two brackets; so quantiles are exact, and what is in one place is bounded by the brackets.
    """
    shares = [i / bins for i in range(1, bins)]
    rows = rows.select(F.coalesce(is_reference, F.lit(False)).alias("_ref"), *(F.col(c).cast("double").alias(f"_{c}") for c in numeric), *(F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias(f"_{c}") for c in categorical))
    own = {c: F.when(F.col("_ref"), F.col(f"_{c}")) for c in numeric}
    sketch = rows.agg(F.count_if("_ref").alias("_np"), F.count_if(~F.col("_ref")).alias("_nq"), *(f for c, v in own.items() for f in (F.count(v).alias(f"_size_{c}"), quantiles.brackets(v, shares, accuracy).alias(f"_edges_{c}"))))

    def cell(c: str) -> Column:
        value, none = F.col(f"_{c}"), F.lit(None)
        if c in categorical:
            return F.struct(F.lit(c).alias("column"), value.alias("level"), none.cast("int").alias("gap"), none.cast("double").alias("v"), none.cast("long").alias("size"))
        size = F.col(f"_size_{c}")
        held = [quantiles.bounds(F.col(f"_edges_{c}"), size, i, q, accuracy) for i, q in enumerate(shares)]
        inside = F.lit(False)
        for low, high in held:
            inside = inside | ((value >= low) & (value <= high))
        gap = sum(((high < value).cast("int") for _, high in held), F.lit(0))
        missing = F.when(value.isNull(), "<null>")
        return F.struct(F.lit(c).alias("column"), missing.alias("level"), F.when(value.isNotNull(), gap).alias("gap"), F.when(inside, value).alias("v"), size.alias("size"))

    seen = rows.crossJoin(F.broadcast(sketch)).select("_ref", "_np", "_nq", F.explode(F.array(*(cell(c) for c in (*numeric, *categorical)))).alias("_cell")).select("_ref", "_np", "_nq", "_cell.*")
    counts = seen.groupBy("column", "level", "gap", "v").agg(F.max("size").alias("size"), F.max("_np").alias("np"), F.max("_nq").alias("nq"), F.count_if("_ref").alias("p"), F.count_if(~F.col("_ref")).alias("q"))
    # Numbers of a column have no level, so they are one partition; a level is one of its own.
    whole = Window.partitionBy("column", "level")
    upto = F.sum("p").over(whole.orderBy("gap", F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", F.when(F.col("gap").isNotNull(), upto))

    def edge(q: float) -> Column:
        rank = F.lit(q) * (F.col("size") - 1)
        at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v"))).over(whole)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        split = F.max(F.col("v").isNull() & (F.col("upto") > F.floor(rank)) & (F.col("upto") - F.col("p") <= F.ceil(rank))).over(whole)
        between = F.when(low == high, low).otherwise((F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high)
        return F.when(split, F.raise_error(F.lit("a bracket does not hold its rank")).cast("double")).otherwise(between)

    binned = placed.withColumn("edges", F.when(F.col("gap").isNotNull() & (F.col("size") > 0), F.array(*(edge(q) for q in shares))))
    place = F.when(F.col("v").isNotNull(), F.size(F.filter("edges", lambda e: e < F.col("v")))).otherwise(F.col("gap"))
    levels = binned.groupBy("column", F.coalesce("level", place.cast("string")).alias("level"), F.col("level").isNull().alias("number")).agg(F.max("np").alias("np"), F.max("nq").alias("nq"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    p, q = (F.greatest(F.try_divide(F.col(x), F.col(f"n{x}")), F.lit(EPSILON)) for x in ("p", "q"))
    return levels.groupBy("column").agg(F.round(F.sum((p - q) * F.ln(p / q)), 6).alias("psi"))


def _sides(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    return reference.select(*columns, F.lit(True).alias("_side")).unionByName(current.select(*columns, F.lit(False).alias("_side")))


def psi_categorical(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    return drift(_sides(reference, current, [column]), F.col("_side"), [], [column])


def psi_numeric(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Bins are deciles of the reference; null is a bin of its own."""
    return drift(_sides(reference, current, [column]), F.col("_side"), [column], [], bins)


def drift_report(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(column, psi, drifted) of the tracked columns that both sides have."""
    numeric, categorical = ([c for c in names if c in reference.columns and c in current.columns] for names in (numeric, categorical))
    return _drifted(drift(_sides(reference, current, [*numeric, *categorical]), F.col("_side"), numeric, categorical))


def drift_of_halves(rows: DataFrame, is_reference: Column) -> DataFrame:
    """``drift_report`` of all watched columns that one table of both sides has."""
    return _drifted(drift(rows, is_reference, *tracked(rows)))


def _drifted(found: DataFrame) -> DataFrame:
    return found.withColumn("drifted", F.col("psi") >= DRIFT)


def drift_priority(report: DataFrame) -> DataFrame:
    share = F.round(F.count_if("drifted") / F.count("*"), 4)
    return report.agg(F.count("*").alias("n_columns"), F.count_if("drifted").alias("n_drifted"), share.alias("share"), ((F.count_if("drifted") > 0) | (share >= DRIFT_SHARE)).alias("breach"))


def write_drift(rows: DataFrame, is_reference: Column, folder: str, date: str) -> bool:
    """Write ``<date>.metrics.json``, and ``<date>.priority.json`` where a watched column drifted.  Whether one did.

    One row a watched column reaches the driver.
    """
    spark = rows.sparkSession
    numeric, categorical = tracked(rows)
    report = drift_of_halves(rows, is_reference).orderBy("column").collect()
    sizes = rows.agg(F.count_if(is_reference).alias("a"), F.count_if(~F.coalesce(is_reference, F.lit(False))).alias("b")).first()
    drifted, total = [r.column for r in report if r.drifted], len(numeric) + len(categorical)
    share = round(len(drifted) / total, 4) if total else 0.0
    breach = bool(drifted) or share >= DRIFT_SHARE
    metrics = {
        "snapshot_date": date,
        "n_current": sizes.b,
        "n_reference": sizes.a,
        "columns_total": total,
        "columns_drifted": drifted,
        "columns_drifted_count": len(drifted),
        "drift_share": share,
        "psi_per_column": {r.column: round(r.psi, 4) for r in report},
        "priority_breach": breach,
        "breached_features": drifted,
        "psi_threshold": DRIFT,
        "drift_share_threshold": DRIFT_SHARE,
    }
    stages.create_once(spark, f"{folder}/{date}.metrics.json", json.dumps(metrics, indent=2))
    if breach:
        reason = "PSI threshold breach" if drifted else "drift_share threshold"
        stages.create_once(spark, f"{folder}/{date}.priority.json", json.dumps({"snapshot_date": date, "reason": reason, "breached_features": drifted, "drift_share": share}, indent=2))
    return breach


def relative_lift(champion: Column, challenger: Column, lower_is_better: Column) -> Column:
    """Relative gain of the challenger; null over a zero champion."""
    gain = (challenger - champion) / F.nullif(F.abs(champion), F.lit(0.0))
    return F.when(lower_is_better, -gain).otherwise(gain)


def gate(metrics: DataFrame) -> DataFrame:
    """(pair, lift, worst_secondary, decision, reason) from rows (pair, metric, is_primary, lower_is_better, champion, challenger)."""
    lift = relative_lift(F.col("champion"), F.col("challenger"), F.col("lower_is_better"))
    rows = metrics.withColumn("lift", lift)
    present = F.col("is_primary") & F.col("champion").isNotNull() & F.col("challenger").isNotNull()
    out = rows.groupBy("pair").agg(F.count_if(present).alias("_has"), F.coalesce(F.max(F.when(present, F.col("lift"))), F.lit(0.0)).alias("lift"), F.min(F.when(~F.col("is_primary"), F.col("lift"))).alias("worst_secondary"))
    reason = F.when(F.col("_has") == 0, "primary metric missing").when(F.col("worst_secondary") < MAX_LOSS, "secondary regression").when(F.col("lift") < MIN_LIFT, "lift below threshold").otherwise("promote")
    return out.select("pair", F.round("lift", 6).alias("lift"), F.round("worst_secondary", 6).alias("worst_secondary"), F.when(reason == "promote", "promote").otherwise("hold").alias("decision"), reason.alias("reason"))


def metric_at(document: Column, path: str) -> Column:
    """A number at a dotted path of a JSON document; booleans count as 0 and 1."""
    raw = F.get_json_object(document, "$." + path)
    return F.when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(raw.try_cast("double"))


def source_health(jobs: DataFrame, stamp: str) -> DataFrame:
    return jobs.groupBy("source").agg(F.count("*").alias("n_jobs"), F.max(stamp).alias("last_seen"))


def health_rollup(runs: DataFrame) -> DataFrame:
    """The latest run of each source, from rows (source, finished_at, n_jobs, n_errors)."""
    return runs.groupBy("source").agg(F.max("finished_at").alias("finished_at"), F.max_by("n_jobs", "finished_at").alias("n_jobs"), F.max_by("n_errors", "finished_at").alias("n_errors"))
