"""Analytic views, market rollups and keyword search over postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lets import unnested
from . import quantiles

_MAX = "salary_max_usd_yearly"


def grouped(df: DataFrame, keys: Sequence[str], plain: Sequence[Column], wanted: dict[str, tuple[str, float]], approx: bool = False) -> DataFrame:
    """Aggregates and quantiles by group: exact in two passes by default, approximate in one."""
    if not approx:
        return quantiles.aggregate(df, keys, plain, wanted)
    return df.groupBy(*keys).agg(*plain, *(F.percentile_approx(c, q, 10_000).alias(n) for n, (c, q) in wanted.items()))


def _disclosed() -> Column:
    return F.sum(F.when(F.col("salary_disclosed"), 1))


def by_country(jobs: DataFrame, approx: bool = False) -> DataFrame:
    plain = [F.count("*").alias("n_jobs"), _disclosed().alias("n_disclosed"), F.avg(_MAX).alias("avg_max")]
    return grouped(jobs, ["country"], plain, {"p50_max": (_MAX, 0.5), "p75_max": (_MAX, 0.75)}, approx).orderBy(F.desc("n_jobs"), F.asc_nulls_last("country"))


def by_source(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("source").agg(F.count("*").alias("n_jobs"), F.avg(F.col("salary_disclosed").cast("double")).alias("disclosure_rate"), F.avg("salary_max_usd_yearly").alias("avg_max")).orderBy(F.desc("n_jobs"), "source")


def by_role_family(jobs: DataFrame, approx: bool = False) -> DataFrame:
    plain = [F.count("*").alias("n_jobs"), F.avg(_MAX).alias("avg_max"), F.avg("min_years_experience").alias("avg_years")]
    return grouped(jobs, ["role_family_extracted"], plain, {"median_max": (_MAX, 0.5)}, approx).orderBy(F.desc("n_jobs"), "role_family_extracted")


def by_seniority(jobs: DataFrame, approx: bool = False) -> DataFrame:
    return grouped(jobs.where("salary_disclosed"), ["seniority_extracted"], [F.count("*").alias("n_jobs")], {f"p{int(q * 100)}_max": (_MAX, q) for q in (0.25, 0.5, 0.75)}, approx)


def by_company(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("company_slug", "company_name", "source").agg(F.count("*").alias("n_jobs"), _disclosed().alias("n_disclosed"), F.avg("salary_max_usd_yearly").alias("avg_max")).orderBy(F.desc("n_jobs"), "company_slug", "source")


def remote_mix(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.coalesce("remote_policy", F.lit("<unknown>")).alias("remote_policy")).agg(F.count("*").alias("n_jobs")).orderBy(F.desc("n_jobs"), "remote_policy")


def salary_distribution(jobs: DataFrame, role: str, seniority: str, value: str) -> DataFrame:
    known = jobs.where(F.col(role).isNotNull() & F.col(seniority).isNotNull()).select(F.col(role).alias("role_family"), F.col(seniority).alias("seniority"), F.col(value).alias("value"))
    return grouped(known, ["role_family", "seniority"], [F.count("value").alias("n")], {f"p{int(q * 100)}": ("value", q) for q in (0.25, 0.5, 0.75)})


def top_companies(jobs: DataFrame, role: str, families: tuple[str, ...], n: int) -> DataFrame:
    """Rows by role family of the n companies with most rows; the total leaves out rows without family."""
    top = jobs.groupBy("company_name").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "company_name").limit(n).select("company_name")
    # At most n names.
    wide = jobs.join(F.broadcast(top), "company_name").groupBy("company_name").pivot(role, list(families)).count().na.fill(0)
    return wide.withColumn("total", sum((F.col(f"`{f}`") for f in families), F.lit(0)).cast("long"))


def role_share(jobs: DataFrame, role: str) -> DataFrame:
    totals = jobs.groupBy("country").agg(F.count("*").alias("total"))
    counts = jobs.where(F.col(role).isNotNull() & F.col("country").isNotNull()).groupBy("country", F.col(role).alias("role_family")).agg(F.count("*").alias("n"))
    return counts.join(totals, "country").select("country", "role_family", "n", F.round(F.col("n") * 100 / F.col("total"), 1).alias("share"))


def top_values(jobs: DataFrame, list_col: str, n: int, name: str = "skill") -> DataFrame:
    """The n most frequent items of a list column; no rows where the column is missing."""
    if list_col not in jobs.columns:
        return jobs.sparkSession.createDataFrame([], f"{name} string, n long")
    return unnested(jobs, list_col, name).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(n)


def headline(jobs: DataFrame) -> DataFrame:
    disclosed = F.col("salary_disclosed")
    rows = jobs.select("company_slug", "salary_disclosed", F.when(disclosed, F.col(_MAX)).alias("_max"), "predicted_salary_usd_v1")
    plain = [F.count("*").alias("n_jobs"), F.count_distinct("company_slug").alias("n_companies"), F.round(F.avg(disclosed.cast("double")), 3).alias("disclosure_rate")]
    one = grouped(rows, [], plain, {"median_max": ("_max", 0.5), "median_predicted": ("predicted_salary_usd_v1", 0.5)})
    return one.select("n_jobs", "n_companies", "median_max", "median_predicted", "disclosure_rate")


def search(jobs: DataFrame, text: str | None = None, country: str | None = None, role: str | None = None, disclosed: bool = False, limit: int = 50) -> DataFrame:
    """Postings whose title or company holds the text, latest first."""
    found = jobs
    if text:
        found = found.where(F.lower("title").contains(text.lower()) | F.lower("company_name").contains(text.lower()))
    if country:
        found = found.where(F.col("country") == country)
    if role:
        found = found.where(F.col("role_family_extracted") == role)
    if disclosed:
        found = found.where("salary_disclosed")
    return found.orderBy(F.desc_nulls_last("posted_at"), "id").limit(limit)


def retrieval_filter(countries=(), seniorities=(), roles=(), salary_gte: float | None = None, salary_lte: float | None = None, posted_from: str | None = None) -> Column | None:
    """All given conditions together; None if there are none."""
    parts = [F.col(c).isin(*v) for c, v in (("country", countries), ("seniority_extracted", seniorities), ("role_family_extracted", roles)) if v]
    if salary_gte is not None:
        parts.append(F.col("salary_max_usd_yearly") >= salary_gte)
    if salary_lte is not None:
        parts.append(F.col("salary_min_usd_yearly") <= salary_lte)
    if posted_from:
        parts.append(F.col("posted_at") >= F.lit(posted_from).cast("timestamp_ntz"))
    out = None
    for part in parts:
        out = part if out is None else out & part
    return out


def bound(jobs: DataFrame, sql: str, **values: object) -> DataFrame:
    """A statement over ``{jobs}`` with named parameters (``:name``); values are bound, never written into the text."""
    return jobs.sparkSession.sql(sql, args=values, jobs=jobs)


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, fill_rate, n_distinct) in one pass over the rows."""
    aggs = [a for c in columns for a in (F.count(c).alias(f"n_{c}"), F.count_distinct(F.col(c).cast("string")).alias(f"d_{c}"))]
    one = df.agg(F.count("*").alias("_total"), *aggs)
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.round(F.col(f"n_{c}") / F.col("_total"), 4).alias("fill_rate"), F.col(f"d_{c}").alias("n_distinct")) for c in columns)))
    return one.select(stacked.alias("s")).select("s.*")


def hit_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, hit_pct): how many rows in a hundred have a value, to one place."""
    one = df.agg(*(F.round(100.0 * F.count(c) / F.count("*"), 1).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("hit_pct")) for c in columns))))


def value_counts(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("<missing>")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def filter_funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(step, stage, n): rows left after each stage, in one pass."""
    passed, aggs = F.lit(True), []
    for name, rule in stages:
        passed = passed & F.coalesce(rule, F.lit(False))
        aggs.append(F.count_if(passed).alias(name))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("step"), F.lit(n).alias("stage"), F.col(n).alias("n")) for i, (n, _) in enumerate(stages)))).alias("s")).select("s.*")


def winsorized(df: DataFrame, column: str, q: float = 0.995) -> DataFrame:
    """The column capped at its q-quantile, which is one row."""
    cap = quantiles.aggregate(df.select(column), [], [], {"_cap": (column, q)})
    return df.join(F.broadcast(cap)).withColumn(column, F.least(column, "_cap")).drop("_cap")
