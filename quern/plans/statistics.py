"""Audit statistics and monitoring queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures
from ..operators import modelling, monitoring, sampling, stats
from ..sources import files, stages
from .postings import enriched
from .registry import JOBS, query


def _orders(spark, sf):
    return fixtures.table(spark, sf, "orders")


_ROLES = (
    ("id", "metadata"), ("company_slug", "nominal"), ("company_name", "metadata"), ("title", "text"), ("url", "metadata"), ("location_raw", "metadata"), ("salary_disclosed", "boolean"),
    ("salary_max", "metadata"), ("salary_min", "metadata"), ("salary_currency", "nominal"), ("salary_period", "nominal"), ("source", "nominal"), ("posted_at", "datetime"), ("description_md", "text"),
    ("country", "nominal"), ("region", "nominal"), ("city", "nominal"), ("remote_policy", "nominal"), ("seniority_extracted", "ordinal"), ("role_family_extracted", "nominal"),
    ("salary_min_usd_yearly", "continuous"), ("salary_max_usd_yearly", "target"), ("min_years_experience", "continuous"), ("tech_stack", "list"),
)


@query(JOBS + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{r}' AS role, count({c}) AS n_known FROM jobs" for c, r in _ROLES))
def column_roles(spark, sf):
    """Each column's role, and how many rows have a value in it."""
    rows = enriched(spark, sf)
    roles = stats.column_roles(rows).select("column", "role")
    one = rows.agg(*(F.count(c).alias(c) for c, _ in _ROLES))
    known = one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_known")) for c, _ in _ROLES))))
    return roles.join(known, "column")


_COLS = ("country", "region", "city", "salary_max")


@query(JOBS + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(count(*) FILTER ({c} IS NULL) * 100 / count(*), 1) AS missing_pct FROM jobs" for c in _COLS))
def missing_rates(spark, sf):
    return stats.missing_rates(enriched(spark, sf), list(_COLS))


@query(JOBS + "SELECT 'region' AS a, 'salary_max' AS b, round(corr(CAST(region IS NULL AS INT), CAST(salary_max IS NULL AS INT)), 6) AS r FROM jobs")
def co_missing(spark, sf):
    return stats.co_missing(enriched(spark, sf), ["region", "salary_max"])


_P = "o_totalprice"


_VIF = ("l_quantity", "l_discount", "l_tax")
_G = ", ".join(f"sum({a} * {b}) AS g{i}{j}" for i, a in enumerate(_VIF) for j, b in enumerate(_VIF) if i <= j)


@query(f"""WITH g AS (SELECT {_G} FROM lineitem), d AS (SELECT *, g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02) AS det FROM g)
SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS "column", unnest([round(g00 * (g11 * g22 - g12 * g12) / det, 6), round(g11 * (g00 * g22 - g02 * g02) / det, 6), round(g22 * (g00 * g11 - g01 * g01) / det, 6)]) AS vif FROM d""")
def vif_all(spark, sf):
    found, _ = stats.vif(fixtures.table(spark, sf, "lineitem"), list(_VIF))
    return spark.createDataFrame([(c, round(v, 6)) for c, v in found.items()], "column string, vif double")


@query(f"SELECT count({_P}) AS n, round(avg({_P}), 4) AS mean, median({_P}) AS median, round(stddev_samp({_P}), 4) AS sd, " + ", ".join(f"round(quantile_cont({_P}, {q / 100}), 4) AS p{q}" for q in (10, 25, 75, 90, 99)) + f", round(skewness({_P}), 6) AS skewness, round(kurtosis({_P}), 6) AS kurtosis FROM orders")
def target_summary(spark, sf):
    return stats.target_summary(_orders(spark, sf), _P)


@query("WITH v AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS c, unnest([l_quantity, l_discount, l_tax]) AS x, l_extendedprice AS y FROM lineitem), r AS (SELECT c, x, y, rank() OVER (PARTITION BY c ORDER BY x) + (count(*) OVER (PARTITION BY c, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY c ORDER BY y) + (count(*) OVER (PARTITION BY c, y) - 1) / 2.0 AS ry FROM v) SELECT c AS \"column\", round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY c")
def correlations(spark, sf):
    return stats.correlations(fixtures.table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query("WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1 HAVING count(*) >= 5), s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * m) AS s1, sum(n * m * m) AS s2, sum((n - 1) * v) AS w FROM g) SELECT k, n, round(((s2 - s1 * s1 / n) / (k - 1)) / (w / (n - k)), 4) AS f FROM s")
def anova_f(spark, sf):
    return stats.anova(_orders(spark, sf), "o_orderpriority", _P)


@query("SELECT count(*) FILTER (s) AS n_a, count(*) FILTER (NOT s) AS n_b, round((avg(p) FILTER (s) - avg(p) FILTER (NOT s)) / sqrt(var_samp(p) FILTER (s) / count(*) FILTER (s) + var_samp(p) FILTER (NOT s) / count(*) FILTER (NOT s)), 6) AS t FROM (SELECT o_totalprice AS p, o_orderstatus = 'O' AS s FROM orders)")
def welch_t(spark, sf):
    return stats.welch_t(_orders(spark, sf), F.col("o_orderstatus") == "O", _P)


@query("WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY ALL), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY b), e AS (SELECT r.a, k.b, ra * cb / (SELECT sum(o) FROM c) AS e FROM r, k) SELECT CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS BIGINT) AS dof, round(sum((coalesce(o, 0) - e) ** 2 / e), 4) AS statistic FROM e LEFT JOIN c USING (a, b)")
def chi2_stat(spark, sf):
    return stats.chi_square(_orders(spark, sf), F.col("o_orderstatus"), F.col("o_orderpriority"))


@query("SELECT round(1 / (1 - xy * xy / (xx * yy)), 6) AS vif FROM (SELECT sum(l_quantity ** 2) AS xx, sum(l_extendedprice ** 2) AS yy, sum(l_quantity * l_extendedprice) AS xy FROM lineitem)")
def vif2(spark, sf):
    return stats.vif_two(fixtures.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("WITH s AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d FROM orders) SELECT 'o_totalprice' AS \"column\", round(any_value(a - 1.5 * (b - a)), 4) AS low, round(any_value(b + 1.5 * (b - a)), 4) AS high, count(*) FILTER (o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) AS n_iqr, count(*) FILTER (abs(o_totalprice - m) > 3 * d) AS n_z FROM orders, s")
def iqr_outliers(spark, sf):
    return stats.outliers(_orders(spark, sf), [_P])


@query("SELECT CAST(floor(o_totalprice / 50000) + 1 AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1")
def histogram_bins(spark, sf):
    return stats.histogram(_orders(spark, sf), _P, 0.0, 500_000.0 * 2, 20)


@query("SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def grouped_medians(spark, sf):
    return stats.grouped_medians(_orders(spark, sf), "o_orderpriority", _P)


@query()
def bootstrap_ci(spark, sf):
    return modelling.bootstrap_mean(fixtures.table(spark, sf, "customer"), "c_acctbal", "c_custkey")


# --- monitoring -------------------------------------------------------------------------


def _sides(spark, sf):
    events = fixtures.table(spark, sf, "events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut)


_CUT = "ts < TIMESTAMP '2024-01-16'"
_PSI = "round(sum((greatest(coalesce(p, 0) / np, 1e-6) - greatest(coalesce(q, 0) / nq, 1e-6)) * ln(greatest(coalesce(p, 0) / np, 1e-6) / greatest(coalesce(q, 0) / nq, 1e-6))), 6)"
_LEVELS = f"SELECT level, count(*) FILTER ({_CUT}) AS p, count(*) FILTER (NOT {_CUT}) AS q FROM e GROUP BY 1"
_TOTALS = f"SELECT count(*) FILTER ({_CUT}) AS np, count(*) FILTER (NOT {_CUT}) AS nq FROM e"


@query(f"WITH e AS (SELECT *, event_type AS level FROM events) SELECT 'event_type' AS \"column\", {_PSI} AS psi FROM ({_LEVELS}), ({_TOTALS})")
def psi_categorical(spark, sf):
    return monitoring.psi_categorical(*_sides(spark, sf), "event_type")


_DECILES = f"(SELECT quantile_cont(value, [{', '.join(str(i / 10) for i in range(1, 10))}]) FROM events WHERE {_CUT})"


@query(f"WITH e AS (SELECT *, len(list_filter({_DECILES}, lambda x: x < value)) AS level FROM events) SELECT 'value' AS \"column\", {_PSI} AS psi FROM ({_LEVELS}), ({_TOTALS})")
def psi_numeric(spark, sf):
    return monitoring.psi_numeric(*_sides(spark, sf), "value")


_HALF = "CAST(('0x' || substr(sha256('7::' || id), 1, 16)) AS UBIGINT) / 1.8446744073709552e19 < 0.5"
_NUMERIC = ("salary_min_usd_yearly", "salary_max_usd_yearly", "predicted_salary_usd_v1", "min_years_experience")
_CATEGORICAL = ("country", "remote_policy", "source", "seniority_extracted", "role_family_extracted", "salary_disclosed")


def _tracked_sql(column):
    if column in _NUMERIC:
        cuts = f"(SELECT quantile_cont({column}, [{', '.join(str(i / 10) for i in range(1, 10))}]) FROM h WHERE half)"
        level = f"CASE WHEN {column} IS NULL THEN -1 ELSE len(list_filter({cuts}, lambda x: x < {column})) END"
    else:
        level = f"coalesce(CAST({column} AS VARCHAR), '<missing>')"
    levels = f"SELECT {level} AS level, count(*) FILTER (half) AS p, count(*) FILTER (NOT half) AS q FROM h GROUP BY 1"
    return f"SELECT '{column}' AS \"column\", {_PSI} AS psi FROM ({levels}), (SELECT count(*) FILTER (half) AS np, count(*) FILTER (NOT half) AS nq FROM h)"


_DRIFT = JOBS + f", h AS (SELECT *, {_HALF} AS half FROM jobs), report AS ({' UNION ALL '.join(_tracked_sql(c) for c in (*_NUMERIC, *_CATEGORICAL))}) "


def _drift(spark, sf):
    """All watched columns that derived postings have, between two hashed halves."""
    rows = sampling.halves(enriched(spark, sf), 7, "id")
    return monitoring.drift_of_halves(rows, F.col("half") == "reference")


@query(_DRIFT + 'SELECT "column", psi, psi >= 0.2 AS drifted FROM report')
def drift_tracked(spark, sf):
    return _drift(spark, sf)


@query(_DRIFT + "SELECT count(*) AS n_columns, count(*) FILTER (psi >= 0.2) AS n_drifted, round(count(*) FILTER (psi >= 0.2) / count(*), 4) AS share, count(*) FILTER (psi >= 0.2) > 0 AS breach FROM report")
def drift_share(spark, sf):
    return monitoring.drift_priority(_drift(spark, sf))


#: (metric, primary, lower is better, measure) of each priority's orders: those of odd keys challenge those of even ones.
_MEASURES = (("price", True, False, "avg(o_totalprice)"), ("spread", False, True, "stddev_samp(o_totalprice)"), ("least", False, False, "-min(o_totalprice)"))


def _measured(side):
    return ", ".join(f"{m} FILTER (WHERE o_orderkey % 2 = {side}) AS {n}_{side}" for n, _, _, m in _MEASURES)


_GATE = f"SELECT o_orderpriority AS pair, {_measured(0)}, {_measured(1)} FROM orders GROUP BY 1"


@query(f"""WITH o AS ({_GATE}), m AS (SELECT *, CASE WHEN lower THEN -1 ELSE 1 END * (b - a) / nullif(abs(a), 0) AS lift FROM (
{' UNION ALL '.join(f"SELECT pair, {str(p).lower()} AS prim, {str(low).lower()} AS lower, {n}_0 AS a, {n}_1 AS b FROM o" for n, p, low, _ in _MEASURES)})),
g AS (SELECT pair, count(*) FILTER (prim AND a IS NOT NULL AND b IS NOT NULL) AS has, coalesce(max(lift) FILTER (prim), 0) AS lift, min(lift) FILTER (NOT prim) AS worst FROM m GROUP BY pair)
SELECT pair, round(lift, 6) AS lift, round(worst, 6) AS worst_secondary, CASE WHEN has > 0 AND NOT coalesce(worst < -0.02, false) AND lift >= 0.01 THEN 'promote' ELSE 'hold' END AS decision,
    CASE WHEN has = 0 THEN 'primary metric missing' WHEN worst < -0.02 THEN 'secondary regression' WHEN lift < 0.01 THEN 'lift below threshold' ELSE 'promote' END AS reason FROM g""")
def gate_decision(spark, sf):
    """Whether a priority's orders of odd keys would take the place of those of even keys."""
    wide = spark.sql(_GATE.replace("FROM orders", "FROM {orders}"), orders=_orders(spark, sf))
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.lit(p).alias("is_primary"), F.lit(low).alias("lower_is_better"), F.col(f"{n}_0").alias("champion"), F.col(f"{n}_1").alias("challenger")) for n, p, low, _ in _MEASURES))
    return monitoring.gate(wide.select("pair", F.inline(rows)))


@query(JOBS + "SELECT source, count(*) AS n_jobs, max(posted_at) AS last_seen FROM jobs0 GROUP BY 1")
def health_fallback(spark, sf):
    return monitoring.source_health(fixtures.jobs(spark, sf), "posted_at")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events")
def metric_path(spark, sf):
    return fixtures.table(spark, sf, "events").select("event_id", monitoring.metric_at(F.col("props"), "k").alias("v"))


@query(_DRIFT + """SELECT '2026-05-22' AS snapshot_date, (SELECT count(*) FROM h WHERE half) AS n_reference, (SELECT count(*) FROM h WHERE NOT half) AS n_current, count(*) AS columns_total,
    count(*) FILTER (psi >= 0.2) AS columns_drifted_count, round(count(*) FILTER (psi >= 0.2) / count(*), 4) AS drift_share, count(*) FILTER (psi >= 0.2) > 0 OR count(*) FILTER (psi >= 0.2) / count(*) >= 0.3 AS priority_breach,
    coalesce(list_sort(list("column") FILTER (psi >= 0.2)), []) AS breached_features, round(sum(round(psi, 4)), 4) AS psi_sum FROM report""")
def drift_artifacts(spark, sf):
    """What a drift run writes for a date, read back from the file."""
    rows = sampling.halves(enriched(spark, sf), 7, "id")
    folder = f"{stages.shared_folder(spark)}/drift-{uuid.uuid4().hex}"
    monitoring.write_drift(rows, F.col("half") == "reference", folder, "2026-05-22")
    kinds = "snapshot_date string, n_reference long, n_current long, columns_total long, columns_drifted_count long, drift_share double, priority_breach boolean, breached_features array<string>, psi_per_column map<string, double>"
    read = spark.read.schema(kinds).option("multiLine", "true").json(f"{folder}/2026-05-22.metrics.json")
    total = F.aggregate(F.map_values("psi_per_column"), F.lit(0.0), lambda s, v: s + v)
    return read.select("*", F.round(total, 4).alias("psi_sum")).drop("psi_per_column")


_RUNS = "SELECT event_type AS source, CAST(ts AS DATE) AS day, max(ts) AS finished_at, count(*) AS n_jobs, count(*) FILTER (WHERE value < 10) AS n_errors FROM {events} GROUP BY 1, 2"


@query(f"SELECT source, max(finished_at) AS finished_at, arg_max(n_jobs, finished_at) AS n_jobs, arg_max(n_errors, finished_at) AS n_errors FROM ({_RUNS.format(events='events')}) GROUP BY 1")
def health_rollup(spark, sf):
    """The latest of each source's daily runs, from the artefacts that the runs left: one JSON line each."""
    runs = spark.sql(_RUNS, events=fixtures.table(spark, sf, "events"))
    path = f"{stages.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    # As text, since JSON would keep milliseconds alone.
    runs.withColumn("finished_at", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).write.json(path)
    read = files.read_jsonl(spark, path, "source string, finished_at string, n_jobs long, n_errors long", ("source",))
    return monitoring.health_rollup(read.withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz")))
