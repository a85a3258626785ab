"""The modelling table, linear models with their errors, searches over settings, bootstraps and label joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import cascade
from ..functions.rules import quoted
from ..operators import features, modelling, models, sampling
from ..schema import ROLE_FAMILIES, SENIORITY_LEVELS
from .learning import _matrix, _preds
from .postings import _QUALITY, enriched
from .registry import JOBS, query

_HASH = "CAST(('0x' || substr(sha256('42::' || id), 1, 16)) AS UBIGINT) / 1.8446744073709552e19"
_MODEL = (
    JOBS
    + f""", kept AS (SELECT * FROM jobs WHERE {_QUALITY} = 'real' AND salary_disclosed AND salary_max_usd_yearly >= 30000), cap AS (SELECT quantile_cont(salary_max_usd_yearly, 0.995) AS cap FROM kept),
t AS (SELECT id, country, region, min_years_experience, least(salary_max_usd_yearly, cap) AS y_raw, coalesce(country, 'None') || '/' || source AS stratum, {_HASH} < 0.2 AS is_test FROM kept, cap)"""
)
_FEATURES = ["country", "region", "min_years_experience", "no_such_column"]


def _table(spark, sf):
    return modelling.modelling_table(enriched(spark, sf), cascade.posting_quality(F.col("title")) == "real", _FEATURES)


@query(_MODEL + " SELECT id, country, region, min_years_experience, round(log10(y_raw), 8) AS y, round(y_raw, 4) AS y_raw, stratum, is_test FROM t")
def dataset_build(spark, sf):
    return _table(spark, sf).withColumns({"y": F.round("y", 8), "y_raw": F.round("y_raw", 4)})


@query(_MODEL + " SELECT stratum, count(*) AS n, count(*) FILTER (is_test) AS n_test FROM t GROUP BY 1")
def dataset_strata(spark, sf):
    return sampling.strata_counts(_table(spark, sf), F.col("is_test"), "stratum").select("stratum", "n", "n_test")


@query(
    """WITH s AS (SELECT count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
e AS (SELECT s.*, (SELECT sum((l_extendedprice - a - b * l_quantity) ** 2) FROM lineitem, s) / (n - 2) AS mse FROM s)
SELECT 'intercept' AS term, round(a, 4) AS coef, round(sqrt(mse * (1 / n + (sx / n) ** 2 / sxx)), 4) AS std_err, round(a / sqrt(mse * (1 / n + (sx / n) ** 2 / sxx)), 4) AS t_value FROM e
UNION ALL SELECT 'l_quantity', round(b, 4), round(sqrt(mse / sxx), 4), round(b / sqrt(mse / sxx), 4) FROM e"""
)
def ols_errors(spark, sf):
    done = modelling.ols_table(fixtures.table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return done.select("term", *(F.round(c, 4).alias(c) for c in ("coef", "std_err", "t_value")))


@query()
def train_mincer(spark, sf):
    """Coefficients with standard errors, p-values and intervals."""
    data, names = _matrix(spark, sf, features.WAGE_BLOCK | {"ordinal": {"seniority_extracted": list(SENIORITY_LEVELS)}})
    return modelling.ols_table(data.where("not held"), names, "y")


@query()
def train_ridge_cv(spark, sf):
    data, names = _matrix(spark, sf)
    model = modelling.ridge_cv(data.where("not held"), names, "y", "id")
    return models.overall(model.transform(data.where("held")), "y", "prediction").withColumn("alpha", F.lit(model.alpha))


@query()
def train_boosted_search(spark, sf):
    """All fifty trials by number: settings, the rung each reached, its error, and which one won.

    Trees are few and shallow here; the search takes its ranges as a parameter, and their defaults go to 1,500 trees.
    """
    data, _ = _matrix(spark, sf)
    ranges = modelling.BOOSTED_RANGES | {"maxIter": (3, 9), "maxDepth": (2, 4)}
    found = modelling.boosted_search(data.where("not held"), "y", "id", ranges=ranges)
    names = list(ranges)
    rows = [(t.number, *(float(t.settings[n]) for n in names), t.rung, t.error, t is found.best) for t in found.trials]
    return spark.createDataFrame(rows, f"trial int, {', '.join(f'{n} double' for n in names)}, rung int, error double, won boolean")


@query()
def score_salaries(spark, sf):
    data, names = _matrix(spark, sf)
    model = modelling.ridge_cv(data.where("not held"), names, "y", "id")
    return modelling.scored_salaries(data.select("id", *(F.col(f"`{n}`") for n in names)), model.transform).select("id", "predicted_salary_usd_v1")


@query()
def bootstrap_mae(spark, sf):
    return modelling.bootstrap_mae(_preds(spark, sf), "y", "p", "id")


@query()
def bootstrap_f1(spark, sf):
    both = fixtures.table(spark, sf, "labels").join(fixtures.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return modelling.bootstrap_f1(both.withColumn("guess", (F.col("n_chars") > 500).cast("int")), "quality", "guess", "doc_id", [0, 1])


def _labelled_sql(column):
    return JOBS + f", l AS (SELECT *, CASE WHEN k % 50 <> 0 THEN {column} END AS label FROM jobs) "


def _labelled(spark, sf, column):
    return enriched(spark, sf).withColumn("label", F.when(F.col("k") % 50 != 0, F.col(column)))


@query(_labelled_sql("seniority_extracted") + "SELECT id, label FROM l WHERE label IS NOT NULL AND label NOT IN ('mid')")
def confident_seniority(spark, sf):
    return modelling.confident(_labelled(spark, sf, "seniority_extracted"), "label", modelling.VAGUE["seniority"]).select("id", "label")


@query(_labelled_sql("role_family_extracted") + "SELECT id, label FROM l WHERE label IS NOT NULL AND label NOT IN ('Other', 'Manager')")
def confident_role(spark, sf):
    return modelling.confident(_labelled(spark, sf, "role_family_extracted"), "label", modelling.VAGUE["role_family"]).select("id", "label")


_KNOWN = tuple(r for r in ROLE_FAMILIES if r not in modelling.VAGUE["role_family"])


@query(_labelled_sql("role_family_extracted") + f"SELECT label IN ({', '.join(quoted(x) for x in _KNOWN)}) AS in_vocabulary, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY 1")
def vocabulary_split(spark, sf):
    return modelling.vocabulary_split(_labelled(spark, sf, "role_family_extracted"), "label", list(_KNOWN))


@query("SELECT o_orderkey, o_orderstatus, l_returnflag AS label FROM orders JOIN (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS r FROM lineitem) ON o_orderkey = l_orderkey WHERE r = 1")
def label_join(spark, sf):
    orders = fixtures.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    lines = fixtures.table(spark, sf, "lineitem")
    order = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    labels = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("label"), *order)
    return modelling.with_label(orders, labels, "o_orderkey", *order).select("o_orderkey", "o_orderstatus", "label")


@query("SELECT doc_id, lang, quality AS proposed, e.label AS predicted FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN embeddings e ON vec_id = doc_id")
def review_packets(spark, sf):
    t = lambda n: fixtures.table(spark, sf, n)
    proposals = t("labels").select("doc_id", F.col("quality").alias("proposed"))
    predictions = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("predicted"))
    return modelling.review_packet(t("documents").select("doc_id", "lang"), proposals, predictions, "doc_id")


@query("SELECT label, source, count(*) AS n FROM (SELECT CASE WHEN toxic = 1 THEN 'skipped' ELSE CAST(quality AS VARCHAR) END AS label, source FROM labels JOIN documents USING (doc_id)) WHERE label <> 'skipped' GROUP BY 1, 2")
def label_counters(spark, sf):
    both = fixtures.table(spark, sf, "labels").join(fixtures.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return modelling.label_counts(both.withColumn("label", F.when(F.col("toxic") == 1, "skipped").otherwise(F.col("quality").cast("string"))), "label", "source")
