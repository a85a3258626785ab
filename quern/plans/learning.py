"""Encodings, baselines, metrics and trained models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import cascade, title
from ..operators import encode, features, modelling, models, probe, retrieval, sampling
from ..sources import files, stages
from ..schema import SENIORITY_LEVELS
from .postings import enriched
from .registry import JOBS, query

_TRAIN = "k % 5 <> 0"


@query(JOBS + "SELECT id, CAST(coalesce(list_position([" + ", ".join(f"'{s}'" for s in SENIORITY_LEVELS) + "], seniority_extracted), 0) - 1 AS BIGINT) AS code FROM jobs")
def enc_ordinal(spark, sf):
    return enriched(spark, sf).select("id", encode.ordinal(F.col("seniority_extracted"), SENIORITY_LEVELS).alias("code"))


@query(JOBS + "SELECT id, CAST(coalesce(country = 'US', false) AS BIGINT) AS country_US, CAST(coalesce(country = 'CA', false) AS BIGINT) AS country_CA, CAST(country IS NULL AS BIGINT) AS country_missing FROM jobs")
def enc_onehot(spark, sf):
    return enriched(spark, sf).select("id", *(c.alias(n) for n, c in encode.one_hot(F.col("country"), ["US", "CA"], "country").items()))


@query(JOBS + f", t AS (SELECT *, salary_max_usd_yearly AS y FROM jobs WHERE salary_disclosed), g AS (SELECT avg(y) AS g FROM t WHERE {_TRAIN}), s AS (SELECT region, count(y) AS n, avg(y) AS m FROM t WHERE {_TRAIN} GROUP BY 1) SELECT id, round(coalesce((n * m + 30 * g) / (n + 30), g), 4) AS enc FROM t LEFT JOIN s ON t.region IS NOT DISTINCT FROM s.region, g")
def enc_target(spark, sf):
    jobs = enriched(spark, sf).where("salary_disclosed")
    return encode.smoothed_mean(jobs, F.expr(_TRAIN), ["region"], "salary_max_usd_yearly", "enc").select("id", F.round("enc", 4).alias("enc"))


@query(JOBS + f"SELECT id, CAST(coalesce(x, false) AS BIGINT) AS call, CAST(x IS NULL AS BIGINT) AS call__isna FROM (SELECT id, CAST({cascade.ON_CALL.sql('description_md')} AS BOOLEAN) AS x FROM jobs0)")
def enc_bool(spark, sf):
    value = cascade.ON_CALL.column(F.col("description_md")) == "true"
    return fixtures.jobs(spark, sf).select("id", *(c.alias(n) for n, c in encode.boolean(value, "call").items()))


@query(JOBS + f"SELECT id, CAST(coalesce(x = 'yes', false) AS BIGINT) AS visa_yes, CAST(coalesce(x = 'no', false) AS BIGINT) AS visa_no, CAST(coalesce(x = 'unspecified', false) AS BIGINT) AS visa_unspecified, CAST(coalesce(x NOT IN ('yes', 'no', 'unspecified'), true) AS BIGINT) AS visa_missing FROM (SELECT id, {cascade.VISA.sql('description_md')} AS x FROM jobs0)")
def enc_tristate(spark, sf):
    return fixtures.jobs(spark, sf).select("id", *(c.alias(n) for n, c in encode.tri_state(cascade.VISA.column(F.col("description_md")), "visa").items()))


@query(JOBS + f", v AS (SELECT list(t) AS v FROM (SELECT t FROM (SELECT unnest(tech_stack) AS t FROM jobs WHERE {_TRAIN}) GROUP BY t ORDER BY count(*) DESC, t LIMIT 3)) SELECT id, CAST(list_has_any(coalesce(tech_stack, []), v) AS BIGINT) AS tech__has_any, CAST(coalesce(len(tech_stack), 0) AS BIGINT) AS tech__count, CAST(list_has_any(coalesce(tech_stack, []), ['PyTorch', 'TensorFlow', 'HuggingFace', 'MLflow', 'Weights & Biases', 'Spark', 'Databricks', 'LLMs', 'RAG', 'scikit-learn', 'XGBoost']) AS BIGINT) AS tech__modern_ml FROM jobs, v")
def enc_tech(spark, sf):
    jobs = enriched(spark, sf)
    block = encode.tech_block(F.col("tech_stack"), encode.vocabulary(jobs, F.expr(_TRAIN), "tech_stack", 3), cascade.MODERN_ML)
    return jobs.select("id", *(block[n].alias(n) for n in ("tech__has_any", "tech__count", "tech__modern_ml")))


@query(JOBS + f", r AS (SELECT CAST(max(posted_at) AS DATE) AS ref FROM jobs0 WHERE {_TRAIN}), d AS (SELECT *, greatest(date_diff('day', CAST(posted_at AS DATE), ref), 0) AS days FROM jobs0, r), m AS (SELECT median(days) AS mid FROM d WHERE posted_at IS NOT NULL) SELECT id, coalesce(CASE WHEN posted_at IS NOT NULL THEN CAST(days AS DOUBLE) END, mid) AS days_since, round(sin(2 * pi() * coalesce(month(posted_at), 6) / 12), 6) AS month_sin, CAST(posted_at IS NULL AS BIGINT) AS posted_missing FROM d, m")
def enc_datetime(spark, sf):
    return encode.datetime_block(fixtures.jobs(spark, sf), F.expr(_TRAIN), "posted_at").select("id", "days_since", F.round("month_sin", 6).alias("month_sin"), "posted_missing")


@query(JOBS + f", m AS (SELECT median(min_years_experience) AS mid FROM jobs WHERE {_TRAIN}) SELECT id, coalesce(CAST(min_years_experience AS DOUBLE), mid) AS yoe, coalesce(CAST(min_years_experience AS DOUBLE), mid) ** 2 AS yoe_sq, CAST(min_years_experience IS NULL AS BIGINT) AS yoe__isna FROM jobs, m")
def enc_mincer(spark, sf):
    return encode.experience_block(enriched(spark, sf), F.expr(_TRAIN), "min_years_experience").select("id", "yoe", "yoe_sq", "yoe__isna")


@query(JOBS + f", f AS (SELECT id, k, coalesce(CAST(min_years_experience AS DOUBLE), (SELECT median(min_years_experience) FROM jobs WHERE {_TRAIN})) AS x FROM jobs) SELECT id, round((x - (SELECT avg(x) FROM f WHERE {_TRAIN})) / (SELECT stddev_pop(x) FROM f WHERE {_TRAIN}), 6) AS z FROM f")
def enc_scale(spark, sf):
    return encode.scaled(enriched(spark, sf), F.expr(_TRAIN), ["min_years_experience"]).select("id", F.round("min_years_experience_z", 6).alias("z"))


_PREDS = JOBS + ", p AS (SELECT id, country, k, log10(salary_max_usd_yearly) AS y, log10(predicted_salary_usd_v1) AS p FROM jobs WHERE salary_disclosed AND salary_max_usd_yearly > 0)"
_METRIC = "count(*) AS n, round(avg(abs(10 ** y - 10 ** p)), 2) AS mae, round(avg(abs(10 ** y - 10 ** p) / greatest(10 ** y, 1)) * 100, 4) AS mape, round(1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) ** 2 / count(y)), 4) AS r2"


def _preds(spark, sf):
    jobs = enriched(spark, sf).where("salary_disclosed and salary_max_usd_yearly > 0")
    return jobs.select("id", "country", "k", F.log10("salary_max_usd_yearly").alias("y"), F.log10("predicted_salary_usd_v1").alias("p"))


@query(_PREDS + f"SELECT {_METRIC} FROM p")
def metrics_mae(spark, sf):
    return models.overall(_preds(spark, sf), "y", "p")


@query(_PREDS + f"SELECT country, {_METRIC} FROM p GROUP BY 1 HAVING count(*) >= 5")
def metrics_strata(spark, sf):
    return models.by_stratum(_preds(spark, sf), "y", "p", "country")


@query(_PREDS + f"SELECT id, round((SELECT avg(y) FROM p WHERE {_TRAIN}), 6) AS prediction FROM p")
def tier0(spark, sf):
    return models.constant_baseline(_preds(spark, sf).drop("p"), F.expr(_TRAIN), "y").select("id", F.round("prediction", 6).alias("prediction"))


@query(_PREDS + f", s AS (SELECT country, count(y) AS n, avg(y) AS m FROM p WHERE {_TRAIN} GROUP BY 1) SELECT id, round(coalesce((n * m + 30 * g) / (n + 30), g), 6) AS prediction FROM p LEFT JOIN s ON p.country IS NOT DISTINCT FROM s.country, (SELECT avg(y) AS g FROM p WHERE {_TRAIN})")
def tier1(spark, sf):
    return models.stratified_baseline(_preds(spark, sf).drop("p"), F.expr(_TRAIN), ["country"], "y").select("id", F.round("prediction", 6).alias("prediction"))


@query(_PREDS + f", b AS (SELECT y, (SELECT avg(y) FROM p) AS c, p FROM p) SELECT 'given' AS model, {_METRIC} FROM p UNION ALL SELECT 'mean' AS model, {_METRIC.replace('10 ** p', '10 ** c').replace('y - p', 'y - c')} FROM b")
def leaderboard(spark, sf):
    preds = _preds(spark, sf)
    mean = preds.drop("p").join(F.broadcast(preds.agg(F.avg("y").alias("p"))))
    named = lambda name, df: models.overall(df, "y", "p").select(F.lit(name).alias("model"), "n", "mae", "mape", "r2")
    return models.leaderboard(named("given", preds).union(named("mean", mean)))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 8) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_simple(spark, sf):
    return models.simple_ols(fixtures.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("SELECT quality, count(*) AS n_c, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY 1")
def class_weights(spark, sf):
    return models.class_weights(fixtures.table(spark, sf, "labels"), "quality")


@query("""WITH c AS (SELECT quality AS y, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
l AS (SELECT unnest([0, 1]) AS label), s AS (SELECT label, (SELECT count(*) FROM c WHERE y = label) AS support, (SELECT count(*) FROM c WHERE p = label) AS guessed, (SELECT count(*) FROM c WHERE p = label AND y = label) AS hit FROM l)
SELECT CAST(label AS INT) AS label, support, round(coalesce(hit / nullif(guessed, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * (hit / nullif(guessed, 0)) * (hit / nullif(support, 0)) / nullif(hit / nullif(guessed, 0) + hit / nullif(support, 0), 0), 0), 6) AS f1 FROM s""")
def clf_report(spark, sf):
    both = fixtures.table(spark, sf, "labels").join(fixtures.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return models.classification_report(both.withColumn("guess", (F.col("n_chars") > 500).cast("int")), "quality", "guess")


# --- the feature block ------------------------------------------------------------------

_VISA = cascade.VISA.sql("title || chr(10) || description_md")
_BLOCK = {
    "continuous": ["min_years_experience"],
    "ordinal": {"seniority_extracted": list(SENIORITY_LEVELS)},
    "onehot": ["country", "source", "role_family_extracted", "remote_policy"],
    "target": ["region", "city"],
    "boolean": ["salary_disclosed"],
    "tristate": {"offers_visa_sponsorship": "sponsorship"},
    "tech": {"tech_stack": 5},
    "dates": {"posted_at": "posted"},
}


def raw_matrix(spark, sf):
    """Disclosed postings with the columns of the block and log10 of their salary, made once for the tables' files."""

    def build():
        both = F.concat("title", F.lit("\n"), "description_md")
        jobs = enriched(spark, sf).where("salary_disclosed and salary_max_usd_yearly > 0")
        jobs = jobs.withColumns({"y": F.log10("salary_max_usd_yearly"), "offers_visa_sponsorship": cascade.VISA.column(both)})
        return jobs.select("id", "k", sampling.is_test(42, F.col("id")).alias("held"), "title", "description_md", "y", *(c for kind, of in _BLOCK.items() for c in of))

    name = stages.fingerprint([fixtures.table(spark, sf, t) for t in ("orders", "customer")], "matrix", _BLOCK, 42)
    return stages.staged(spark, "matrix", name, build)


def _matrix(spark, sf, spec=None, train="not held"):
    """(rows with the block and its vector, the block's names): all of it learnt on the training rows."""
    rows = raw_matrix(spark, sf)
    block = features.FeatureBlock(spec=spec or _BLOCK).fit(rows.where(train))
    return block.transform(rows), block.names()


def _hot(column):
    return f"""SELECT '{column}_' || level AS feature, CAST(count(*) FILTER ({column} = level) AS DOUBLE) AS total FROM t, (SELECT DISTINCT {column} AS level FROM t WHERE {_TRAIN} AND {column} IS NOT NULL) GROUP BY level
UNION ALL SELECT '{column}_missing', CAST(count(*) FILTER ({column} IS NULL) AS DOUBLE) FROM t"""


def _mean(column):
    return f"""SELECT '{column}__mean' AS feature, sum(coalesce(e, g)) AS total FROM t LEFT JOIN (
    SELECT {column} AS c, s * n / (s * n + v) * m + (1 - s * n / (s * n + v)) * g AS e FROM (SELECT {column}, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM t WHERE {_TRAIN} GROUP BY 1), g) w ON t.{column} IS NOT DISTINCT FROM w.c, g"""


_MODERN = ", ".join(f"'{t}'" for t in cascade.MODERN_ML)
_PARTS = [
    "SELECT 'min_years_experience__z' AS feature, sum((coalesce(min_years_experience, mid) - mean) / sd) AS total FROM t, years",
    f"SELECT 'seniority_extracted__code' AS feature, CAST(sum(coalesce(list_position([{', '.join(repr(s) for s in SENIORITY_LEVELS)}], seniority_extracted), 0) - 1) AS DOUBLE) AS total FROM t",
    *(_hot(c) for c in _BLOCK["onehot"]),
    *(_mean(c) for c in _BLOCK["target"]),
    "SELECT unnest(['salary_disclosed__true', 'salary_disclosed__isna']) AS feature, unnest([count(*) FILTER (salary_disclosed), count(*) FILTER (salary_disclosed IS NULL)])::DOUBLE AS total FROM t",
    "SELECT unnest(['sponsorship__yes', 'sponsorship__no', 'sponsorship__unspecified', 'sponsorship__missing']) AS feature, unnest([count(*) FILTER (visa = 'yes'), count(*) FILTER (visa = 'no'), count(*) FILTER (visa = 'unspecified'), count(*) FILTER (coalesce(visa NOT IN ('yes', 'no', 'unspecified'), true))])::DOUBLE AS total FROM t",
    "SELECT 'tech__' || token AS feature, CAST(count(*) FILTER (list_contains(tech_stack, token)) AS DOUBLE) AS total FROM t, tokens GROUP BY token",
    f"SELECT unnest(['tech__has_any', 'tech__count', 'tech__modern_ml']) AS feature, unnest([count(*) FILTER (list_has_any(tech_stack, (SELECT list(token) FROM tokens))), sum(coalesce(len(tech_stack), 0)), count(*) FILTER (list_has_any(tech_stack, [{_MODERN}]))])::DOUBLE AS total FROM t",
    """SELECT unnest(['posted__days_since', 'posted__sin_month', 'posted__cos_month', 'posted__is_missing']) AS feature,
    unnest([sum(coalesce(days, mid)), sum(sin(2 * pi() * coalesce(month(posted_at), 6) / 12)), sum(cos(2 * pi() * coalesce(month(posted_at), 6) / 12)), count(*) FILTER (posted_at IS NULL)::DOUBLE]) AS total
    FROM (SELECT *, CASE WHEN posted_at IS NOT NULL THEN CAST(greatest(date_diff('day', CAST(posted_at AS DATE), ref), 0) AS DOUBLE) END AS days FROM t, (SELECT CAST(max(posted_at) AS DATE) AS ref FROM t WHERE """
    + _TRAIN
    + f")), (SELECT median(greatest(date_diff('day', CAST(posted_at AS DATE), (SELECT CAST(max(posted_at) AS DATE) FROM t WHERE {_TRAIN})), 0)) AS mid FROM t WHERE posted_at IS NOT NULL AND {_TRAIN})",
]


@query(
    JOBS
    + f""", t AS MATERIALIZED (SELECT *, log10(salary_max_usd_yearly) AS y, {_VISA} AS visa FROM jobs WHERE salary_disclosed AND salary_max_usd_yearly > 0),
g AS (SELECT avg(y) AS g, var_pop(y) AS s FROM t WHERE {_TRAIN}),
mids AS (SELECT median(min_years_experience) AS mid FROM t WHERE {_TRAIN}),
years AS (SELECT mid, avg(coalesce(min_years_experience, mid)) AS mean, stddev_pop(coalesce(min_years_experience, mid)) AS sd FROM t, mids WHERE {_TRAIN} GROUP BY mid),
tokens AS (SELECT token FROM (SELECT unnest(tech_stack) AS token FROM t WHERE {_TRAIN}) GROUP BY token ORDER BY count(*) DESC, token LIMIT 5)
SELECT feature, round(total, 3) + 0.0 AS total FROM ({' UNION ALL '.join(f'({p})' for p in _PARTS)})"""
)
def feature_block(spark, sf):
    """The sum of every column of the block over all rows; what it learns is of the training rows."""
    data, names = _matrix(spark, sf, train=_TRAIN)
    one = data.agg(*(F.sum(F.col(f"`{n}`")).alias(f"s{i}") for i, n in enumerate(names)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("feature"), (F.round(f"s{i}", 3) + 0.0).alias("total")) for i, n in enumerate(names)))))


# --- trained models: rows only ----------------------------------------------------------


def _trained(kind, **settings):
    def run(spark, sf):
        data, _ = _matrix(spark, sf)
        fitted = models.trainer(kind, "y", **settings).fit(data.where("not held"))
        return models.overall(fitted.transform(data.where("held")), "y", "prediction")

    run.__name__ = {"ols": "train_ols", "ridge": "train_ridge", "forest": "train_rf", "boosted": "train_gbt"}[kind]
    return query()(run)


_trained("ols")
_trained("ridge")
# A tenth of the forest's trees, and of less depth: the trainer's own defaults are 500 of depth 30.
_trained("forest", numTrees=50, maxDepth=10)
_trained("boosted")


@query()
def train_importances(spark, sf):
    """What a forest makes of each column of the block."""
    data, names = _matrix(spark, sf)
    fitted = models.trainer("forest", "y", numTrees=20, maxDepth=8).fit(data.where("not held"))
    return spark.createDataFrame(models.importances(names, fitted.featureImportances.toArray()), "feature string, importance double")


@query()
def train_oof(spark, sf):
    data = sampling.folds(_matrix(spark, sf)[0], 5, 5, "id")
    done = models.out_of_fold(data, "fold", 5, lambda train: models.trainer("ridge", "y").fit(train).transform)
    return models.overall(done, "y", "prediction")


@query()
def train_lr(spark, sf):
    """Labels and confidences of a fifth of the labelled texts, by a classifier of the others."""
    both = fixtures.table(spark, sf, "labels").select("doc_id", "quality").join(fixtures.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    # Each stage of the classifier reads the rows anew: they are joined once.
    both = stages.temporary(both, "labelled")
    held = sampling.is_test(42, F.col("doc_id"))
    train = both.where(~held)
    train = train.join(F.broadcast(models.class_weights(train, "quality").select("quality", "weight")), "quality").withColumn("quality", F.col("quality").cast("string"))
    fitted = models.reread(spark, models.text_classifier("quality", "text", weight="weight").fit(train))
    scored = fitted.transform(both.where(held).withColumn("quality", F.col("quality").cast("string")))
    return models.predicted_label(scored, ["0", "1"]).select("doc_id", "label", "confidence")


# --- the linear probe -------------------------------------------------------------------

_LABEL = "role_family_extracted"


def _probed(spark, sf):
    """(rows with the embedded title and text, a fitted probe): of role families that say something, a fifth held out."""
    rows = raw_matrix(spark, sf)
    vague = modelling.VAGUE["role_family"]
    rows = modelling.confident(rows, _LABEL, vague).withColumn("words", title.classifier_text(F.col("title"), F.col("description_md"), 1500))
    rows = rows.select("id", _LABEL, retrieval.hashing_embedder(64)(F.col("words")).alias("features"), "held")
    name = stages.fingerprint([fixtures.table(spark, sf, t) for t in ("orders", "customer")], "probe", vague)
    rows = stages.staged(spark, "embedded", name, lambda: rows)
    path = f"{stages.shared_folder(spark)}/probe-model-{name}"
    if not files.exists(spark, f"{path}/_SUCCESS"):
        probe.fit(rows.where("not held"), "features", _LABEL, "id", name).save(spark, path)
    return rows, probe.Probe.load(spark, path)


@query()
def probe_search(spark, sf):
    """(c, f1_mean, f1_sd, chosen) of each penalty over five stratified folds."""
    _, fitted = _probed(spark, sf)
    return spark.createDataFrame([(*s, s[0] == fitted.c) for s in fitted.scores], "c double, f1_mean double, f1_sd double, chosen boolean")


@query()
def probe_report(spark, sf):
    """Precision, recall and F1 of each label on the rows held out."""
    rows, fitted = _probed(spark, sf)
    return models.classification_report(fitted.transform(rows.where("held")), _LABEL, "label")
