"""The modelling feature block as a pipeline stage: what it learns comes from training rows alone, and is saved with it.

``FeatureBlock(spec).fit(train)`` gives a ``FeatureModel``, which adds named columns and their vector.  A spec names the columns
of each kind: ``continuous`` (median where missing, standardised), ``ordinal`` (column: levels), ``onehot``, ``target`` (smoothed
means of the label), ``boolean``, ``tristate`` (column: prefix), ``lists`` (column: [prefix, most tokens]), ``tech`` and ``dates`` (column:
prefix).  Columns that the training rows lack are left out.

Fitting takes a few aggregates over all columns at once.  Levels and tokens are counted in one of them, and are few by
nature: a column of more than ``MOST_LEVELS`` levels is an error, as no table of categories is.
"""

from __future__ import annotations

import json
import math
from functools import partial

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cascade import MODERN_ML
from ..schema import ORDINAL
from . import encode, quantiles

MOST_LEVELS = 100_000

#: The block of the salary models.
SALARY_BLOCK = {
    "continuous": ["min_years_experience"],
    "ordinal": {c: list(levels) for c, levels in ORDINAL.items()},
    "onehot": ["country", "source", "role_family_extracted", "remote_policy", "contract_type", "equity_form", "bonus_type"],
    "target": ["region", "city"],
    "boolean": ["requires_security_clearance", "offers_relocation", "offers_equity", "bonus_mentioned", "on_call_required"],
    "tristate": {"offers_visa_sponsorship": "sponsorship"},
    "tech": {"tech_stack": 25},
    "lists": {"language_requirements": ["lang", 5], "requires_citizenship": ["citizenship", 4]},
    "dates": {"posted_at": "posted"},
}
#: The narrow block of the wage equation.
WAGE_BLOCK = {"experience": {"min_years_experience": "yoe"}, "ordinal": {"min_education": list(ORDINAL["min_education"])}, "onehot": ["country"]}


class _Shared(Params):
    spec = Param(Params._dummy(), "spec", "columns of each kind, as JSON", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "what target means are of", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "the vector column", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(spec="{}", labelCol="y", featuresCol="features")

    def _spec(self) -> dict:
        return json.loads(self.getOrDefault(self.spec))


class FeatureBlock(_Shared, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, spec: dict | None = None, labelCol: str = "y", featuresCol: str = "features") -> None:
        super().__init__()
        self._set(spec=json.dumps(spec or {}), labelCol=labelCol, featuresCol=featuresCol)

    def _fit(self, train: DataFrame) -> FeatureModel:
        have, spec = set(train.columns), self._spec()
        spec = {kind: {c: v for c, v in of.items() if c in have} if isinstance(of, dict) else [c for c in of if c in have] for kind, of in spec.items()}
        state = {"spec": spec, "levels": {}, "tokens": {}, "means": {}} | _numbers(train, spec) | _counts(train, spec)
        state["means"] = _target_means(train, spec.get("target", []), self.getOrDefault(self.labelCol))
        model = FeatureModel()
        model._set(state=json.dumps(state), spec=json.dumps(spec), labelCol=self.getOrDefault(self.labelCol), featuresCol=self.getOrDefault(self.featuresCol))
        return model


class FeatureModel(_Shared, Model, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "what was learnt, as JSON", TypeConverters.toString)

    def _state(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def names(self) -> list[str]:
        """The columns of the block, in order."""
        return list(_columns(self._state()))

    def _transform(self, rows: DataFrame) -> DataFrame:
        state = self._state()
        wide = rows
        for column, means in state["means"].items():
            known = rows.sparkSession.createDataFrame([(None if v == _NULL else v[1:], m) for v, m in means["of"].items()], "_level string, _mean double")
            # At most ``MOST_LEVELS`` rows.
            own = F.broadcast(known.withColumnsRenamed({"_level": f"_level_{column}", "_mean": f"_mean_{column}"}))
            wide = wide.join(own, F.col(column).cast("string").eqNullSafe(F.col(f"_level_{column}")), "left")
        made = _columns(state)
        out = wide.select(*rows.columns, *(c.cast("double").alias(n) for n, c in made.items()))
        return out.withColumn(self.getOrDefault(self.featuresCol), array_to_vector(F.array(*(F.col(f"`{n}`") for n in made))))


_NULL = "null"


def _key(value: str | None) -> str:
    """Levels as keys of JSON: null is no text."""
    return _NULL if value is None else "=" + value


def _numbers(train: DataFrame, spec: dict) -> dict:
    """Medians, means and deviations, and the latest dates with the median of days before them."""
    numeric = dict.fromkeys([*spec.get("continuous", []), *spec.get("experience", {})])
    dates = list(spec.get("dates", {}))
    latest = train.agg(F.count("*").alias("_n"), *(F.max(F.col(c).cast("date")).cast("string").alias(c) for c in dates)).first()
    days = {f"_days_{c}": _days(c, latest[c]) for c in dates if latest[c]}
    known = train.select(*(F.col(c).cast("double").alias(f"_num_{c}") for c in numeric), *(v.alias(n) for n, v in days.items()))
    medians = quantiles.medians(known, known.columns, "").first().asDict() if known.columns else {}
    medians = {n: v if v is not None else 0.0 for n, v in medians.items()}
    filled = {c: F.coalesce(F.col(f"_num_{c}"), F.lit(medians[f"_num_{c}"])) for c in spec.get("continuous", [])}
    moments = known.agg(*(f(v).alias(f"{n}_{c}") for c, v in filled.items() for n, f in (("mean", F.avg), ("sd", F.stddev_pop)))).first() if filled else None
    scale = {c: [moments[f"mean_{c}"] or 0.0, moments[f"sd_{c}"] or 1.0] for c in filled}
    return {"medians": medians, "scale": scale, "latest": {c: latest[c] for c in dates}}


def _days(column: str, latest: str | None) -> Column:
    """Days from a date to the latest one, not below 0; null for none."""
    days = F.date_diff(F.lit(latest).cast("date"), F.col(column).cast("date"))
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0)).cast("double"))


def _counts(train: DataFrame, spec: dict) -> dict:
    """Levels of the one-hot columns and the most frequent tokens of lists, from one count of (column, value)."""
    lists = {c: n for c, n in spec.get("tech", {}).items()} | {c: n for c, (_, n) in spec.get("lists", {}).items()}
    pair = lambda c, v: F.struct(F.lit(c).alias("column"), v.cast("string").alias("value"))
    parts = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), partial(pair, c)) for c in lists]
    whole = [pair(c, F.col(c)) for c in spec.get("onehot", [])]
    if not whole and not parts:
        return {}
    pairs = F.concat(*([F.array(*whole)] if whole else []), *parts)
    counts = train.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
    rows = counts.where(F.col("value").isNull() | (F.col("value") != "")).limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels to learn")
    levels = {c: sorted(r.value for r in rows if r.column == c and r.value is not None) for c in spec.get("onehot", [])}
    tokens = {c: [r.value for r in sorted((r for r in rows if r.column == c and r.value is not None), key=lambda r: (-r.n, r.value))[:n]] for c, n in lists.items()}
    return {"levels": levels, "tokens": tokens}


def _target_means(train: DataFrame, columns: list[str], label: str) -> dict:
    """Means of the label by level, each drawn to the mean of all by how much the level's own spread says about it."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")
    known = train.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), pairs).select("y", "p.*")
    rows = known.groupBy("column", "value").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v")).limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels to learn")
    out = {}
    for c in columns:
        own = [r for r in rows if r.column == c]
        n = sum(r.n for r in own)
        mean = sum(r.n * r.m for r in own) / n if n else 0.0
        spread = sum(r.n * (r.v + (r.m - mean) ** 2) for r in own) / n if n else 0.0
        share = lambda r: spread * r.n / (spread * r.n + r.v) if spread * r.n + r.v > 0 else 1.0  # noqa: B023, E731
        out[c] = {"all": mean, "of": {_key(r.value): share(r) * r.m + (1 - share(r)) * mean for r in own}}
    return out


def _columns(state: dict) -> dict[str, Column]:
    """The block's columns by name."""
    spec, medians, out = state["spec"], state["medians"], {}
    for c in spec.get("continuous", []):
        mean, sd = state["scale"][c]
        out[c + "__z"] = (F.coalesce(F.col(c).cast("double"), F.lit(medians[f"_num_{c}"])) - mean) / sd
    for c, prefix in spec.get("experience", {}).items():
        years = F.coalesce(F.col(c).cast("double"), F.lit(medians[f"_num_{c}"]))
        out |= {prefix: years, f"{prefix}_sq": years * years, f"{prefix}_isna": F.col(c).isNull().cast("long")}
    for c, levels in spec.get("ordinal", {}).items():
        out[c + "__code"] = encode.ordinal(F.col(c), tuple(levels))
    for c in spec.get("onehot", []):
        out |= encode.one_hot(F.col(c).cast("string"), state["levels"][c], c)
    for c in spec.get("target", []):
        out[c + "__mean"] = F.coalesce(F.col(f"_mean_{c}"), F.lit(state["means"][c]["all"]))
    for c in spec.get("boolean", []):
        made = encode.boolean(F.col(c).cast("boolean"), c)
        out |= {f"{c}__true": made[c], f"{c}__isna": made[f"{c}__isna"]}
    for c, prefix in spec.get("tristate", {}).items():
        out |= {n.replace(f"{prefix}_", f"{prefix}__", 1): v for n, v in encode.tri_state(F.col(c), prefix).items()}
    for c in spec.get("tech", {}):
        block = encode.tech_block(F.filter(F.col(c), lambda t: t.isNotNull() & (t != "")), state["tokens"][c], MODERN_ML)
        out |= {_twice(n, "tech"): v for n, v in block.items()}
    for c, (prefix, _) in spec.get("lists", {}).items():
        out |= {_twice(n, prefix): v for n, v in encode.multi_hot(F.col(c), state["tokens"][c], prefix).items()}
    for c, prefix in spec.get("dates", {}).items():
        latest = state["latest"][c]
        days = _days(c, latest)
        angle = 2 * math.pi * F.coalesce(F.month(c), F.lit(6)) / 12
        out |= {f"{prefix}__days_since": F.coalesce(days, F.lit(medians.get(f"_days_{c}", 0.0))), f"{prefix}__sin_month": F.sin(angle), f"{prefix}__cos_month": F.cos(angle), f"{prefix}__is_missing": F.col(c).isNull().cast("long")}
    return out


def _twice(name: str, prefix: str) -> str:
    return name if name.startswith(f"{prefix}__") else name.replace(f"{prefix}_", f"{prefix}__", 1)
