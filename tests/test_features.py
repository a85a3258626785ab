"""The feature block: learnt on training rows, saved, loaded, the same."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import features

SPEC = {
    "continuous": ["years"],
    "experience": {"years": "yoe"},
    "ordinal": {"level": ["low", "mid", "top"]},
    "onehot": ["country", "absent"],
    "target": ["city"],
    "boolean": ["remote"],
    "tristate": {"visa": "sponsorship"},
    "tech": {"stack": 2},
    "lists": {"langs": ["lang", 1]},
    "dates": {"posted": "posted"},
}


@pytest.fixture(scope="module")
def rows(spark):
    day = datetime.date(2026, 5, 1)
    data = [
        (1, 1.0, "low", "US", "x", True, "yes", ["Node.js", "PyTorch"], ["French"], day, 1.0),
        (2, 3.0, "top", "CA", "x", False, "no", ["Node.js", ""], ["French", "English"], day - datetime.timedelta(10), 3.0),
        (3, None, None, None, "y", None, None, None, None, None, 5.0),
        (4, 8.0, "odd", "US", None, True, "maybe", [], [], day - datetime.timedelta(4), None),
        (5, 100.0, "mid", "MX", "new", True, "unspecified", ["Rust", "PyTorch"], ["German"], day + datetime.timedelta(30), 9.0),
    ]
    return spark.createDataFrame(data, "id long, years double, level string, country string, city string, remote boolean, visa string, stack array<string>, langs array<string>, posted date, y double")


def test_block_is_learnt_on_training_rows(spark, rows, tmp_path):
    model = features.FeatureBlock(spec=SPEC, labelCol="y").fit(rows.where("id < 5"))
    names = model.names()
    assert names[:7] == ["years__z", "yoe", "yoe_sq", "yoe_isna", "level__code", "country_CA", "country_US"] and "tech__Node.js" in names and "country_MX" not in names
    got = {r.id: dict(zip(names, r.features.toArray(), strict=True)) for r in model.transform(rows).collect()}
    years = np.array([1.0, 3.0, 3.0, 8.0])
    assert got[5]["years__z"] == pytest.approx((100 - years.mean()) / years.std()) and got[3]["yoe_sq"] == 9 and got[3]["yoe_isna"] == 1
    assert [got[i]["level__code"] for i in range(1, 6)] == [0, 2, -1, -1, 1]
    assert (got[5]["country_US"], got[5]["country_CA"], got[3]["country_missing"]) == (0, 0, 1)
    assert [got[1][f"sponsorship__{v}"] for v in ("yes", "no", "unspecified", "missing")] == [1, 0, 0, 0] and got[4]["sponsorship__missing"] == got[3]["sponsorship__missing"] == 1
    assert (got[3]["remote__true"], got[3]["remote__isna"], got[1]["remote__true"]) == (0, 1, 1)
    assert (got[2]["tech__Node.js"], got[2]["tech__count"], got[5]["tech__modern_ml"], got[4]["tech__has_any"]) == (1, 1, 1, 0)
    assert (got[2]["lang__French"], got[5]["lang__has_any"]) == (1, 0)
    # Means of levels are drawn to the mean of all (3); a level that was not seen has it.
    spread, inside = np.var([1.0, 3.0, 5.0]), 1.0
    share = spread * 2 / (spread * 2 + inside)
    assert got[1]["city__mean"] == pytest.approx(share * 2 + (1 - share) * 3) and got[5]["city__mean"] == 3 and got[3]["city__mean"] == 5
    assert (got[1]["posted__days_since"], got[2]["posted__days_since"], got[3]["posted__days_since"], got[5]["posted__days_since"]) == (0, 10, 4, 0)
    assert got[3]["posted__is_missing"] == 1 and got[1]["posted__sin_month"] == pytest.approx(np.sin(2 * np.pi * 5 / 12))
    model.save(f"file://{tmp_path}/block")
    again = features.FeatureModel.load(f"file://{tmp_path}/block")
    assert again.names() == names and again.transform(rows).collect() == model.transform(rows).collect()
    features.FeatureBlock(spec=SPEC).save(f"file://{tmp_path}/spec")
    assert features.FeatureBlock.load(f"file://{tmp_path}/spec").fit(rows.where("id < 5")).names() == names


def test_block_of_nothing(spark, rows):
    model = features.FeatureBlock(spec=SPEC).fit(rows.where("false"))
    out = model.transform(rows)
    assert out.count() == 5 and out.where(F.col("yoe").isNull()).count() == 0


def test_stages_of_a_pipeline(spark, rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    fitted = Pipeline(stages=[features.FeatureBlock(spec=features.WAGE_BLOCK | {"experience": {"years": "yoe"}}), LinearRegression(labelCol="y", regParam=0.1)]).fit(rows.where("y is not null"))
    assert fitted.transform(rows).where("prediction is null").count() == 0


def test_models_see_no_leak(spark):
    """Pay has little to do with the rest of the derived postings: a little better than the mean is right, much better is a leak."""
    from quern.plans.catalog import QUERIES

    ridge, boosted = (QUERIES[name](spark, "/root/testdata/sf0.01").first() for name in ("train_ridge_cv", "train_gbt"))
    assert 0 < ridge.r2 < 0.2 and boosted.r2 < 0.2
