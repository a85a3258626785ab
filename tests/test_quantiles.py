"""Quantiles by brackets, and drift over them, against numpy; brackets are made narrow so that they are used."""

from __future__ import annotations

import harness
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import monitoring, quantiles
from quern.plans import catalog


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 6000
    x = np.where(rng.random(n) < 0.3, 7.0, rng.normal(0, 5, n)).round(2)
    y = rng.integers(0, 4, n).astype(float)
    group = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "few"], n, p=[0.6, 0.39, 0.01]))
    rows = [(i, None if i % 11 == 0 else float(x[i]), float(y[i]), None if group[i] == "b" else str(group[i])) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, None, "empty")], "i long, x double, y double, g string").repartition(5)


def test_grouped_quantiles(table):
    shares = (0.0, 0.01, 0.25, 0.5, 0.77, 0.995, 1.0)
    wanted = {f"{c}{i}": (c, q) for c in "xy" for i, q in enumerate(shares)}
    for accuracy in (100, 100_000):
        got = {r.g: r for r in quantiles.aggregate(table, ["g"], [F.count("*").alias("n"), F.sum("y").alias("s")], wanted, accuracy).collect()}
        rows = table.collect()
        assert set(got) == {r.g for r in rows}
        for g, one in got.items():
            own = [r for r in rows if r.g == g]
            assert one.n == len(own)
            for name, (c, q) in wanted.items():
                values = [r[c] for r in own if r[c] is not None]
                assert one[name] == (pytest.approx(float(np.quantile(values, q)), abs=1e-9) if values else None), (g, name)


def test_global_quantiles(spark, table):
    one = quantiles.aggregate(table.select("x"), [], [], {"m": ("x", 0.5), "t": ("x", 0.9)}, 50).first()
    values = [r.x for r in table.collect() if r.x is not None]
    assert (one.m, one.t) == pytest.approx(tuple(np.quantile(values, (0.5, 0.9))))
    empty = quantiles.aggregate(table.where("false").select("x"), [], [F.count("*").alias("n")], {"m": ("x", 0.5)}).collect()
    assert [r.m for r in empty] in ([], [None])


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 9.0], [1.0, 2.0, 4.0], [1.0, 2.0], [1.0], [None, None], []], ids=len)
def test_summary_of_repeated_and_few_values(spark, tmp_path, values):
    """Two or three values, in all or alike, are too few to correct a kurtosis for."""
    spark.createDataFrame([(v,) for v in values], "o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert harness.differences(spark, "target_summary", catalog.QUERIES["target_summary"], catalog.ORACLE_SQL["target_summary"], str(tmp_path)) == []


def test_no_exact_percentile_in_the_plan(table):
    plan = quantiles.aggregate(table, ["g"], [], {"m": ("x", 0.5)})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan and "percentile(" not in plan


@pytest.mark.parametrize("accuracy", [60, 10_000])
def test_drift(table, accuracy):
    rows = table.where("i < 6000").collect()
    side = [r.i % 3 > 0 for r in rows]
    got = {r.column: r.psi for r in monitoring.drift(table.where("i < 6000"), F.col("i") % 3 > 0, ["x", "y"], ["g"], accuracy=accuracy).collect()}

    def psi(levels):
        n, m = sum(side), len(side) - sum(side)
        total = 0.0
        for level in set(levels):
            p = max(sum(a and v == level for a, v in zip(side, levels, strict=True)) / n, 1e-6)
            q = max(sum(not a and v == level for a, v in zip(side, levels, strict=True)) / m, 1e-6)
            total += (p - q) * np.log(p / q)
        return round(total, 6)

    for c in "xy":
        values = [r[c] for r in rows]
        edges = np.quantile([v for v, a in zip(values, side, strict=True) if a and v is not None], [i / 10 for i in range(1, 10)])
        assert got[c] == pytest.approx(psi([None if v is None else int((edges < v).sum()) for v in values]), abs=2e-6)
    assert got["g"] == pytest.approx(psi([r.g for r in rows]), abs=2e-6)


def test_drift_scans_twice(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(100).selectExpr("id", "cast(id as double) AS salary_max_usd_yearly", "id % 3 AS country", "id % 5 AS source").write.parquet(path)
    found = monitoring.drift_of_halves(spark.read.parquet(path), F.col("id") < 50)
    assert found.count() == 3
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
