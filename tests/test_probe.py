"""The linear probe against a plain solver in numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import probe


def plain(x, y, classes, c):
    """Newton's method on the same loss."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    weight = (len(y) / (classes * np.bincount(y, minlength=classes)))[y]
    w, n = np.zeros((x.shape[1], classes)), x.shape[1] * classes
    free = np.ones((x.shape[1], classes))
    free[-1] = 0
    for _ in range(60):
        p = probe.softmax(x @ w)
        gradient = (c * x.T @ (weight[:, None] * (p - np.eye(classes)[y])) + free * w).ravel()
        hessian = np.zeros((n, n))
        for a in range(classes):
            for b in range(classes):
                curve = weight * p[:, a] * ((a == b) - p[:, b])
                hessian[a::classes, b::classes] = c * (x * curve[:, None]).T @ x
        w = w - np.linalg.lstsq(hessian + np.diag(free.ravel()), gradient, rcond=None)[0].reshape(w.shape)
        if np.abs(gradient).max() < 1e-9:
            break
    return w


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(4, 5))
    y = rng.choice(4, 600, p=[0.6, 0.25, 0.1, 0.05])
    return centres[y] + 1.1 * rng.normal(size=(600, 5)), y


def test_probe_equals_a_plain_solver(spark, labelled, tmp_path):
    x, y = labelled
    names = np.array(["d", "a", "c", "b"])
    frame = spark.createDataFrame([(i, v.tolist(), str(names[k])) for i, (v, k) in enumerate(zip(x, y, strict=True))] + [(900, None, "a"), (901, x[0].tolist(), None)], "id long, features array<double>, label string").repartition(5)
    got = probe.fit(frame, "features", "label", "id", f"test-{tmp_path.name}")
    assert got.labels == ["a", "b", "c", "d"]
    place = np.array([got.labels.index(names[k]) for k in y])
    want = plain(x, place, 4, got.c)
    ones = np.concatenate([x, np.ones((600, 1))], 1)
    assert np.abs(probe.softmax(ones @ want) - probe.softmax(ones @ got.weights)).max() < 1e-3
    folds = {r.id: r.fold for r in probe.stratified(frame.where("label is not null and features is not null"), F.col("label"), F.col("id")).collect()}
    fold = np.array([folds[i] for i in range(600)])
    for c, mean, deviation in got.scores:
        scores = []
        for f in range(5):
            w = plain(x[fold != f], place[fold != f], 4, c)
            cells = np.zeros((4, 4), int)
            np.add.at(cells, (place[fold == f], (ones[fold == f] @ w).argmax(1)), 1)
            scores.append(probe.macro_f1(cells))
        assert (mean, deviation) == pytest.approx((np.mean(scores), np.std(scores)), abs=0.02)
    assert got.c == max(got.scores, key=lambda s: s[1])[0]
    shown = got.transform(frame).orderBy("id").collect()
    assert [r[2] for r in shown[:600]] == [str(names[k]) for k in y]
    assert [r[3] for r in shown[:600]] == [got.labels[i] for i in (ones @ got.weights).argmax(1)] and shown[600][3] is None
    got.save(spark, f"file://{tmp_path}/m")
    again = probe.Probe.load(spark, f"file://{tmp_path}/m")
    assert (again.labels, again.c, again.scores) == (got.labels, got.c, got.scores) and (again.weights == got.weights).all()


def test_folds_keep_the_labels_shares(spark):
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 10 < 7 THEN 'hot' ELSE 'rare' END AS label")
    counts = {(r.label, r.fold): r["count"] for r in probe.stratified(rows, F.col("label"), F.col("id")).groupBy("label", "fold").count().collect()}
    assert all(abs(n - (560 if label == "hot" else 240)) <= 25 for (label, _), n in counts.items()) and len(counts) == 10


def test_gradients_of_many_models():
    rng = np.random.default_rng(3)
    x, y = np.concatenate([rng.normal(size=(50, 3)), np.ones((50, 1))], 1), rng.integers(0, 3, 50)
    weights, points = rng.random((50, 2)) * (rng.random((50, 2)) < 0.8), rng.normal(size=(2, 4, 3))
    loss, gradient = probe.losses(x, y, weights, points)
    for m in range(2):
        f = lambda w: float((weights[:, m] * -np.log(probe.softmax(x @ w)[np.arange(50), y])).sum())
        assert loss[m] == pytest.approx(f(points[m]))
        step = np.zeros((4, 3))
        step[1, 2] = 1e-6
        assert gradient[m][1, 2] == pytest.approx((f(points[m] + step) - f(points[m] - step)) / 2e-6, rel=1e-4)


def test_minimiser():
    a = np.diag([1.0, 10.0, 100.0])
    search = probe.lbfgs(np.array([5.0, -3.0, 2.0]), 1e-9)
    point, passes = next(search), 0
    with pytest.raises(StopIteration) as stop:
        while True:
            passes += 1
            point = search.send((0.5 * point @ a @ point, a @ point))
    assert np.abs(stop.value.value).max() < 1e-6 and passes < 60
