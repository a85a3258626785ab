"""Linear models, intervals, bootstraps, payloads, the index and the whole search, against numpy and plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import cascade
from quern.operators import indexing, modelling, retrieval, sampling, views
from quern.plans import learning
from quern.sources import collection


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(41)
    x = rng.normal(size=(400, 3))
    y = 2.0 + x @ [1.5, -0.7, 0.0] + rng.normal(size=400) * 0.5
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double"), x, y


def test_ridge_equals_numpy(data):
    frame, x, y = data
    xc, yc = x - x.mean(0), y - y.mean()
    for alpha in (0.0, 0.5, 100.0):
        intercept, coef = modelling.moments(frame, ["a", "b", "c"], "y")[None].ridge(alpha)
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        assert np.allclose(coef, want, atol=1e-9) and abs(intercept - (y.mean() - x.mean(0) @ want)) < 1e-9


def test_ridge_takes_the_penalty_of_least_held_out_error(spark, data, tmp_path):
    frame, x, y = data
    model = modelling.ridge_cv(frame, ["a", "b", "c"], "y", "id")
    fold = {r.id: r.fold for r in sampling.folds(frame, 5, 42, "id").collect()}
    of = np.array([fold[i] for i in range(400)])

    def error(alpha):
        total = 0.0
        for k in range(5):
            m, v = x[of != k], x[of == k]
            mc, tc = m - m.mean(0), y[of != k] - y[of != k].mean()
            w = np.linalg.solve(mc.T @ mc + alpha * np.eye(3), mc.T @ tc)
            total += ((y[of == k] - (y[of != k].mean() + (v - m.mean(0)) @ w)) ** 2).sum()
        return total

    assert model.alpha == min(modelling.ALPHAS, key=error)
    got = {r.id: r.prediction for r in model.transform(frame.where("id < 400")).collect()}
    assert np.allclose([got[i] for i in range(400)], model.intercept + x @ model.coef)
    model.save(spark, f"file://{tmp_path}/model")
    again = modelling.LinearModel.load(spark, f"file://{tmp_path}/model")
    assert (again.columns, again.intercept, again.coef.tolist(), again.alpha) == (model.columns, model.intercept, model.coef.tolist(), model.alpha)


def test_least_squares_table(data):
    frame, x, y = data
    table = {r.term: r for r in modelling.ols_table(frame, ["a", "b", "c"], "y").collect()}
    full = np.column_stack([np.ones(400), x])
    coef = np.linalg.lstsq(full, y, rcond=None)[0]
    mse = ((y - full @ coef) ** 2).sum() / 396
    se = np.sqrt(mse * np.diag(np.linalg.inv(full.T @ full)))
    for name, b, s in zip(["intercept", "a", "b", "c"], coef, se, strict=True):
        assert table[name].coef == pytest.approx(b) and table[name].std_err == pytest.approx(s)
        assert table[name].ci_low < b < table[name].ci_high
    assert table["a"].p_value < 1e-12 and table["c"].p_value > 0.01
    assert modelling.ols_table(frame.where("false"), ["a"], "y").count() == 0


@pytest.mark.parametrize("t, dof, p", [(0.0, 5, 1.0), (1.0, 1, 0.5), (2.0, 10, 0.0733880), (2.228139, 10, 0.05), (1.959964, 1e7, 0.05), (12.7062, 1, 0.05)])
def test_student_tails(t, dof, p):
    assert modelling.t_two_sided(t, dof) == pytest.approx(p, abs=1e-6)
    if p < 1:
        assert modelling.t_quantile(p, dof) == pytest.approx(t, rel=1e-4)


def test_bootstraps_cover_and_repeat(spark):
    rng = random.Random(42)
    rows = [(i, 5.0, 5.0 + rng.choice([-0.01, 0.01, 0.03]), rng.choice("ab"), rng.choice("aab")) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, y double, p double, label string, guess string")
    mae = modelling.bootstrap_mae(frame, "y", "p", "id").first()
    point = sum(abs(10**5.0 - 10 ** r[2]) for r in rows) / 600
    assert mae.replicates == 500 and mae.low < point < mae.high and abs(mae.mean - point) / point < 0.02
    spread = math.sqrt(sum((abs(10**5.0 - 10 ** r[2]) - point) ** 2 for r in rows)) / 600
    assert mae.high - mae.low == pytest.approx(2 * 1.96 * spread, rel=0.25)
    assert modelling.bootstrap_mae(frame.repartition(7), "y", "p", "id").first().mean == pytest.approx(mae.mean, rel=1e-12)
    f1 = modelling.bootstrap_f1(frame, "label", "guess", "id", ["a", "b"], 200).first()

    def macro(pairs):
        out = 0.0
        for c in "ab":
            hit = sum(y == p == c for y, p in pairs)
            out += 2 * hit / max(1, sum(y == c for y, _ in pairs) + sum(p == c for _, p in pairs)) / 2
        return out

    assert f1.low < macro([(r[3], r[4]) for r in rows]) < f1.high and f1.replicates == 200


def test_boosted_search_keeps_the_best_settings(data):
    from quern.operators.models import assemble

    frame, _, _ = data
    ranges = {"maxIter": (2, 6), "maxDepth": (1, 3), "stepSize": (0.05, 0.5)}
    full = assemble(frame.where("id < 120"), ["a", "b", "c"])
    one, two = (modelling.boosted_search(full, "y", "id", trials=5, k=2, ranges=ranges, rungs=((0.5, 0.5), (1.0, 1.0)), workers=w) for w in (1, 3))
    assert [t.settings for t in one.trials] == [modelling.boosted_settings(t, 42, ranges) for t in range(5)]
    assert sorted(t.rung for t in one.trials) == [0, 0, 0, 1, 1] and one.best.error == min(t.error for t in one.trials if t.rung == 1)
    assert [(t.rung, t.error) for t in one.trials] == [(t.rung, t.error) for t in two.trials] and one.best.number == two.best.number
    assert one.model.transform(full).where("prediction is null").count() == 0
    wide = [modelling.boosted_settings(t) for t in range(200)]
    for name, (low, high) in modelling.BOOSTED_RANGES.items():
        assert all(low <= s[name] <= high for s in wide)


def test_labels(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string")
    labels = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (9, "c", 0)], "id int, label string, n int")
    assert [tuple(r) for r in modelling.with_label(rows, labels, "id", "n").collect()] == [(1, "x", "a", 1)]
    packet = modelling.review_packet(rows, labels.where("n = 1").select("id", "label"), spark.createDataFrame([(2, 0.5)], "id int, p double"), "id")
    assert sorted(tuple(r) for r in packet.select("id", F.coalesce("label", F.lit("-")), F.coalesce("p", F.lit(-1.0))).collect()) == [(1, "a", -1.0), (2, "-", 0.5), (3, "-", -1.0)]


def test_text_classifier_in_a_session_with_a_tag(spark):
    """What a classifier of two labels learnt goes to tasks, the session it was fitted in does not."""
    other = spark.newSession()
    other.addTag("tests")
    try:
        found = learning.train_lr(other, "/root/testdata/sf0.001").collect()
    finally:
        other.removeTag("tests")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where(sampling.is_test(42, F.col("doc_id")))
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in labels.collect()) != []
    assert all(r.label in ("0", "1") and 0.5 <= r.confidence <= 1 for r in found)


def test_payload_index_and_bound_parameters(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "Miller", "Grind grain. " * 200, float("nan"), "x"), ("b", "Baker", "Bake bread with rye and sourdough. " * 90, 5.0, "y"), ("c", "Nobody", "  ", 1.0, "z")], "id string, title string, description_md string, salary_max_usd_yearly double, secret string")
    shown = {r.id: r for r in indexing.payload(jobs).collect()}
    assert shown["a"].salary_max_usd_yearly is None and shown["b"].salary_max_usd_yearly == 5.0 and "secret" not in shown["a"].asDict()
    path = f"file://{tmp_path}/index"
    embed = retrieval.hashing_embedder(32)
    held = lambda: collection.Collection(spark, path).read()
    first = indexing.index(jobs, path, embed, 32)
    assert (first.postings, first.parents) == (2, 2) and first.chunks == held().count() > 2
    assert indexing.index(jobs.where("id = 'a'"), path, embed, 32).postings == 1
    assert held().count() == first.chunks
    assert not indexing.create_collection(spark, path, 32) and indexing.create_collection(spark, path, 32, recreate=True)
    assert held().count() == 0
    sneaky = views.bound(jobs, "SELECT id FROM {jobs} WHERE title = :title", title="x' OR '1' = '1")
    assert sneaky.count() == 0 and views.bound(jobs, "SELECT id FROM {jobs} WHERE title = :title", title="Baker").first().id == "b"


def test_search_finds_the_text_that_was_asked_for(spark):
    topics = ["rye bread ovens", "steel bridges rivets", "violin strings rosin", "tide pools crabs"]
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "T", " ".join(rng.choice(t.split()) for _ in range(400))) for i, t in enumerate(topics)], "k int, title string, body string")
    chunks = retrieval.chunk(docs, "k", "title", "body")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(topics)] + [(9, None)], "q int, question string")
    search = lambda questions, scorer: indexing.search(questions, indexing.Prepared.of(chunks, retrieval.hashing_embedder(64)), retrieval.hashing_embedder(64), scorer, "q", "question", 3)
    for scorer in (None, retrieval.lexical_overlap):
        best = {r.query: r for r in search(asked, scorer).where("rank = 1").collect()}
        assert all(best[i].parent_chunk_id == f"{i}::p0" and best[i].best_child in best[i].contributors for i in range(4))
    assert search(asked.where("false"), None).count() == 0
    assert indexing.search(asked, indexing.Prepared.of(chunks, retrieval.hashing_embedder(64)), retrieval.hashing_embedder(64), None, "q", "question", where=F.lit(False)).count() == 0


def test_search_of_stored_stages(spark, tmp_path):
    """The same result as without storage, from tables made once; the plan makes the questions' vectors and scores, nothing else, in Python."""
    folder, embed = f"file://{tmp_path}", retrieval.hashing_embedder(32)
    spark.createDataFrame([(i, f"title {i % 3}", f"word{i % 7} word{i % 5} other text " * 60) for i in range(20)], "k long, title string, body string").write.parquet(f"{folder}/docs")
    docs = spark.read.parquet(f"{folder}/docs")
    asked = spark.createDataFrame([(1, "word3 word4"), (2, "other word1")], "q int, question string")
    plain = indexing.Prepared.of(retrieval.chunk(docs, "k", "title", "body"), embed)
    stored = indexing.prepare(docs, "k", "title", "body", embed, "hashed-32", folder)
    one, two = (sorted(tuple(r) for r in indexing.search(asked, p, embed, retrieval.lexical_overlap, "q", "question", 4).drop("contributors").collect()) for p in (plain, stored))
    assert one == two and len(one) == 8
    found = indexing.search(asked, indexing.prepare(docs, "k", "title", "body", embed, "hashed-32", folder), embed, retrieval.lexical_overlap, "q", "question", 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") <= 2
    kept = indexing.search(asked, stored, embed, None, "q", "question", 9, where=F.col("child_chunk_id").startswith("3::"))
    assert {r.parent_chunk_id.split("::")[0] for r in kept.collect()} == {"3"}


def test_provenance_counts_equal_the_maps(spark):
    rows = spark.createDataFrame([("Baker", "Full time. RSUs and 5+ years."), ("Lead Engineer", "Hybrid. Python."), (None, None)], "title string, description_md string")
    maps = cascade.with_features(rows).select(F.explode("extraction_meta").alias("field", "m")).groupBy("field").count().collect()
    assert {r.field: r.n for r in cascade.provenance_counts(rows).collect()} == {r.field: r["count"] for r in maps}


def test_point_ids_are_uuids(spark):
    import uuid

    from quern.sources import files

    names = ["a::c0000", "é::c0012", ""] + [f"{i}::c{i:04d}" for i in range(40)]
    got = [r.p for r in spark.createDataFrame([(n,) for n in names], "n string").select(files.point_id(F.col("n")).alias("p")).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(files.NAMESPACE), n)) for n in names]


def test_embedder_is_the_same_in_any_batch(spark):
    texts = ["", None, "one two two", "ONE  two\ttwo", "three " * 500]
    embed = retrieval.hashing_embedder(16)
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = {r.i: np.array(r.v) for r in frame.select("i", embed(F.col("t")).alias("v")).collect()}
    assert not rows[0].any() and not rows[1].any() and (rows[2] == rows[3]).all() and abs(np.linalg.norm(rows[4]) - 1) < 1e-6
    for i, t in enumerate(texts):
        one = spark.createDataFrame([(t,)], "t string").select(embed(F.col("t")).alias("v")).first().v
        assert (np.array(one) == rows[i]).all()


def test_a_pasted_description_is_one_row(spark):
    row = cascade.single_row(spark, "Hybrid. 7+ years. RSUs.", " Senior Data Engineer ", "Toronto, ON").first()
    assert (row.country, row.region, row.seniority_extracted, row.role_family_extracted, row.remote_policy, row.min_years_experience, row.equity_form, row.source) == ("CA", "ON", "senior", "DE", "hybrid", 7, "rsu", "greenhouse")
    bare = cascade.single_row(spark, "")
    assert bare.first().country == "US" and bare.first().seniority_extracted is None and bare.count() == 1


def test_second_tier_fills_what_the_rules_left_open(spark):
    rows = [(1, "Hybrid role.", "Baker"), (2, "Nothing said.", "Baker"), (3, "", "Baker"), (4, "break it", "Baker"), (5, None, None)]

    def ask(items):
        if any("break" in text for text, _, _ in items):
            raise RuntimeError("no answer")
        return [{"remote_policy_extracted": "remote", "contract_type": "full_time", "made_up": "x"} for _ in items]

    frame = spark.createDataFrame(rows, "id int, description_md string, title string")
    got = {(r.id, r.field): (r.value, r.confidence) for r in cascade.second_tier(frame, ask, "id", ("remote_policy_extracted", "contract_type"), batch=1).collect()}
    assert got == {(1, "contract_type"): ("full_time", 0.62), (2, "contract_type"): ("full_time", 0.62), (2, "remote_policy_extracted"): ("remote", 0.62)}
    assert cascade.second_tier(frame, ask, "id", (), batch=2).count() == 0
