"""The keyed collection, the stored index and stage tables, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import vector_index
from quern.sources import collection, stages


def _made(spark, path, **more):
    return collection.Collection.create(spark, path, "k string, v array<float>, n int", "k", "v", 2, **more)


def _frame(spark, rows):
    return spark.createDataFrame([(k, [float(n), 1.0], n) for k, n in rows], "k string, v array<float>, n int")


def _held(c):
    return {r.k: r.n for r in c.read().collect()}


def test_collection_follows_a_dictionary(spark, tmp_path):
    rng, plain = np.random.default_rng(2), {}
    c = _made(spark, f"file://{tmp_path}/c", buckets=4)
    assert c.read().count() == 0
    for turn in range(4):
        rows = {f"k{i}": int(turn * 100 + i) for i in rng.integers(0, 30, 12)}
        gone = {f"k{i}" for i in rng.integers(0, 40, 5)} if turn else set()
        done = c.upsert(_frame(spark, rows.items()), spark.createDataFrame([(k,) for k in gone], "k string"))
        new = {k: n for k, n in rows.items() if k not in gone}
        assert (done.replaced, done.added, done.deleted) == (len(new.keys() & plain.keys()), len(new.keys() - plain.keys()), len(gone & plain.keys()))
        plain = {k: n for k, n in (plain | new).items() if k not in gone}
        assert _held(c) == plain
    assert c.vacuum() > 0 and _held(c) == plain and c.vacuum() == 0


def test_only_touched_buckets_change(spark, tmp_path):
    c = _made(spark, f"file://{tmp_path}/c", buckets=8)
    c.upsert(_frame(spark, [(f"k{i}", i) for i in range(60)]))
    before = c.manifest()["data"]
    done = c.upsert(_frame(spark, [("k3", 1000), ("k3", 7)]))
    after = c.manifest()["data"]
    assert (done.touched, done.untouched, done.replaced) == (1, 7, 1)
    assert sum(before[b] != after[b] for b in before) == 1 and _held(c)["k3"] == 1000


def test_failed_and_rival_upserts_leave_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    c = _made(spark, path, buckets=2)
    c.upsert(_frame(spark, [("a", 1)]))
    with pytest.raises(ValueError):
        c.upsert(spark.createDataFrame([("b", [1.0], 2)], "k string, v array<float>, n int"))
    with pytest.raises(ValueError):
        c.upsert(_frame(spark, [(None, 2)]))
    assert _held(c) == {"a": 1}
    old = c.manifest()
    c.upsert(_frame(spark, [("a", 5)]))
    with pytest.raises(collection.Conflict):
        c._commit(old | {"version": old["version"] + 1})
    assert _held(_made(spark, path)) == {"a": 5}
    with pytest.raises(FileNotFoundError):
        collection.Collection(spark, f"file://{tmp_path}/none").read()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 700)] + 0.3 * rng.normal(size=(700, 16)), centres[0] + 0.05 * rng.normal(size=(400, 16))])
    rows = [(f"v{i}", v.tolist(), i % 3) for i, v in enumerate(x)]
    return x, spark.createDataFrame([*rows, ("null", None, 0), (None, [0.0] * 16, 0)], "k string, v array<double>, part int").repartition(4)


def test_index_finds_true_neighbours(spark, vectors, tmp_path, monkeypatch):
    x, frame = vectors
    # Blocks and groups so small that the large cell is cut into many.
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 64)
    monkeypatch.setattr(vector_index, "GROUP_ROWS", 8)
    index = vector_index.VectorIndex.build(frame, f"file://{tmp_path}/i", "k", "v", ["part"], cells=20)
    asked = frame.where("part = 0 and k is not null and v is not null")
    for where, taken in ((None, np.arange(len(x))), (F.col("part") == 1, np.arange(1, len(x), 3))):
        got = {}
        for r in index.search(asked, "k", "v", 10, where, own=False).collect():
            got.setdefault(r.query, {})[r.rank] = (r.item, r.score)
        hits = total = 0
        for i in range(0, len(x), 3):
            s = x[taken] @ x[i]
            s[taken == i] = -np.inf
            best = taken[np.argsort(-s, kind="stable")[:10]]
            found = [int(item[1:]) for item, _ in got[f"v{i}"].values()]
            hits, total = hits + len(set(found) & set(best.tolist())), total + 10
            assert all(round(float(x[int(item[1:])] @ x[i]), 4) == pytest.approx(score, abs=1e-4) for item, score in got[f"v{i}"].values())
        assert hits >= 0.9 * total
    assert index.search(asked, "k", "v", 10, probes=20, own=True).where("rank = 1").count() == asked.count()


def test_index_reads_probed_cells_alone(spark, vectors, tmp_path):
    _, frame = vectors
    index = vector_index.VectorIndex.build(frame, f"file://{tmp_path}/i", "k", "v", cells=20)
    found = index.search(frame.where("k = 'v5'"), "k", "v", 3, probes=2)
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") and " IN (" in plan


def test_index_of_nothing(spark, tmp_path):
    frame = spark.createDataFrame([("a", None)], "k string, v array<double>")
    index = vector_index.VectorIndex.build(frame, f"file://{tmp_path}/i", "k", "v")
    assert index.meta["probes"] == 1


def test_staged_tables_are_made_once(spark, tmp_path):
    folder, calls = f"file://{tmp_path}", []
    spark.range(5).write.parquet(f"{folder}/in")

    def build():
        calls.append(1)
        return spark.range(3)

    key = stages.fingerprint(spark.read.parquet(f"{folder}/in"), "p")
    for _ in range(2):
        assert stages.staged(spark, "t", key, build, folder).count() == 3
    assert len(calls) == 1
    assert stages.fingerprint(spark.read.parquet(f"{folder}/in"), "q") != key
    spark.range(1).write.mode("append").parquet(f"{folder}/in")
    assert stages.fingerprint(spark.read.parquet(f"{folder}/in"), "p") != key
