"""Chunks and lexical rankings of many texts: no text and no word is shuffled, and results are those of the plain way."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import retrieval
from quern.plans import catalog


def _shuffled(df):
    """The columns that go through an exchange."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line]


def _cut(make, docs):
    fixed = make(docs, "k", "title", "body", lambda t: retrieval.fixed_width(t, 40), lambda t: retrieval.fixed_width(t, 15))
    return [sorted(tuple(r) for r in df.collect()) for df in (fixed, make(docs, "k", "title", "body"))]


def test_chunks_are_cut_where_the_text_is(spark):
    rows = [(i, None if i == 3 else f"T{i}", ("\n\n".join(f"part {j} of {i}. " * 90 for j in range(i)) or None) if i != 4 else "  ") for i in range(9)]
    docs = spark.createDataFrame(rows, "k long, title string, body string")
    assert _cut(retrieval.chunk_in_place, docs) == _cut(retrieval.chunk, docs)
    assert not _shuffled(retrieval.chunk_in_place(docs, "k", "title", "body"))
    twice = docs.where("k = 5").unionByName(docs.where("k = 5"))
    assert retrieval.chunk_in_place(twice, "k", "title", "body").select("child_chunk_id").distinct().count() == retrieval.chunk(twice, "k", "title", "body").count()


def test_words_are_ranked_as_by_stored_weights(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SPARSE_QUERIES", 2)
    rows = [(None if i % 13 == 5 else i, " ".join(f"W{(i * j) % 7}é" for j in range(1, 6 + i % 3)) if i % 11 else "") for i in range(60)]
    docs = spark.createDataFrame([*rows, (70, None)], "d int, text string").repartition(5)
    asked = spark.createDataFrame([(q, f"w{q}é w{q + 1}é w1é w1é none") for q in range(5)] + [(7, None), (None, "w1é")], "q int, text string")
    weights = retrieval.bm25_weights(docs, "d", "text")
    for pool in (None, docs.where("d % 2 = 0").select("d")):
        of = weights if pool is None else weights.join(pool, "d", "left_semi")
        want = retrieval.sparse_top_k(asked, of, "q", "text", "d", 6)
        got = retrieval.word_top_k(asked, docs, "q", "text", "d", "text", 6, pool)
        assert sorted(got.select(*want.columns).collect()) == sorted(want.collect()) and got.count() > 20
    assert retrieval.word_top_k(asked, docs.where("false"), "q", "text", "d", "text").count() == 0


def test_chunks_of_documents_go_through_no_exchange(spark):
    assert not _shuffled(catalog.QUERIES["chunk_recursive"](spark, "/root/testdata/sf0.001"))
