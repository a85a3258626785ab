"""Ranked words: packs against a plain join, asked terms alone, and the numbers of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import retrieval


def _docs(spark):
    return spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 6 + i % 3)) if i % 11 else "") for i in range(60)], "d int, text string")


def test_packs_rank_as_a_join_does(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SPARSE_ENTRIES", 40)
    monkeypatch.setattr(retrieval, "SPARSE_QUERIES", 2)
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w1 none") for q in range(5)], "q int, text string")
    weights = retrieval.bm25_weights(_docs(spark), "d", "text")
    joined = retrieval.terms(asked, "q", "text").select(F.col("q").alias("query"), "term").join(weights, "term").groupBy("query", F.col("d").alias("item")).agg(F.round(F.sum("weight"), 10).alias("score"))
    plain = retrieval.top_k(joined, "query", "item", "score", 6).withColumn("score", F.round("score", 4))
    got = retrieval.sparse_top_k(asked, weights, "q", "text", "d", 6).select(*plain.columns)
    assert sorted(got.collect()) == sorted(plain.collect())
    # No row is a pair of query and item before the ranking.
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_weights_of_asked_terms_are_those_of_all(spark):
    docs = _docs(spark)
    asked = spark.createDataFrame([("w1",), ("w3",), ("none",)], "term string")
    whole = retrieval.bm25_weights(docs, "d", "text").where("term in ('w1', 'w3')")
    assert sorted(retrieval.bm25_weights(docs, "d", "text", asked).collect()) == sorted(whole.collect())


def test_children_count_on_and_their_rows_are_not_sorted_with_their_parents_text(spark):
    docs = spark.createDataFrame([(1, "t", "abcdefghij" * 3)], "d int, title string, body string")
    made = retrieval.chunk(docs, "d", "title", "body", lambda t: retrieval.fixed_width(t, 20), lambda t: retrieval.fixed_width(t, 8))
    assert [r.child_chunk_id for r in made.orderBy("child_chunk_id").collect()] == [f"1::c{i:04d}" for i in range(made.count())]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Window")
