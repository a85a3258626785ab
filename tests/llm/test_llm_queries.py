"""Registered queries on the smallest tables, and the pipeline stage by stage."""

from __future__ import annotations

import harness
import pytest

from quern.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert harness.differences(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF_DIR) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, before, SF_DIR), name)
        assert after.columns == docs.columns
        assert 0 < after.count() <= before.count()
        if name in ("line_dedup", "pii"):
            assert after.count() == before.count()
        before = after
    bins = corpus_pipeline.STAGES[-1][1](spark, before, SF_DIR)
    assert bins.selectExpr("sum(used) = sum(aggregate(lengths, 0, (s, x) -> s + x)) AS same").first().same
    ids = {r.d for r in bins.selectExpr("explode(doc_ids) AS d").distinct().collect()}
    assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
    assert bins.count() == corpus_pipeline.run(spark, SF_DIR).count()
