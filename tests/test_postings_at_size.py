"""Work over postings: dealt by the table's size, computed once, and the same for plain and for other texts."""

from __future__ import annotations

from harness import SF_DIR
from pyspark.sql import functions as F

from quern import fixtures
from quern.functions import cascade, rules
from quern.functions.lets import unnested
from quern.plans import catalog


def test_postings_are_dealt_after_the_join_by_size(spark, monkeypatch):
    """However few row groups a file has, and whatever the join with the customers leaves."""
    monkeypatch.setattr(fixtures, "_DEALT", 20_000)
    assert fixtures.jobs(spark, SF_DIR).rdd.getNumPartitions() > 10


def test_a_list_that_is_exploded_is_computed_once(spark):
    """No filter makes the list again to see whether it is empty."""
    plan = catalog.QUERIES["top_skills"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "transform" in line]


def test_unnested_keeps_null_items_and_drops_empty_lists(spark):
    rows = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "k int, v array<string>")
    assert sorted(unnested(rows, "v", "x", "k").collect(), key=str) == sorted(rows.select("k", F.explode("v").alias("x")).collect(), key=str)


def test_plain_patterns_agree_with_unicode_ones(spark):
    texts = ["PYTHON, sql and Kafka", "5+ Years Of Experience", "Ph.D. preferred", "no\u000bon-call", "Sr. K8S", "a\u001cpython\u001d", "Série Python", "Kfka kafka", "W&B or C++x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [p for _, p in cascade.TECH_STACK.rules] + [cascade.YEARS, cascade.NO_CALL, cascade.CALL, *(p for _, p in cascade.EDUCATION)]
    got = df.select(*(rules.occurs(F.col("t"), p).alias(f"a{i}") for i, p in enumerate(patterns)), *(F.col("t").rlike(rules.unicode(p)).alias(f"b{i}") for i, p in enumerate(patterns))).collect()
    for row in got:
        assert [row[f"a{i}"] for i in range(len(patterns))] == [row[f"b{i}"] for i in range(len(patterns))]
