"""Joins, sets and streams over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from .registry import JOBS, query

_DEFAULTS = "(VALUES ('company_0', 'US'), ('company_1', 'CA'), ('company_2', 'CA')) d(slug, default_country)"


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_keys(spark, sf):
    t = lambda n: fixtures.table(spark, sf, n)
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query(JOBS + f"SELECT id, default_country FROM jobs0 LEFT JOIN {_DEFAULTS} ON slug = company_slug")
def join_left_defaults(spark, sf):
    defaults = spark.createDataFrame([("company_0", "US"), ("company_1", "CA"), ("company_2", "CA")], "company_slug string, default_country string")
    return fixtures.jobs(spark, sf).join(F.broadcast(defaults), "company_slug", "left").select("id", "default_country")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_known(spark, sf):
    t = lambda n: fixtures.table(spark, sf, n)
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_unknown(spark, sf):
    t = lambda n: fixtures.table(spark, sf, n)
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


_TEMPLATES = (("t1", "DS", "senior", None), ("t2", "MLE", "staff", None), ("t3", "DE", "mid", "US"), ("t4", "DA", "junior", "CA"))
_TV = ", ".join(f"('{a}', '{b}', '{c}', {repr(d) if d else 'NULL'})" for a, b, c, d in _TEMPLATES)


@query(JOBS + f"SELECT t, id FROM jobs JOIN (VALUES {_TV}) v(t, role, sen, ctry) ON role = role_family_extracted AND sen = seniority_extracted AND (ctry IS NULL OR ctry = country)")
def join_optional_key(spark, sf):
    from .postings import enriched

    v = spark.createDataFrame(list(_TEMPLATES), "t string, role string, sen string, ctry string")
    on = (F.col("role") == F.col("role_family_extracted")) & (F.col("sen") == F.col("seniority_extracted")) & (F.col("ctry").isNull() | (F.col("ctry") == F.col("country")))
    return enriched(spark, sf).join(F.broadcast(v), on).select("t", "id")


@query("SELECT text, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_docs(spark, sf):
    return fixtures.table(spark, sf, "documents").groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf):
    rows = fixtures.table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
