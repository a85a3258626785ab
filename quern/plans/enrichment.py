"""The whole way of a posting: normalised, validated, enriched, shown."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import cascade, text, title
from ..operators import indexing, ingest, models, retrieval, sqlguard, stats, views
from ..sources import stages
from .postings import enriched
from .registry import JOBS, query
from .retrieving import prepared


def _extracted(spark, sf):
    jobs = fixtures.jobs(spark, sf)
    return jobs.withColumns({"scraped_at": F.lit("2026-05-01").cast("timestamp"), "raw_payload_hash": F.sha2("url", 256)})


@query()
def full_normalize(spark, sf):
    return ingest.normalize(_extracted(spark, sf))


@query()
def ingest_valid(spark, sf):
    return ingest.ingest(_extracted(spark, sf))[0].select("id", "country", "remote_policy", "salary_max_usd_yearly")


@query()
def ingest_counts(spark, sf):
    return ingest.ingest(_extracted(spark, sf))[1]


@query()
def enriched_table(spark, sf):
    return ingest.enrich(ingest.normalize(_extracted(spark, sf))).select("id", "seniority_label_v1", "extracted_skills_v1", "prediction_model_version")


@query()
def match_cards(spark, sf):
    """Cards of the postings that a question finds by its words."""
    rows = _extracted(spark, sf)
    words = F.concat_ws(" ", title.strip_suffix(F.col("title")), "description_md")
    question = spark.createDataFrame([(0, "remote machine learning engineer with PyTorch and Kubernetes")], "q int, question string")
    weights = retrieval.bm25_weights(rows.select("id", words.alias("words")), "id", "words", retrieval.terms(question, "q", "question"))
    hits = retrieval.sparse_top_k(question, weights, "q", "question", "id", 25)
    found = stages.temporary(hits.select(F.col("item").alias("id"), "score"), "hits")
    # Only what is shown is normalised.
    shown = rows.join(F.broadcast(found.select("id").distinct()), "id", "left_semi")
    return ingest.matches(ingest.normalize(shown), found, 10)


@query(JOBS + """SELECT id, company_slug, company_name, title, url, country, region, city, remote_policy, source, strftime(posted_at, '%Y-%m-%dT%H:%M:%S') AS posted_at, round(salary_min_usd_yearly, 4) AS salary_min_usd_yearly,
    round(salary_max_usd_yearly, 4) AS salary_max_usd_yearly, salary_disclosed, seniority_extracted, role_family_extracted, CASE WHEN k % 3 <> 0 THEN round(predicted_salary_usd_v1, 0) END AS predicted_salary_usd_v1 FROM jobs""")
def payload_projection(spark, sf):
    jobs = enriched(spark, sf).withColumn("predicted_salary_usd_v1", F.when(F.col("k") % 3 == 0, float("nan")).otherwise(F.round("predicted_salary_usd_v1", 0)))
    return indexing.payload(jobs).withColumns({c: F.round(c, 4) for c in ("salary_min_usd_yearly", "salary_max_usd_yearly")})


@query()
def search_end_to_end(spark, sf):
    """Every benchmark text against the chunks of every document: dense, sparse, fused, reranked, hydrated."""
    return indexing.search(fixtures.table(spark, sf, "benchmark"), prepared(spark, sf), retrieval.hashing_embedder(64), retrieval.lexical_overlap, "item_id", "text", 5).drop("parent_text")


@query(JOBS + "SELECT id, title FROM jobs WHERE country = 'US' AND salary_max_usd_yearly >= 100000 AND contains(lower(title), 'engineer') ORDER BY id LIMIT 40")
def search_bound(spark, sf):
    text = "SELECT id, title FROM {jobs} WHERE country = :country AND salary_max_usd_yearly >= :least AND contains(lower(title), :words) ORDER BY id LIMIT 40"
    return views.bound(enriched(spark, sf), text, country="US", least=100_000, words="engineer")


@query("SELECT o_orderkey, o_orderdate AS plain, o_orderdate - INTERVAL 2 HOUR AS shifted, CAST(NULL AS TIMESTAMP) AS broken FROM orders")
def iso_dates(spark, sf):
    orders = fixtures.table(spark, sf, "orders")
    written = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    read = lambda c: text.parse_iso(c).cast("timestamp_ntz")
    return orders.select("o_orderkey", read(F.concat(written, F.lit("Z"))).alias("plain"), read(F.concat(written, F.lit("+02:00"))).alias("shifted"), read(F.concat(F.lit("on "), written)).alias("broken"))


_TAXONOMY = {"python": "Python", "sql": "SQL", "aws": "Cloud", "pytorch": "Deep Learning", "kafka": "Streaming"}
_TAXONOMY_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _TAXONOMY.items()) + "}"


@query(JOBS + f"SELECT id, coalesce(tech_stack, []) AS skills, list_filter(list_transform(coalesce(tech_stack, []), lambda s: {_TAXONOMY_SQL}[lower(s)]), lambda x: x IS NOT NULL) AS families FROM jobs")
def skills_mapped(spark, sf):
    """Blanks and nulls go, versions and capitals do not matter, each family once."""
    noisy = F.concat(F.transform(F.coalesce("tech_stack", F.array().cast("array<string>")), lambda s: F.concat(F.lit(" "), s, F.lit(" 3. "))), F.array(F.lit(None).cast("string"), F.lit("  ")))
    jobs = enriched(spark, sf)
    return jobs.select("id", text.clean_list(F.col("tech_stack")).alias("skills"), text.map_skills(noisy, _TAXONOMY).alias("families"))


@query(JOBS + "SELECT id, CASE WHEN k % 4 = 0 THEN 'Given title' ELSE title END AS title FROM jobs")
def override_merge(spark, sf):
    given = F.when(F.col("k") % 4 == 0, "Given title").when(F.col("k") % 4 == 1, "  ")
    return enriched(spark, sf).select("id", text.override(given, F.col("title")).alias("title"))


@query(JOBS + "SELECT id, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS value, CASE WHEN k % 2 = 0 THEN 0.8 ELSE 0.9 END AS confidence FROM jobs0")
def confidence_merge(spark, sf):
    """The surer of two tiers; the first on ties."""
    part = lambda value, confidence: F.struct(F.lit(value).alias("value"), confidence.alias("confidence"), F.lit("r").alias("rule_id"))
    merged = cascade.merge(part("a", F.lit(0.8)), part("b", F.when(F.col("k") % 4 == 0, 0.8).when(F.col("k") % 2 == 0, 0.7).otherwise(0.9)))
    return fixtures.jobs(spark, sf).select("id", merged.alias("m")).select("id", "m.value", "m.confidence")


_NORM = "sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))"


@query(f"SELECT vec_id, round({_NORM}, 4) AS before, 1.0 AS after FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS embedding FROM embeddings)")
def renormalised(spark, sf):
    vectors = fixtures.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    norm = lambda v: F.round(F.sqrt(retrieval.dot(v, v)), 4)
    return vectors.select("vec_id", norm(F.col("v")).alias("before"), norm(retrieval.renormalized(F.col("v"))).alias("after"))


_SLICES = "[e[1:16], e[17:32], e[33:48], e[49:64]]"


@query(f"SELECT vec_id, round(list_sum(list_transform([q[1:16], q[17:32]], lambda a: list_max(list_transform({_SLICES}, lambda b: list_dot_product(a, b))))), 4) AS score FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)")
def late_interaction(spark, sf):
    """Two token vectors of a question against four of every passage."""
    vectors = fixtures.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    part = lambda v, i: F.slice(v, 16 * i + 1, 16)
    asked = vectors.where("vec_id = 0").select(F.array(part("e", 0), part("e", 1)).alias("q"))
    return vectors.join(F.broadcast(asked)).select("vec_id", F.round(retrieval.max_sim(F.col("q"), F.array(*(part("e", i) for i in range(4)))), 4).alias("score"))


@query("""WITH l AS (SELECT l_suppkey AS query, l_partkey AS item, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS rank FROM lineitem),
f AS (SELECT query, item, min(rank) AS r FROM l GROUP BY ALL) SELECT * FROM (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY r, item) AS rank FROM f) WHERE rank <= 20""")
def ranked_once(spark, sf):
    own = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    ranked = fixtures.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("part"), F.row_number().over(own).alias("rank"))
    return retrieval.first_per_item(ranked, "part", 20)


@query(JOBS + "SELECT id, greatest(0.0, round(predicted_salary_usd_v1, 0) - 50000) AS low, round(predicted_salary_usd_v1, 0) + 50000 AS high FROM jobs0")
def salary_bands(spark, sf):
    low, high = models.salary_band(F.round("predicted_salary_usd_v1", 0), F.lit(50_000.0))
    return fixtures.jobs(spark, sf).select("id", low.alias("low"), high.alias("high"))


#: (name, statement over postings, what it gives in DuckDB, or None where it must be refused).
_STATEMENTS = (
    ("plain", "SELECT country, count(*) AS n FROM jobs GROUP BY country", "SELECT count(*) FROM (SELECT DISTINCT country FROM jobs)"),
    ("semicolon", "SELECT title FROM jobs;", "SELECT least(count(*), 1000) FROM jobs"),
    ("two", "SELECT title FROM jobs; SELECT 1", None),
    ("write", "DELETE FROM jobs", None),
    ("other table", "SELECT * FROM secrets", None),
    ("name in a literal", "SELECT ', secrets as (' AS y, title FROM secrets", None),
    ("name in a comment", "SELECT /* , secrets as ( */ title FROM secrets", None),
    ("out of scope", "SELECT title FROM (WITH t AS (SELECT title FROM jobs) SELECT title FROM t) JOIN t USING (title)", None),
    ("other column", "SELECT description_md FROM jobs", None),
    ("jvm", "SELECT java_method('java.lang.System', 'exit', 0) FROM jobs", None),
    ("union", "SELECT title FROM jobs UNION SELECT country FROM jobs", None),
    ("with", "WITH t AS (SELECT title, country FROM jobs), u AS (SELECT title FROM t WHERE country = 'US') SELECT DISTINCT title FROM u", "SELECT count(DISTINCT title) FROM jobs WHERE country = 'US'"),
    ("subquery", "SELECT title FROM jobs WHERE country IN (SELECT max(country) FROM jobs) LIMIT 7", "SELECT least(count(*), 7) FROM jobs WHERE country = (SELECT max(country) FROM jobs)"),
    ("empty", "  ", None),
)


@query(JOBS + " UNION ALL ".join(f"SELECT '{name}' AS statement, {'false' if rows is None else 'true'} AS accepted, {'NULL' if rows is None else f'({rows})'}::BIGINT AS n_rows" for name, _, rows in _STATEMENTS))
def sqlguard_matrix(spark, sf):
    """Each statement over the postings: whether it is accepted, and how many rows it gives."""
    jobs, out = enriched(spark, sf), None
    for name, sql, _ in _STATEMENTS:
        try:
            found = sqlguard.execute(jobs, sql, ["country", "title"]).agg(F.count("*").alias("n_rows")).select(F.lit(True).alias("accepted"), "n_rows")
        except (sqlguard.UnsafeSql, ParseException):
            found = spark.range(1).select(F.lit(False).alias("accepted"), F.lit(None).cast("long").alias("n_rows"))
        row = found.select(F.lit(name).alias("statement"), "accepted", "n_rows")
        out = row if out is None else out.union(row)
    return out


@query()
def principal_plane(spark, sf):
    return stats.principal_plane(fixtures.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"])
