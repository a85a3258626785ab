"""Sources, sinks and small surfaces, each over a given table and through the shared folder: written, read back, compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import cascade, title
from ..operators import indexing, modelling, retrieval, sampling, sqlguard
from ..sources import files, payloads, stages
from .postings import _SNAPS, enriched
from .registry import JOBS, query


def _folder(spark, name):
    """A folder of this run alone."""
    return f"{stages.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- snapshots and curated tables -------------------------------------------------------


def _written_snapshots(spark, sf):
    """Four snapshots, the second written again with postings of even numbers alone."""
    root = _folder(spark, "snapshots")
    parts = fixtures.snapshots(spark, sf)
    for part, date in zip(parts, fixtures.SNAPSHOT_DATES, strict=True):
        files.write_snapshot(part, root, date)
    files.write_snapshot(parts[1].where("k % 2 = 0"), root, fixtures.SNAPSHOT_DATES[1])
    return root


_SECOND = f"DATE '{fixtures.SNAPSHOT_DATES[1]}'"
_KEPT = f"{_SNAPS}, kept AS (SELECT * FROM snaps WHERE snapshot_date <> {_SECOND} OR k % 2 = 0) "


@query(_KEPT + "SELECT snapshot_date, count(*) AS n, count(DISTINCT id) AS n_ids, count(description_md) AS n_texts FROM kept GROUP BY 1")
def snapshot_table(spark, sf):
    rows = files.read_snapshots(spark, _written_snapshots(spark, sf))
    return rows.groupBy("snapshot_date").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count("description_md").alias("n_texts"))


@query(_KEPT + f"SELECT id, title, snapshot_date FROM kept WHERE snapshot_date = {_SECOND}")
def snapshot_latest(spark, sf):
    """The snapshot written last, by the pointer: one partition is read."""
    return files.latest_snapshot(spark, _written_snapshots(spark, sf)).select("id", "title", "snapshot_date")


@query(_SNAPS + "SELECT snapshot_date, count(*) AS n FROM snaps GROUP BY 1")
def snapshot_folders(spark, sf):
    """Dated folders of another writer, tagged by their paths."""
    root = _folder(spark, "dated")
    for part, date in zip(fixtures.snapshots(spark, sf), fixtures.SNAPSHOT_DATES, strict=True):
        part.drop("snapshot_date").write.parquet(f"{root}/{date}/jobs.parquet")
    return files.read_dated(spark, root).groupBy("snapshot_date").agg(F.count("*").alias("n"))


@query(_SNAPS + "SELECT 'active' AS name, count(*) AS n FROM snaps WHERE snapshot_date = (SELECT max(snapshot_date) FROM snaps) UNION ALL SELECT 'history', count(DISTINCT id) FROM snaps")
def curated_tables(spark, sf):
    from ..operators import history

    root, rows = _folder(spark, "curated"), history.union_snapshots(fixtures.snapshots(spark, sf))
    files.write_curated(history.active(rows), history.history(rows), root)
    count = lambda name: spark.read.parquet(f"{root}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count("active").union(count("history"))


_LABELLED = "SELECT id, coalesce(seniority_extracted, 'unknown') AS seniority_label_v1, coalesce(role_family_extracted, 'unknown') AS role_family_v1, CASE WHEN k % 3 = 0 THEN 'NaN'::DOUBLE WHEN k % 3 = 1 THEN predicted_salary_usd_v1 END AS predicted_salary_usd_v1 FROM jobs"


@query(JOBS + f", e AS ({_LABELLED}) SELECT count(*) AS n, count(*) FILTER (seniority_label_v1 <> 'unknown') AS n_seniority, count(*) FILTER (role_family_v1 <> 'unknown') AS n_role_family, count(*) FILTER (NOT isnan(predicted_salary_usd_v1)) AS n_salary FROM e")
def enriched_coverage(spark, sf):
    """Of the enriched table as written: how many rows carry each prediction."""
    rows = spark.sql(_LABELLED.replace("'NaN'::DOUBLE", "DOUBLE('NaN')").replace("FROM jobs", "FROM {jobs}"), jobs=enriched(spark, sf))
    path = _folder(spark, "enriched")
    rows.write.parquet(path)
    return files.coverage(spark.read.parquet(path))


@query(JOBS + "SELECT id FROM jobs WHERE country = 'CA'")
def known_ids(spark, sf):
    """The first of the paths that is there, and of it no column but the ids."""
    root = _folder(spark, "known")
    enriched(spark, sf).where("country = 'CA'").write.parquet(f"{root}/base")
    return files.known_ids(spark, files.first_existing(spark, f"{root}/enriched", f"{root}/base"))


# --- lines, tables and shards -----------------------------------------------------------

_LATER = "doc_id % 3 = 0"


@query(f"SELECT doc_id, CAST(CASE WHEN {_LATER} THEN 1 - quality ELSE quality END AS INT) AS quality FROM labels WHERE quality IS NOT NULL")
def jsonl_last_wins(spark, sf):
    """Two files of lines, some broken and some without what is required: the later file's line of a key counts."""
    labels, root = fixtures.table(spark, sf, "labels"), _folder(spark, "lines")
    one = lambda rows, quality: rows.select(F.to_json(F.struct("doc_id", quality.alias("quality"))).alias("value"))
    broken = labels.select(F.concat(F.lit('{"doc_id": '), "doc_id", F.lit(', "quality"')).alias("value")).union(labels.select(F.to_json(F.struct("doc_id")).alias("value"))).union(labels.select(F.lit("").alias("value")))
    one(labels, F.col("quality")).union(broken).write.text(f"{root}/a")
    one(labels.where(_LATER), 1 - F.col("quality")).write.text(f"{root}/b")
    read = lambda name, order: files.read_jsonl(spark, f"{root}/{name}", "doc_id long, quality int", ("doc_id", "quality")).withColumn("file", F.lit(order))
    return files.last_by_key(read("a", 1).union(read("b", 2)), "doc_id", "file").select("doc_id", "quality")


@query("SELECT c_custkey, c_name || ', \"the ' || c_mktsegment || '\"' || chr(10) || 'x' AS name, round(c_acctbal / 3, 4) AS third FROM customer")
def csv_round_trip(spark, sf):
    """Commas, quotes and line ends in fields survive, and numbers keep four places."""
    rows = fixtures.table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(', "the '), "c_mktsegment", F.lit('"\nx')).alias("name"), (F.col("c_acctbal") / 3).alias("third"))
    path = _folder(spark, "csv")
    files.write_csv(rows, path)
    return spark.read.schema("c_custkey long, name string, third double").option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


@query("SELECT CAST(shard AS INT) AS shard, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 AS shard FROM orders) GROUP BY 1")
def jsonl_shards(spark, sf):
    path = _folder(spark, "shards")
    files.write_jsonl_shards(fixtures.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path, 700, "o_orderkey")
    rows = spark.read.schema("o_orderkey long, o_orderstatus string, shard int").json(path)
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


_STATUS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM {orders} GROUP BY ALL"


@query(_STATUS.format(orders="orders"))
def report_round_trip(spark, sf):
    """A report as indented JSON in a file, read back."""
    report = spark.sql(_STATUS, orders=fixtures.table(spark, sf, "orders"))
    path = f"{_folder(spark, 'report')}/report.json"
    stages.create_once(spark, path, files.report_json(report))
    return spark.read.schema("o_orderstatus string, o_orderpriority string, n long, mean double").option("multiLine", "true").json(path)


@query("SELECT o_orderpriority AS priority, CAST(n AS VARCHAR) AS orders FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def report_table(spark, sf):
    """A report as a markdown table in a file, its rows read back."""
    counts = fixtures.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    path = f"{_folder(spark, 'report')}/report.md"
    stages.create_once(spark, path, files.report_markdown(counts, "Orders"))
    cells = F.split("value", r" ?\| ?")
    return spark.read.text(path).where("value LIKE '| %' AND value NOT LIKE '| o\\_%'").select(cells[1].alias("priority"), cells[2].alias("orders"))


# --- boards -----------------------------------------------------------------------------

_PAY = ("salary_min", "salary_max", "salary_currency", "salary_period")


def _boards(spark, sf):
    """What the boards of all companies would answer, made of the postings: one JSON text a company and provider, with some that are broken or unknown."""
    jobs = fixtures.jobs(spark, sf)
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    body = F.concat(F.lit("<p>"), "description_md", F.lit("</p>"))
    green = F.struct(F.col("url").alias("absolute_url"), "title", F.struct(F.col("location_raw").alias("name")).alias("location"), body.alias("content"), F.lit("2026-05-01T00:00:00Z").alias("first_published"), F.when(F.col("salary_disclosed"), F.array(F.struct(cents("salary_min").alias("min_cents"), cents("salary_max").alias("max_cents"), F.col("salary_currency").alias("currency_type"), F.col("salary_period").alias("interval")))).alias("pay_input_ranges"))
    lever = F.struct(F.col("title").alias("text"), F.col("url").alias("hostedUrl"), F.struct(F.col("location_raw").alias("location")).alias("categories"), F.lit(1777593600000).alias("createdAt"), body.alias("description"), F.when(F.col("salary_disclosed"), F.struct(F.col("salary_min").alias("min"), F.col("salary_max").alias("max"), F.col("salary_currency").alias("currency"), F.concat(F.lit("per-"), "salary_period").alias("interval"))).alias("salaryRange"))
    pay = F.struct(F.lit("Salary").alias("compensationType"), F.struct(F.col("salary_min").alias("minValue"), F.col("salary_max").alias("maxValue"), F.col("salary_currency").alias("currencyCode"), F.col("salary_period").alias("interval")).alias("compensationValue"))
    ashby = F.struct(F.col("url").alias("jobUrl"), "title", F.coalesce("location_raw", F.lit("")).alias("location"), F.col("description_md").alias("descriptionPlain"), F.when(F.col("salary_disclosed"), F.struct(F.array(F.struct(F.array(pay).alias("components"))).alias("compensationTiers"))).alias("compensation"))
    shapes = {"greenhouse": (green, True), "lever": (lever, False), "ashby": (ashby, True)}
    out = None
    for provider, (shape, named) in shapes.items():
        own = jobs.where(F.col("source") == provider).groupBy("company_slug", "company_name").agg(F.collect_list(shape).alias("jobs"))
        text = F.to_json(F.struct("jobs")) if named else F.to_json("jobs")
        own = own.select("company_slug", "company_name", F.lit(provider).alias("provider"), text.alias("payload"))
        out = own if out is None else out.union(own)
    other = fixtures.table(spark, sf, "nation").select(F.concat(F.lit("nation_"), "n_nationkey").alias("company_slug"), F.col("n_name").alias("company_name"), F.when(F.col("n_nationkey") % 2 == 0, "lever").otherwise("elsewhere").alias("provider"), F.when(F.col("n_nationkey") % 2 == 0, "{broken").otherwise("{}").alias("payload"))
    return out.union(other)


@query(JOBS + f"SELECT substr(sha256(company_slug || '|' || url), 1, 16) AS id, company_slug, source, title, coalesce(location_raw, CASE WHEN source = 'ashby' THEN '' END) AS location_raw, round(salary_min, 2) AS salary_min, round(salary_max, 2) AS salary_max, salary_currency, salary_period, salary_disclosed FROM jobs0")
def board_payloads(spark, sf):
    jobs, _ = payloads.extract_all(_boards(spark, sf))
    place = F.when(F.col("source") == "ashby", F.coalesce("location_raw", F.lit(""))).otherwise(F.col("location_raw"))
    return jobs.select("id", "company_slug", "source", "title", place.alias("location_raw"), F.round("salary_min", 2).alias("salary_min"), F.round("salary_max", 2).alias("salary_max"), "salary_currency", "salary_period", "salary_disclosed")


@query(
    JOBS
    + """SELECT company_slug, source AS provider, count(*) AS jobs, NULL AS error FROM jobs0 GROUP BY 1, 2
UNION ALL SELECT 'nation_' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'lever' ELSE 'elsewhere' END, 0, CASE WHEN n_nationkey % 2 = 0 THEN 'unreadable payload' ELSE 'unknown provider' END FROM nation"""
)
def payload_errors(spark, sf):
    """One row a payload: how many postings it gave, or why none."""
    return payloads.extract_all(_boards(spark, sf))[1]


@query(JOBS + "SELECT source AS provider, count(DISTINCT company_slug) AS n, true AS supported FROM jobs0 GROUP BY 1")
def registry_table(spark, sf):
    """A registry written as YAML and read again, by provider."""
    import yaml

    rows = fixtures.jobs(spark, sf).select("company_slug", "company_name", "source").distinct().orderBy("company_slug", "source")
    # A list that people maintain: some companies a board.
    listed = [{"slug": r.company_slug, "name": r.company_name, "provider": r.source, "handle": r.company_slug} for r in rows.limit(10_000).collect()]
    path = f"{_folder(spark, 'registry')}/companies.yaml"
    stages.create_once(spark, path, yaml.safe_dump({"companies": listed}))
    return payloads.by_provider(payloads.load_registry(spark, path)).select("provider", "n", "supported")


@query("SELECT l_orderkey AS company, arg_min(l_returnflag, l_linenumber) AS provider, arg_min(CAST(l_partkey AS VARCHAR), l_linenumber) AS handle, arg_min(CAST(l_quantity AS BIGINT) - 40, l_linenumber) AS jobs FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_returnflag) AS r FROM lineitem) WHERE r = 1 AND CAST(l_quantity AS BIGINT) > 40 GROUP BY 1")
def handle_probes(spark, sf):
    """An order's lines as guesses in order: the first that has anything."""
    lines = fixtures.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("company"), F.col("l_linenumber").alias("guess"), F.col("l_partkey").alias("part"), "l_quantity", "l_returnflag")
    once = lines.groupBy("company", "guess").agg(F.min(F.struct("part", "l_quantity", "l_returnflag")).alias("l"))
    probes = once.select("company", "guess", F.col("l.l_returnflag").alias("provider"), F.col("l.part").cast("string").alias("handle"), (F.col("l.l_quantity").cast("long") - 40).alias("jobs"))
    return payloads.first_working_handle(probes)


# --- samples, labels, gold pools --------------------------------------------------------

_DRAW = "CAST(('0x' || substr(sha256('9::' || o_orderkey), 1, 16)) AS UBIGINT) / 1.8446744073709552e19"


@query(f"""WITH o AS (SELECT *, {_DRAW} AS u FROM orders), a AS (SELECT o_orderkey, u FROM o WHERE o_orderstatus = 'P' ORDER BY u, o_orderkey LIMIT 60),
b AS (SELECT o_orderkey, u FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY u, o_orderkey) AS r FROM o WHERE o_orderstatus <> 'P') WHERE r <= (SELECT CAST(ceil(60 / count(DISTINCT o_orderpriority)) AS INT) FROM orders))
SELECT o_orderkey FROM (SELECT * FROM a UNION SELECT * FROM b) ORDER BY u, o_orderkey LIMIT 120""")
def review_sample(spark, sf):
    """Half from one status, half by priority."""
    orders = fixtures.table(spark, sf, "orders")
    return sampling.review_sample(orders, F.col("o_orderstatus") == "P", 120, 9, "o_orderkey", "o_orderpriority").select("o_orderkey")


_TITLE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\\(.*?\\)|\\[.*?\\]', ' ', 'g'), '\\b(i|ii|iii|iv|v|vi)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_U = "CAST(('0x' || substr(sha256('42::' || id), 1, 16)) AS UBIGINT) / 1.8446744073709552e19"


@query(JOBS + f", n AS (SELECT *, {_TITLE} AS norm FROM jobs) SELECT norm, country, list_sort(list(id))[1:50] AS pool FROM n GROUP BY norm, country HAVING count(*) >= 2")
def self_join_pool(spark, sf):
    """Postings of one normalised title and country: at least two, and at most the first 50 ids, by rank."""
    rows = enriched(spark, sf).withColumn("norm", title.normalized(F.col("title")))
    return retrieval.gold_pools(rows, ["norm", "country"], "id")


@query(JOBS + f""", n AS (SELECT *, {_TITLE} AS norm, {_U} AS u FROM jobs), v AS (SELECT * FROM n WHERE norm IN (SELECT norm FROM n GROUP BY norm HAVING count(*) >= 2) ORDER BY u, id LIMIT 30),
p AS (SELECT norm, country, list_sort(list(id))[1:50] AS pool FROM n GROUP BY ALL) SELECT v.id, title AS query, pool, 'title=' || substr(v.norm, 1, 40) || ' country=' || coalesce(v.country, 'None') AS stratum FROM v JOIN p ON v.norm = p.norm AND v.country IS NOT DISTINCT FROM p.country""")
def gold_queries(spark, sf):
    """Thirty seeded postings whose title is not alone, each with its pool as what a search for it should find."""
    return retrieval.gold_queries(enriched(spark, sf).withColumn("norm", title.normalized(F.col("title"))), 30, 42, "id", "title", "norm", "country")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2 END, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 END, 0.0) AS score FROM orders")
def effective_scores(spark, sf):
    price = F.col("o_totalprice")
    legs = {"rerank_score": (2, price), "rrf_score": (3, price / 2), "dense_score": (5, F.lit(1.0))}
    rows = fixtures.table(spark, sf, "orders").withColumns({n: F.when(F.col("o_orderkey") % m == 0, v) for n, (m, v) in legs.items()})
    return rows.select("o_orderkey", retrieval.effective_score(*legs).alias("score"))


# --- features of one text, a second tier, saved models ----------------------------------


@query(JOBS + "SELECT id, seniority_extracted, role_family_extracted, min_years_experience, tech_stack FROM jobs WHERE id = (SELECT min(id) FROM jobs)")
def single_row_features(spark, sf):
    """The description of one posting, pasted: its features are those that the table has."""
    one = fixtures.jobs(spark, sf).orderBy("id").select("id", "title", "description_md").first()
    row = cascade.single_row(spark, one.description_md, one.title)
    return row.select(F.lit(one.id).alias("id"), "seniority_extracted", "role_family_extracted", "min_years_experience", "tech_stack")


_ASKED = cascade.REMOTE.sql("description_md")


@query(JOBS + f"SELECT id, 'remote_policy_extracted' AS field, CASE WHEN contains(title, 'Senior') THEN 'onsite' ELSE 'remote' END AS value, 0.62 AS confidence FROM (SELECT *, {_ASKED} AS x FROM jobs0) WHERE x IS NULL")
def second_tier_answers(spark, sf):
    """What a model, here one that looks at the title alone, says of postings whose rules found no remote policy."""

    def ask(items):
        return [{"remote_policy_extracted": "onsite" if "Senior" in heading else "remote"} for _, heading, _ in items]

    return cascade.second_tier(fixtures.jobs(spark, sf), ask, "id", ("remote_policy_extracted",))


_SAVED = ["l_quantity", "l_discount", "l_tax"]


@query("SELECT count(*) AS n, 0 AS differing FROM lineitem")
def saved_model(spark, sf):
    """A ridge model, saved and loaded: how many predictions differ."""
    lines = fixtures.table(spark, sf, "lineitem").select(*_SAVED, "l_extendedprice", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"))
    model = modelling.ridge_cv(lines, _SAVED, "l_extendedprice", "id")
    path = _folder(spark, "ridge")
    model.save(spark, path)
    again = modelling.LinearModel.load(spark, path)
    return lines.agg(F.count("*").alias("n"), F.count_if(model.column() != again.column()).alias("differing"))


_SLOPES = " UNION ALL ".join(f"SELECT '{c}' AS name, regr_slope(l_extendedprice, {c}) AS coef FROM lineitem" for c in (*_SAVED, "l_linenumber", "l_suppkey", "l_partkey"))


@query(f"SELECT name, round(abs(coef), 6) AS abs_coef, round(coef, 6) AS coef FROM ({_SLOPES}) ORDER BY abs(coef) DESC, name LIMIT 4")
def coefficient_join(spark, sf):
    """The four largest of six slopes, with their signs."""
    names = (*_SAVED, "l_linenumber", "l_suppkey", "l_partkey")
    one = fixtures.table(spark, sf, "lineitem").agg(*(F.regr_slope("l_extendedprice", c).alias(c) for c in names))
    signed = one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("coef")) for c in names))))
    return modelling.coefficients(signed, 4).select("name", F.round("abs_coef", 6).alias("abs_coef"), F.round("coef", 6).alias("coef"))


# --- questions in words -----------------------------------------------------------------


@query(JOBS + "SELECT country, count(*) AS n FROM jobs WHERE country IS NOT NULL GROUP BY 1")
def question_answered(spark, sf):
    """A question through a model that answers in a fenced block: its rows, as JSON and back."""
    said = "Here it is:\n```sql\nSELECT country, count(*) AS n FROM jobs WHERE country IS NOT NULL GROUP BY country\n```\nAnything else?"
    answer = sqlguard.ask(enriched(spark, sf).select("country", "title"), "how many postings has each country?", lambda prompt: said if "country: string" in prompt else "", ["country", "title"], seconds=600)
    if answer.error:
        raise RuntimeError(answer.error)
    return spark.createDataFrame([(r["country"], r["n"]) for r in answer.as_json()], "country string, n long")


_KINDS = "CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"


@query(f"SELECT column_name || ': ' || {_KINDS} AS line, (SELECT count(*) FROM orders) AS n FROM (SELECT column_name, CASE WHEN data_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE data_type END AS data_type FROM information_schema.columns WHERE table_name = 'orders')")
def schema_described(spark, sf):
    """The lines of the schema that a prompt shows, beside the table's size."""
    orders = fixtures.table(spark, sf, "orders")
    lines = [(line.strip(),) for line in sqlguard.describe(orders, "orders").split("\n")[1:]]
    return spark.createDataFrame(lines, "line string").join(F.broadcast(orders.agg(F.count("*").alias("n"))))


@query("SELECT count(DISTINCT doc_id) AS postings, true AS counted FROM documents WHERE trim(coalesce(text, ''), ' ') <> ''")
def index_counts(spark, sf):
    """The indexer over all documents, twice: the second run replaces what the first put in."""
    docs = fixtures.table(spark, sf, "documents").withColumn("title", F.col("lang"))
    path, embed = _folder(spark, "indexed"), retrieval.hashing_embedder(32)
    runs = [indexing.index(docs, path, embed, 32, "doc_id", "title", "text") for _ in range(2)]
    from ..sources.collection import Collection

    held = Collection(spark, path).read().agg(F.count("*").alias("n"))
    return held.select(F.lit(runs[0].postings).cast("long").alias("postings"), (F.lit(runs[0] == runs[1]) & (F.col("n") == runs[0].chunks)).alias("counted"))

