"""Normalisation, views, rollups, search, history and quality over derived postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import cascade, location, salary, text, title
from ..functions.rules import quoted
from ..operators import history, quality, sampling, sqlguard, views
from .registry import JOBS, query

FAMILIES = ("MLE", "RS", "DS", "DE", "DA", "AS", "SWE-ML", "Manager", "Other")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with place, title labels, yearly salary, years and technologies."""
    jobs = fixtures.jobs(spark, sf_dir).withColumn("_place", location.parse_location(F.col("location_raw")))
    low, high = salary.usd_yearly(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"), F.col("salary_period"))
    both = F.concat("title", F.lit("\n"), "description_md")
    return jobs.withColumns(
        {n: F.col(f"_place.{n}") for n in ("country", "region", "city", "remote_policy")}
        | {
            "seniority_extracted": title.SENIORITY.column(F.col("title")),
            "role_family_extracted": title.ROLE_FAMILY.column(F.col("title")),
            "salary_min_usd_yearly": low,
            "salary_max_usd_yearly": high,
            "min_years_experience": cascade.years(F.col("description_md"))["lo"],
            "tech_stack": cascade.TECH_STACK.column(both),
        }
    ).drop("_place")


# --- normalisation ----------------------------------------------------------------------


@query(JOBS + "SELECT id, substr(sha256(company_slug || '|' || url), 1, 16) AS stable FROM jobs0")
def stable_id(spark, sf):
    return fixtures.jobs(spark, sf).select("id", text.stable_id(F.col("company_slug"), F.col("url")).alias("stable"))


@query()
def payload_hash(spark, sf):
    return fixtures.jobs(spark, sf).select("id", text.payload_hash(F.col("title"), F.col("url")).alias("hash"))


@query(JOBS + r"SELECT id, CASE WHEN trim(regexp_replace(title, '\s*(\([^()]*\)|\[[^\[\]]*\])\s*$', '')) = '' THEN title ELSE trim(regexp_replace(title, '\s*(\([^()]*\)|\[[^\[\]]*\])\s*$', '')) END AS clean FROM jobs0")
def title_clean(spark, sf):
    return fixtures.jobs(spark, sf).select("id", title.strip_suffix(F.col("title")).alias("clean"))


@query(JOBS + r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\(.*?\)|\[.*?\]', ' ', 'g'), '\b(i|ii|iii|iv|v|vi)\b', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM jobs0")
def title_norm(spark, sf):
    return fixtures.jobs(spark, sf).select("id", title.normalized(F.col("title")).alias("norm"))


@query(JOBS + "SELECT id, seniority_extracted FROM jobs")
def seniority_extract(spark, sf):
    return enriched(spark, sf).select("id", "seniority_extracted")


@query(JOBS + "SELECT id, role_family_extracted FROM jobs")
def role_family_extract(spark, sf):
    return enriched(spark, sf).select("id", "role_family_extracted")


@query(JOBS + "SELECT id, country, region, city, remote_policy FROM jobs")
def location_parse(spark, sf):
    return enriched(spark, sf).select("id", "country", "region", "city", "remote_policy")


@query(JOBS + "SELECT id, round(salary_min_usd_yearly, 4) AS low, round(salary_max_usd_yearly, 4) AS high FROM jobs")
def salary_usd_yearly(spark, sf):
    return enriched(spark, sf).select("id", F.round("salary_min_usd_yearly", 4).alias("low"), F.round("salary_max_usd_yearly", 4).alias("high"))


_SAYS = "contains(low, '{}')"
#: The derived texts hold one range at most, so the first match is the best one.
_MINED = f"""m0 AS (SELECT *, regexp_extract(description_md, {quoted(salary.RANGE)}, 0) AS m FROM jobs0),
m1 AS (SELECT *, strpos(description_md, m) - 1 AS s, replace(regexp_extract(m, {quoted(salary.RANGE)}, 1), ',', '')::DOUBLE AS a, replace(regexp_extract(m, {quoted(salary.RANGE)}, 2), ',', '')::DOUBLE AS b FROM m0 WHERE m <> ''),
m2 AS (SELECT *, substr(description_md, greatest(s - 100, 0) + 1, s + length(m) + 100 - greatest(s - 100, 0)) AS w, s - greatest(s - 100, 0) AS place FROM m1),
m3 AS (SELECT *, lower(w) AS low, strpos(w, regexp_extract(w, {quoted(salary.ANCHOR)}, 0)) - 1 AS anchor FROM m2 WHERE regexp_matches(w, {quoted(salary.ANCHOR)})),
m4 AS (SELECT *, CASE WHEN ({_SAYS.format('hour')} OR {_SAYS.format('/hr')} OR (NOT {_SAYS.format('/yr')} AND {_SAYS.format('/h')})) AND NOT ({_SAYS.format('annual')} OR {_SAYS.format('per year')}) THEN 'hour'
    WHEN {_SAYS.format('month')} THEN 'month' WHEN {_SAYS.format('day')} THEN 'day' WHEN greatest(a, b) < 5000 THEN 'hour' ELSE 'year' END AS period FROM m3),
m5 AS (SELECT *, CASE WHEN period = 'year' THEN 1.0 ELSE 0.7 END * (1 - least(abs(anchor - place), 100) / 200) AS score FROM m4
    WHERE greatest(a, b) BETWEEN CASE period WHEN 'year' THEN 30000 WHEN 'month' THEN 2000 WHEN 'day' THEN 200 ELSE 10 END AND CASE period WHEN 'year' THEN 1500000 WHEN 'month' THEN 100000 WHEN 'day' THEN 4000 ELSE 500 END),
mined AS (SELECT id, least(a, b) AS salary_min, greatest(a, b) AS salary_max, CASE WHEN regexp_matches(upper(w), 'CAD|CDN|C\\$|CANADIAN') THEN 'CAD' ELSE 'USD' END AS salary_currency, period AS salary_period,
    round(least(0.95, 0.7 + 0.25 * score), 3) AS confidence FROM m5)"""


@query(JOBS + f", {_MINED} SELECT j.id, m.salary_min, m.salary_max, m.salary_currency, m.salary_period, m.confidence FROM jobs0 j LEFT JOIN mined m USING (id)")
def feat_salary_mined(spark, sf):
    return fixtures.jobs(spark, sf).select("id", salary.mine_salary(F.col("description_md")).alias("m")).select("id", "m.*")


@query(JOBS + f", {_MINED} SELECT j.id, CASE WHEN NOT j.salary_disclosed AND m.salary_max IS NOT NULL THEN m.salary_max ELSE j.salary_max END AS high FROM (SELECT id, k % 4 = 0 AS salary_disclosed, salary_max FROM jobs0) j LEFT JOIN mined m USING (id)")
def salary_crossfill(spark, sf):
    """Half of the postings whose text names a range disclose nothing themselves."""
    jobs = fixtures.jobs(spark, sf).withColumn("salary_disclosed", F.col("k") % 4 == 0)
    return jobs.select("id", salary.cross_fill(F.col("salary_disclosed"), F.col("salary_max"), salary.mine_salary(F.col("description_md"))["salary_max"]).alias("high"))


@query(JOBS + f"SELECT id, CASE WHEN coalesce(remote_policy, x) = 'remote' AND country IN ('US', 'CA') THEN 'remote-na' ELSE coalesce(remote_policy, x) END AS policy FROM (SELECT *, {cascade.REMOTE.sql('description_md')} AS x FROM jobs)")
def remote_promote(spark, sf):
    policy = F.coalesce("remote_policy", cascade.REMOTE.column(F.col("description_md")))
    return enriched(spark, sf).select("id", F.when((policy == "remote") & F.col("country").isin("US", "CA"), "remote-na").otherwise(policy).alias("policy"))



_FRENCH_DOCS = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Analyste de ' || lang WHEN doc_id % 4 = 1 THEN 'Analystes' WHEN doc_id % 4 = 2 THEN lang || ' analyste' END AS title,
    CASE WHEN doc_id % 3 = 0 THEN 'QC' WHEN doc_id % 3 = 1 THEN 'ON' END AS region, CASE WHEN doc_id % 5 = 0 THEN 'Ville de Québec' WHEN doc_id % 5 = 1 THEN 'Toronto' END AS location, text FROM {docs}"""


@query(rf"""WITH d AS ({_FRENCH_DOCS.format(docs="documents")}),
-- DuckDB's boundaries know ASCII alone: words are runs of letters, digits and underscores, counted one by one.
w AS (SELECT doc_id, title, region, location, len(list_filter(regexp_extract_all(lower(substr(coalesce(text, ''), 1, {text.FRENCH_CHARS})), '[\p{{L}}\p{{M}}\p{{N}}_]+'),
    lambda x: regexp_full_match(x, '{text.FRENCH_WORDS.removeprefix("(?i)" + chr(92) + "b(").removesuffix(")" + chr(92) + "b")}'))) AS hits FROM d)
SELECT doc_id, regexp_matches(coalesce(title, ''), '(?i)^\s*analyste($|[^\p{{L}}\p{{N}}_])') OR (hits >= {text.FRENCH_HITS} AND (coalesce(region, '') = 'QC' OR contains(lower(coalesce(location, '')), 'québec'))) AS french FROM w""")
def french_filter(spark, sf):
    """By the title alone, or by five French words in a text from Quebec: a region or a place that says so."""
    docs = spark.sql(_FRENCH_DOCS, docs=fixtures.table(spark, sf, "documents"))
    return docs.select("doc_id", text.is_french(F.col("title"), F.col("text"), F.col("region"), F.col("location")).alias("french"))


_STRIP = r"regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"


@query(rf"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace({_STRIP}, '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages")
def html_strip_text(spark, sf):
    return fixtures.table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


@query()
def html_markdown(spark, sf):
    return fixtures.table(spark, sf, "pages").select("page_id", text.html_to_markdown("html").alias("markdown"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, make_timestamp(event_id * 1000000) AS at FROM events")
def json_and_epoch(spark, sf):
    return fixtures.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), text.parse_epoch_ms(F.col("event_id") * 1000).cast("timestamp_ntz").alias("at"))


@query("SELECT doc_id, lang || ' — ' || substr(coalesce(text, ''), 1, 1000) AS short, lang || ' — ' || substr(coalesce(text, ''), 1, 1500) AS long FROM documents")
def classifier_text(spark, sf):
    """Both lengths: 1,000 characters for seniority, 1,500 for role families."""
    made = lambda n: title.classifier_text(F.col("lang"), F.col("text"), n)
    return fixtures.table(spark, sf, "documents").select("doc_id", made(1000).alias("short"), made(1500).alias("long"))


@query(JOBS + "SELECT id, CASE WHEN length(d) > 280 THEN substr(d, 1, 277) || '…' ELSE d END AS snippet FROM (SELECT id, replace(description_md, chr(10), ' ') AS d FROM jobs0)")
def snippet_text(spark, sf):
    return fixtures.jobs(spark, sf).select("id", text.snippet(F.col("description_md")).alias("snippet"))


# --- scans, filters, search -------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_orders(spark, sf):
    return fixtures.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT DISTINCT o_custkey FROM orders")
def scan_pruned_ids(spark, sf):
    return fixtures.table(spark, sf, "orders").select("o_custkey").distinct()


@query(JOBS + "SELECT id, country FROM jobs WHERE country IN ('US', 'CA')")
def filter_na(spark, sf):
    return enriched(spark, sf).where(quality.in_scope(F.col("country"))).select("id", "country")


@query(JOBS + "SELECT id, salary_max FROM jobs0 WHERE salary_disclosed")
def filter_disclosed(spark, sf):
    return fixtures.jobs(spark, sf).where("salary_disclosed").select("id", "salary_max")


_QUALITY = f"CASE WHEN regexp_matches(title, {quoted(cascade.EVERGREEN)}) THEN 'evergreen_pool' WHEN regexp_matches(title, {quoted(cascade.COMMUNITY)}) THEN 'talent_community' ELSE 'real' END"


@query(JOBS + f"""SELECT unnest([0, 1, 2]) AS step, unnest(['real', 'disclosed', 'target']) AS stage, unnest([a, b, c]) AS n FROM (SELECT count(*) FILTER ({_QUALITY} = 'real') AS a,
    count(*) FILTER ({_QUALITY} = 'real' AND salary_disclosed) AS b, count(*) FILTER ({_QUALITY} = 'real' AND salary_disclosed AND salary_max_usd_yearly >= 30000) AS c FROM jobs)""")
def filter_funnel(spark, sf):
    kind = cascade.posting_quality(F.col("title"))
    return views.filter_funnel(enriched(spark, sf), [("real", kind == "real"), ("disclosed", F.col("salary_disclosed")), ("target", F.col("salary_max_usd_yearly") >= 30000)])


@query(JOBS + "SELECT id, round(least(salary_max_usd_yearly, (SELECT quantile_cont(salary_max_usd_yearly, 0.995) FROM jobs WHERE salary_disclosed)), 4) AS capped FROM jobs WHERE salary_disclosed")
def winsorize(spark, sf):
    return views.winsorized(enriched(spark, sf).where("salary_disclosed"), "salary_max_usd_yearly").select("id", F.round("salary_max_usd_yearly", 4).alias("capped"))


@query(JOBS + "SELECT id, title, posted_at FROM jobs WHERE contains(lower(title), 'data') OR contains(lower(company_name), 'data') ORDER BY posted_at DESC NULLS LAST, id LIMIT 50")
def search_keyword(spark, sf):
    return views.search(enriched(spark, sf), "Data").select("id", "title", "posted_at")


@query(JOBS + "SELECT id FROM jobs WHERE country IN ('US') AND role_family_extracted IN ('DS', 'DE') AND salary_max_usd_yearly >= 100000 AND posted_at >= TIMESTAMP '1996-01-01'")
def search_filters(spark, sf):
    return enriched(spark, sf).where(views.retrieval_filter(["US"], [], ["DS", "DE"], salary_gte=100000, posted_from="1996-01-01")).select("id")


@query(JOBS + "SELECT country, count(*) AS n FROM jobs GROUP BY country ORDER BY country LIMIT 1000")
def sqlguard_execute(spark, sf):
    return sqlguard.execute(enriched(spark, sf), "SELECT country, count(*) AS n FROM jobs GROUP BY country ORDER BY country;", ["country", "title"])


# --- views and rollups ------------------------------------------------------------------


#: Means of hundredths over 32 rows end in a 5 at the seventh place; this sends such ties up, whatever order sums were made in.
_TIE = 1e-9


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(f.name) + _TIE, 6).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields))


_DISC = "CAST(sum(CASE WHEN salary_disclosed THEN 1 END) AS BIGINT) AS n_disclosed, round(avg(salary_max_usd_yearly) + 1e-9, 6) AS avg_max"
_Q = "round(quantile_cont(salary_max_usd_yearly, {}) + 1e-9, 6)"


@query(JOBS + f"SELECT country, count(*) AS n_jobs, {_DISC}, {_Q.format(0.5)} AS p50_max, {_Q.format(0.75)} AS p75_max FROM jobs GROUP BY country")
def view_by_country(spark, sf):
    return rounded(views.by_country(enriched(spark, sf)))


@query(JOBS + "SELECT source, count(*) AS n_jobs, round(avg(CAST(salary_disclosed AS INT)) + 1e-9, 6) AS disclosure_rate, round(avg(salary_max_usd_yearly) + 1e-9, 6) AS avg_max FROM jobs GROUP BY source")
def view_by_source(spark, sf):
    return rounded(views.by_source(enriched(spark, sf)))


@query(JOBS + f"SELECT role_family_extracted, count(*) AS n_jobs, round(avg(salary_max_usd_yearly) + 1e-9, 6) AS avg_max, {_Q.format(0.5)} AS median_max, round(avg(min_years_experience) + 1e-9, 6) AS avg_years FROM jobs GROUP BY ALL")
def view_by_role_family(spark, sf):
    return rounded(views.by_role_family(enriched(spark, sf)))


@query(JOBS + f"SELECT seniority_extracted, count(*) AS n_jobs, {_Q.format(0.25)} AS p25_max, {_Q.format(0.5)} AS p50_max, {_Q.format(0.75)} AS p75_max FROM jobs WHERE salary_disclosed GROUP BY ALL")
def view_by_seniority(spark, sf):
    return rounded(views.by_seniority(enriched(spark, sf)))


@query(JOBS + f"SELECT company_slug, company_name, source, count(*) AS n_jobs, {_DISC} FROM jobs GROUP BY ALL")
def view_by_company(spark, sf):
    return rounded(views.by_company(enriched(spark, sf)))


@query(JOBS + "SELECT coalesce(remote_policy, '<unknown>') AS remote_policy, count(*) AS n_jobs FROM jobs GROUP BY 1")
def view_remote_mix(spark, sf):
    return views.remote_mix(enriched(spark, sf))


@query(JOBS + f"SELECT role_family_extracted AS role_family, seniority_extracted AS seniority, count(salary_max_usd_yearly) AS n, {_Q.format(0.25)} AS p25, {_Q.format(0.5)} AS p50, {_Q.format(0.75)} AS p75 FROM jobs GROUP BY ALL")
def salary_distribution(spark, sf):
    return rounded(views.salary_distribution(enriched(spark, sf), "role_family_extracted", "seniority_extracted", "salary_max_usd_yearly"))


_COUNTS = ", ".join(f"count(*) FILTER (role_family_extracted = '{f}') AS \"{f}\"" for f in FAMILIES)


@query(JOBS + f"SELECT company_name, {_COUNTS}, count(role_family_extracted) AS total FROM jobs WHERE company_name IN (SELECT company_name FROM jobs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) GROUP BY 1")
def top_companies_pivot(spark, sf):
    return views.top_companies(enriched(spark, sf), "role_family_extracted", FAMILIES, 10)


@query(JOBS + "SELECT country, role_family_extracted AS role_family, count(*) AS n, round(count(*) * 100 / any_value(t.total), 1) AS share FROM jobs JOIN (SELECT country AS c, count(*) AS total FROM jobs GROUP BY 1) t ON country = c GROUP BY ALL")
def role_share(spark, sf):
    return views.role_share(enriched(spark, sf), "role_family_extracted")


@query(JOBS + "SELECT skill, count(*) AS n FROM (SELECT unnest(tech_stack) AS skill FROM jobs) GROUP BY 1 ORDER BY n DESC, skill LIMIT 10")
def top_skills(spark, sf):
    return views.top_values(enriched(spark, sf), "tech_stack", 10)


@query(JOBS + "SELECT count(*) AS n_jobs, count(DISTINCT company_slug) AS n_companies, round(median(CASE WHEN salary_disclosed THEN salary_max_usd_yearly END) + 1e-9, 6) AS median_max, round(median(predicted_salary_usd_v1) + 1e-9, 6) AS median_predicted, round(avg(CAST(salary_disclosed AS INT)), 3) AS disclosure_rate FROM jobs")
def headline(spark, sf):
    return rounded(views.headline(enriched(spark, sf)))


_FILL = ("country", "region", "salary_max", "posted_at")


@query(JOBS + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(count({c}) / count(*), 4) AS fill_rate, count(DISTINCT {c}) AS n_distinct FROM jobs" for c in _FILL))
def schema_audit(spark, sf):
    return views.fill_rates(enriched(spark, sf), list(_FILL))


@query(JOBS + "SELECT coalesce(city, '<missing>') AS value, count(*) AS n FROM jobs GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def value_counts_top(spark, sf):
    return views.value_counts(enriched(spark, sf), "city")


# --- history and quality ----------------------------------------------------------------

_SNAPS = JOBS + f", snaps AS ({fixtures.SNAPSHOTS_ORACLE})"


def _snaps(spark, sf):
    return history.union_snapshots(fixtures.snapshots(spark, sf))


@query(_SNAPS + "SELECT id, snapshot_date, description_md IS NULL AS no_text, count(*) AS n FROM snaps GROUP BY ALL")
def union_by_name(spark, sf):
    return _snaps(spark, sf).groupBy("id", "snapshot_date", F.col("description_md").isNull().alias("no_text")).agg(F.count("*").alias("n"))


@query(_SNAPS + "SELECT id, min(snapshot_date) AS first_seen_at, max(snapshot_date) AS last_seen_at, count(*) AS times_seen FROM snaps GROUP BY id")
def history_keys(spark, sf):
    return history.history_keys(_snaps(spark, sf))


@query(_SNAPS + "SELECT s.id, s.snapshot_date, k.first_seen_at, k.times_seen FROM snaps s JOIN (SELECT id, min(snapshot_date) AS first_seen_at, count(*) AS times_seen FROM snaps GROUP BY id) k USING (id) WHERE snapshot_date = (SELECT max(snapshot_date) FROM snaps)")
def curated_active(spark, sf):
    return history.active(_snaps(spark, sf)).select("id", "snapshot_date", "first_seen_at", "times_seen")


@query(_SNAPS + "SELECT id, title, snapshot_date, times_seen FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY snapshot_date DESC) AS n, count(*) OVER (PARTITION BY id) AS times_seen FROM snaps) WHERE n = 1")
def curated_history(spark, sf):
    return history.history(_snaps(spark, sf)).select("id", "title", "snapshot_date", "times_seen")


@query(_SNAPS + "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'delisted' ELSE 'continuing' END AS state FROM (SELECT DISTINCT id FROM snaps WHERE snapshot_date = DATE '2026-05-22') a FULL JOIN (SELECT DISTINCT id FROM snaps WHERE snapshot_date = DATE '2026-05-15') b ON a.id = b.id")
def full_diff_snapshots(spark, sf):
    parts = fixtures.snapshots(spark, sf)
    return quality.id_diff(parts[3], parts[2])


_ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


@query(f"SELECT key, l_partkey, l_extendedprice FROM (SELECT *, l_orderkey * 100 + l_linenumber AS key, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ROW}, l_discount, l_tax) AS n FROM lineitem) WHERE n = 1")
def dedup_first(spark, sf):
    rows = fixtures.table(spark, sf, "lineitem").withColumn("key", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return quality.first_per_key(rows, "key", *_ROW.split(", "), "l_discount", "l_tax").select("key", "l_partkey", "l_extendedprice")


_CHECKED = "CASE WHEN k % 89 = 0 THEN 'short' ELSE id END AS id, company_slug, CASE WHEN k % 71 = 0 THEN ' ' ELSE title END AS title, CASE WHEN k % 61 = 0 THEN 'ftp://x' ELSE url END AS url, CASE WHEN k % 53 = 0 THEN 'other' ELSE source END AS source, CASE WHEN k % 47 = 0 THEN 'week' ELSE salary_period END AS salary_period"


def _checked(spark, sf):
    return quality.violations(spark.sql(f"SELECT {_CHECKED} FROM {{jobs}}", jobs=fixtures.jobs(spark, sf)))


_RULES = "SELECT id, list_filter([CASE WHEN length(id) <> 16 THEN 'id_length' END, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'id_unique' END, CASE WHEN trim(company_slug) = '' THEN 'slug_empty' END, CASE WHEN trim(title) = '' THEN 'title_empty' END, CASE WHEN NOT starts_with(url, 'http') THEN 'url_scheme' END, CASE WHEN source NOT IN ('greenhouse', 'lever', 'ashby', 'workable', 'smartrecruiters', 'workday') THEN 'source_known' END, CASE WHEN salary_period IS NOT NULL AND salary_period NOT IN ('year', 'month', 'day', 'hour') THEN 'salary_period_enum' END], lambda x: x IS NOT NULL) AS violations"


@query(JOBS + f"{_RULES} FROM (SELECT {_CHECKED} FROM jobs0)")
def quality_violations(spark, sf):
    return _checked(spark, sf).select("id", "violations")


@query(JOBS + f"SELECT rule, count(*) AS rows FROM (SELECT unnest(violations) AS rule FROM ({_RULES} FROM (SELECT {_CHECKED} FROM jobs0))) GROUP BY 1")
def quality_report(spark, sf):
    return quality.violation_report(_checked(spark, sf))


@query(JOBS + "SELECT id, title, salary_max, CAST(NULL AS VARCHAR) AS city, salary_disclosed FROM jobs0")
def coerce_types(spark, sf):
    return quality.coerce(fixtures.jobs(spark, sf).withColumn("salary_max", F.col("salary_max").cast("string"))).select("id", "title", "salary_max", "city", "salary_disclosed")


@query(JOBS + "SELECT count(*) AS n_raw, count(*) FILTER (k % 97 = 0) AS n_duplicate, count(*) FILTER (k % 97 <> 0 AND coalesce(country, '') NOT IN ('US', 'CA')) AS n_foreign, 0 AS n_french, count(*) FILTER (k % 97 <> 0 AND coalesce(country, '') IN ('US', 'CA')) AS n_kept FROM jobs")
def ingest_counters(spark, sf):
    return quality.ingest_counters(enriched(spark, sf), F.col("k") % 97 == 0, ~quality.in_scope(F.col("country")), F.lit(False))


# --- splits and samples -----------------------------------------------------------------

_U = "CAST(('0x' || substr(sha256('{}::' || id), 1, 16)) AS UHUGEINT)::DOUBLE / 1.8446744073709552e19"


@query(JOBS + f"SELECT id, {_U.format(42)} < 0.2 AS is_test FROM jobs0")
def hash_split(spark, sf):
    return fixtures.jobs(spark, sf).select("id", sampling.is_test(42, F.col("id")).alias("is_test"))


@query(JOBS + f"SELECT country, source, count(*) AS n, count(*) FILTER ({_U.format(42)} < 0.2) AS n_test, count(*) - count(*) FILTER ({_U.format(42)} < 0.2) AS n_train, round(count(*) FILTER ({_U.format(42)} < 0.2) / count(*), 4) AS test_ratio FROM jobs GROUP BY ALL")
def split_strata(spark, sf):
    return sampling.strata_counts(enriched(spark, sf), sampling.is_test(42, F.col("id")), "country", "source")


@query(JOBS + f"SELECT id FROM jobs0 ORDER BY {_U.format(7)}, id LIMIT 100")
def sample_hash_n(spark, sf):
    return sampling.sample_n(fixtures.jobs(spark, sf), 100, 7, "id").select("id")


@query(JOBS + f"SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY {_U.format(7)}, id) AS n FROM jobs0) WHERE n <= 20")
def sample_quota(spark, sf):
    return sampling.quota(fixtures.jobs(spark, sf), 20, 7, "id", "source").select("id", "source")


@query(JOBS + f"SELECT id, CAST((row_number() OVER (PARTITION BY source ORDER BY {_U.format(7)}, id) - 1) % 5 AS BIGINT) AS fold FROM jobs0")
def kfold_assign(spark, sf):
    return sampling.folds(fixtures.jobs(spark, sf), 5, 7, "id", "source").select("id", "fold")


@query(JOBS + f"SELECT id, CASE WHEN {_U.format(3)} < 0.5 THEN 'reference' ELSE 'current' END AS half FROM jobs0")
def drift_halves(spark, sf):
    return sampling.halves(fixtures.jobs(spark, sf), 3, "id").select("id", "half")


