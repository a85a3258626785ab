"""Landed job-board payloads as canonical postings: three shapes of JSON, one row a posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_to_markdown, parse_epoch_ms, parse_iso, stable_id

# Payload schemas and interval names.
GREENHOUSE = "jobs array<struct<absolute_url:string,title:string,location:struct<name:string>,content:string,first_published:string,updated_at:string,pay_input_ranges:array<struct<min_cents:bigint,max_cents:bigint,currency_type:string,interval:string>>>>"
LEVER = "struct<text:string,hostedUrl:string,applyUrl:string,categories:struct<location:string,commitment:string>,workplaceType:string,createdAt:bigint,description:string,lists:array<struct<text:string,content:string>>,additional:string,salaryRange:struct<min:double,max:double,currency:string,interval:string>>"
ASHBY = "jobs array<struct<jobUrl:string,applyUrl:string,title:string,location:string,secondaryLocations:string,isRemote:boolean,descriptionHtml:string,descriptionPlain:string,publishedDate:string,updatedAt:string,compensation:struct<compensationTiers:array<struct<components:array<struct<compensationType:string,compensationValue:struct<minValue:double,maxValue:double,currencyCode:string,interval:string>>>>>>>>"
INTERVALS = (("year", "year"), ("annual", "year"), ("month", "month"), ("day", "day"), ("hour", "hour"))


def interval(raw: Column) -> Column:
    """The period that the name holds; null for weekly and unknown ones."""
    out = F.lit(None).cast("string")
    for part, period in reversed(INTERVALS):
        out = F.when(F.lower(raw).contains(part), period).otherwise(out)
    return out


def _canonical(rows: DataFrame, source: str) -> DataFrame:
    named = rows.where("coalesce(url, '') <> '' and coalesce(title, '') <> ''")
    disclosed = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    return named.withColumns({"id": stable_id(F.col("company_slug"), F.col("url")), "source": F.lit(source), "salary_disclosed": disclosed, "raw_payload_hash": F.sha2(F.col("_raw"), 256)}).drop("_raw")


def greenhouse(payloads: DataFrame) -> DataFrame:
    """Postings from (company_slug, company_name, payload)."""
    jobs = payloads.select("company_slug", "company_name", F.explode(F.from_json("payload", GREENHOUSE)["jobs"]).alias("j"))
    pay = F.get("j.pay_input_ranges", F.lit(0))
    out = jobs.select("company_slug", "company_name", F.col("j.absolute_url").alias("url"), F.col("j.title").alias("title"), F.col("j.location.name").alias("location_raw"), html_to_markdown("j.content").alias("description_md"), (pay["min_cents"] / 100).alias("salary_min"), (pay["max_cents"] / 100).alias("salary_max"), pay["currency_type"].alias("salary_currency"), interval(pay["interval"]).alias("salary_period"), parse_iso(F.coalesce("j.first_published", "j.updated_at")).alias("posted_at"), F.to_json("j").alias("_raw"))
    return _canonical(out, "greenhouse")


def lever(payloads: DataFrame) -> DataFrame:
    jobs = payloads.select("company_slug", "company_name", F.explode(F.from_json("payload", f"array<{LEVER}>")).alias("j"))
    sections = F.transform(F.coalesce(F.col("j.lists"), F.array()), lambda s: F.concat(F.lit("## "), F.coalesce(s["text"], F.lit("")), F.lit("\n"), F.coalesce(s["content"], F.lit(""))))
    body = F.concat_ws("\n\n", F.col("j.description"), F.array_join(sections, "\n\n"), F.col("j.additional"))
    head = F.concat_ws("\n", F.concat(F.lit("Workplace: "), F.col("j.workplaceType")), F.concat(F.lit("Commitment: "), F.col("j.categories.commitment")))
    pay = F.col("j.salaryRange")
    out = jobs.select("company_slug", "company_name", F.coalesce("j.hostedUrl", "j.applyUrl").alias("url"), F.col("j.text").alias("title"), F.col("j.categories.location").alias("location_raw"), F.when(head != "", F.concat_ws("\n\n", head, html_to_markdown(body))).otherwise(html_to_markdown(body)).alias("description_md"), pay["min"].alias("salary_min"), pay["max"].alias("salary_max"), pay["currency"].alias("salary_currency"), interval(pay["interval"]).alias("salary_period"), parse_epoch_ms(F.col("j.createdAt")).alias("posted_at"), F.to_json("j").alias("_raw"))
    return _canonical(out, "lever")


def ashby(payloads: DataFrame) -> DataFrame:
    jobs = payloads.select("company_slug", "company_name", F.explode(F.from_json("payload", ASHBY)["jobs"]).alias("j"))
    components = F.get("j.compensation.compensationTiers", F.lit(0))["components"]
    salary = F.get(F.filter(components, lambda c: F.lower(c["compensationType"]) == "salary"), F.lit(0))
    pay = F.coalesce(salary, F.get(components, F.lit(0)))["compensationValue"]
    other = F.coalesce(F.get_json_object("j.secondaryLocations", "$[0].location"), F.get_json_object("j.secondaryLocations", "$[0]"))
    place = F.coalesce(F.nullif("j.location", F.lit("")), other)
    place = F.when(F.col("j.isRemote"), F.concat_ws(" – ", F.lit("Remote"), place)).otherwise(place)
    out = jobs.select("company_slug", "company_name", F.coalesce("j.jobUrl", "j.applyUrl").alias("url"), F.col("j.title").alias("title"), place.alias("location_raw"), F.when(F.col("j.descriptionHtml").isNotNull(), html_to_markdown("j.descriptionHtml")).otherwise(F.coalesce("j.descriptionPlain", F.lit(""))).alias("description_md"), pay["minValue"].alias("salary_min"), pay["maxValue"].alias("salary_max"), pay["currencyCode"].alias("salary_currency"), interval(pay["interval"]).alias("salary_period"), parse_iso(F.coalesce("j.publishedDate", "j.updatedAt")).alias("posted_at"), F.to_json("j").alias("_raw"))
    return _canonical(out, "ashby")


EXTRACTORS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby}


def extract_all(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of all known providers, and (company_slug, provider, jobs, error) of every payload; one bad payload stops nothing."""
    out = None
    for provider, extractor in EXTRACTORS.items():
        one = extractor(payloads.where(F.col("provider") == provider))
        out = one if out is None else out.unionByName(one)
    counts = out.groupBy("company_slug", F.col("source").alias("provider")).agg(F.count("*").alias("jobs"))
    known = F.col("provider").isin(*EXTRACTORS)
    readable = F.try_parse_json("payload").isNotNull()
    error = F.when(~known, "unknown provider").when(~F.coalesce(readable, F.lit(False)), "unreadable payload")
    return out, payloads.join(counts, ["company_slug", "provider"], "left").select("company_slug", "provider", F.coalesce("jobs", F.lit(0)).alias("jobs"), error.alias("error"))


def registry(spark: SparkSession, companies: list[dict]) -> DataFrame:
    """Company configuration as a table; a list that a person maintains."""
    return spark.createDataFrame([(c["slug"], c["name"], c["provider"], c["handle"], c.get("default_country")) for c in companies], "slug string, name string, provider string, handle string, default_country string")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry from a YAML file, in whatever store Spark reads: a list of companies, or one under ``companies``."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading a YAML registry needs the yaml package") from missing
    read = yaml.safe_load(spark.read.text(path, wholetext=True).first().value) or []
    return registry(spark, read["companies"] if isinstance(read, dict) else read)


def by_provider(companies: DataFrame) -> DataFrame:
    return companies.groupBy("provider").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("slug")).alias("slugs"), F.first(F.col("provider").isin(*EXTRACTORS)).alias("supported"))


def first_working_handle(probes: DataFrame) -> DataFrame:
    """Of ordered guesses (company, provider, guess, jobs), the first with a job; by provider, most jobs first."""
    best = probes.where("jobs > 0").groupBy("company").agg(F.min_by(F.struct("provider", "handle", "jobs"), "guess").alias("b"))
    return best.select("company", "b.*").orderBy("provider", F.desc("jobs"))
