"""Controlled vocabularies and the canonical posting schema."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, orders and constants that results depend on.
REMOTE_POLICIES = ("onsite", "hybrid", "remote", "remote-na")
SALARY_PERIODS = ("year", "month", "day", "hour")
EDUCATION_LEVELS = ("high_school", "associates", "bachelors", "masters", "phd")
CLEARANCE_LEVELS = ("public_trust", "confidential", "secret", "top_secret", "ts_sci")
SPONSORSHIP = ("yes", "no", "unspecified")
EQUITY_FORMS = ("rsu", "options", "profit_sharing", "other")
BONUS_TYPES = ("signing", "annual", "performance", "retention")
CONTRACT_TYPES = ("full_time", "part_time", "contract", "internship", "temporary")
MANAGER_ROLES = ("ic", "tech_lead", "manager", "senior_manager", "director", "exec")
POSTING_QUALITIES = ("real", "evergreen_pool", "talent_community", "reposted")
SENIORITY_LEVELS = ("intern", "junior", "mid", "senior", "staff", "principal", "manager", "director", "exec")
ROLE_FAMILIES = ("MLE", "RS", "DS", "DE", "DA", "AS", "SWE-ML", "Manager", "Other")
COUNTRIES = ("US", "CA")
CURRENCIES = ("USD", "CAD")
SOURCES = ("greenhouse", "lever", "ashby", "workable", "smartrecruiters", "workday")
FX_TO_USD = {"USD": 1.0, "CAD": 0.73}
PERIODS_PER_YEAR = {"year": 1, "month": 12, "day": 260, "hour": 2080}

_S, _D, _I, _B, _T = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
_LIST = T.ArrayType(_S)
META = T.MapType(_S, T.StructType([T.StructField("source", _S), T.StructField("confidence", _D), T.StructField("rule_id", _S)]))

JOB_SCHEMA = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("company_slug", _S),
        T.StructField("company_name", _S),
        T.StructField("title", _S),
        T.StructField("url", _S),
        T.StructField("location_raw", _S),
        T.StructField("country", _S),
        T.StructField("region", _S),
        T.StructField("city", _S),
        T.StructField("remote_policy", _S),
        T.StructField("seniority_extracted", _S),
        T.StructField("role_family_extracted", _S),
        T.StructField("salary_min", _D),
        T.StructField("salary_max", _D),
        T.StructField("salary_currency", _S),
        T.StructField("salary_period", _S),
        T.StructField("salary_min_usd_yearly", _D),
        T.StructField("salary_max_usd_yearly", _D),
        T.StructField("salary_disclosed", _B),
        T.StructField("min_years_experience", _I),
        T.StructField("max_years_experience", _I),
        T.StructField("min_education", _S),
        T.StructField("requires_security_clearance", _B),
        T.StructField("clearance_level", _S),
        T.StructField("requires_citizenship", _LIST),
        T.StructField("offers_visa_sponsorship", _S),
        T.StructField("offers_relocation", _B),
        T.StructField("offers_equity", _B),
        T.StructField("equity_form", _S),
        T.StructField("bonus_mentioned", _B),
        T.StructField("bonus_type", _S),
        T.StructField("max_travel_percent", _I),
        T.StructField("contract_type", _S),
        T.StructField("on_call_required", _B),
        T.StructField("manager_role", _S),
        T.StructField("direct_reports_count", _I),
        T.StructField("posting_quality", _S),
        T.StructField("language_requirements", _LIST),
        T.StructField("tech_stack", _LIST),
        T.StructField("industry_experience", _LIST),
        T.StructField("team_or_department", _S),
        T.StructField("extraction_meta", META),
        T.StructField("extraction_version", _S),
        T.StructField("description_md", _S),
        T.StructField("posted_at", _T),
        T.StructField("scraped_at", _T),
        T.StructField("source", _S),
        T.StructField("raw_payload_hash", _S),
    ]
)
#: Column: what its values may be.
ENUMS = {
    "country": COUNTRIES,
    "remote_policy": REMOTE_POLICIES,
    "salary_currency": CURRENCIES,
    "salary_period": SALARY_PERIODS,
    "min_education": EDUCATION_LEVELS,
    "clearance_level": CLEARANCE_LEVELS,
    "offers_visa_sponsorship": SPONSORSHIP,
    "equity_form": EQUITY_FORMS,
    "bonus_type": BONUS_TYPES,
    "contract_type": CONTRACT_TYPES,
    "manager_role": MANAGER_ROLES,
    "posting_quality": POSTING_QUALITIES,
}

# What each column is to an audit.
TARGET = "salary_max_usd_yearly"
CONTINUOUS = ("min_years_experience", "max_years_experience", "max_travel_percent", "direct_reports_count", "salary_min_usd_yearly")
ORDINAL = {
    "min_education": EDUCATION_LEVELS,
    "seniority_extracted": SENIORITY_LEVELS,
    "manager_role": MANAGER_ROLES,
    "clearance_level": CLEARANCE_LEVELS,
}
NOMINAL = (
    "country",
    "region",
    "city",
    "source",
    "role_family_extracted",
    "remote_policy",
    "contract_type",
    "equity_form",
    "bonus_type",
    "posting_quality",
    "salary_currency",
    "salary_period",
    "company_slug",
)
BOOLEAN = (
    "salary_disclosed",
    "requires_security_clearance",
    "offers_visa_sponsorship",
    "offers_relocation",
    "offers_equity",
    "bonus_mentioned",
    "on_call_required",
)
LISTS = ("requires_citizenship", "language_requirements", "tech_stack", "industry_experience")
TEXTS = ("title", "description_md", "team_or_department")
TIMES = ("posted_at", "scraped_at", "first_seen_at", "last_seen_at")
METADATA = ("id", "url", "raw_payload_hash", "extraction_meta", "extraction_version", "company_name", "location_raw", "salary_min", "salary_max", "times_seen")
ROLES = {
    "target": (TARGET,),
    "continuous": CONTINUOUS,
    "ordinal": tuple(ORDINAL),
    "nominal": NOMINAL,
    "boolean": BOOLEAN,
    "list": LISTS,
    "text": TEXTS,
    "datetime": TIMES,
    "metadata": METADATA,
}
