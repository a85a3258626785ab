"""The table of queries that the plan modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures
from ..functions import cascade, location, title
from ..functions.rules import quoted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_YEARS = f"""list_sort(list_filter(list_transform(list_zip(regexp_extract_all(description_md, {quoted(cascade.YEARS)}, 1), regexp_extract_all(description_md, {quoted(cascade.YEARS)}, 2)),
    lambda p, i: {{'o': -((CASE WHEN CAST(p[1] AS INT) <= 25 THEN 0.85 ELSE 0.7 END) + (CASE WHEN p[2] <> '' AND TRY_CAST(p[2] AS INT) >= CAST(p[1] AS INT) AND TRY_CAST(p[2] AS INT) - CAST(p[1] AS INT) <= 15 THEN 0.05 ELSE 0 END)), 'i': i, 'lo': CAST(p[1] AS INT), 'hi': TRY_CAST(p[2] AS INT)}}),
    lambda x: x.lo BETWEEN 1 AND 30))[1]"""
_USD = "CASE WHEN salary_currency = 'USD' THEN 1.0 WHEN salary_currency = 'CAD' THEN 0.73 END * CASE coalesce(salary_period, 'year') WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'day' THEN 260 WHEN 'hour' THEN 2080 END"
#: The enriched postings of postings.enriched, as DuckDB CTEs.
JOBS = f"""
WITH jobs0 AS ({fixtures.JOBS_ORACLE}), raw AS (SELECT id, location_raw FROM jobs0), places AS ({location.LOCATION_SQL}),
jobs AS (SELECT j.*, p.country, p.region, p.city, p.remote_policy, {title.SENIORITY.sql('title')} AS seniority_extracted, {title.ROLE_FAMILY.sql('title')} AS role_family_extracted,
    salary_min * {_USD} AS salary_min_usd_yearly, salary_max * {_USD} AS salary_max_usd_yearly, {_YEARS} AS span, {_YEARS}.lo AS min_years_experience,
    {cascade.TECH_STACK.sql("title || chr(10) || description_md")} AS tech_stack
    FROM jobs0 j JOIN places p USING (id))
"""


def query(sql: str | None = None):
    """Register a function under its own name, with its DuckDB SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
