"""The text cascade, one query an extractor, and its counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import cascade, salary
from ..functions.rules import FirstMatch, quoted
from ..operators import views
from .registry import _YEARS, JOBS, query

_T = "description_md"


def _fields(spark, sf):
    jobs = fixtures.jobs(spark, sf)
    return jobs, cascade.extract(F.col(_T), F.col("title"))


def _values(spark, sf, *names):
    jobs, fields = _fields(spark, sf)
    return jobs.select("id", *(fields[n]["value"].alias(n) for n in names))


@query(JOBS + f"SELECT id, CAST(span.lo AS INT) AS min_years_experience, CAST(span.hi AS INT) AS max_years_experience FROM (SELECT id, {_YEARS} AS span FROM jobs0)")
def feat_years(spark, sf):
    return _values(spark, sf, "min_years_experience", "max_years_experience")


_PREF = f"(contains(lower({_T}), 'preferred') AND NOT contains(lower({_T}), 'required'))"
_EDU = " ".join(f"WHEN regexp_matches({_T}, {quoted(p)}){f' AND NOT {_PREF}' if t in ('phd', 'masters') else ''} THEN '{t}'" for t, p in cascade.EDUCATION)


@query(JOBS + f"SELECT id, coalesce(CASE {_EDU} END, {FirstMatch(cascade.EDUCATION).sql(_T)}) AS min_education FROM jobs0")
def feat_education(spark, sf):
    return _values(spark, sf, "min_education")


_HELD = f"""(SELECT *, CASE WHEN whole <> '' AND NOT regexp_matches(substr({_T}, greatest(pos - 80, 1), pos + length(whole) + 30 - greatest(pos - 80, 1)), {quoted(cascade.CLEARANCE_VETO)})
        THEN replace(regexp_replace(lower(regexp_extract({_T}, {quoted(cascade.CLEARANCE)}, 1)), '\\s+', ' ', 'g'), ' / ', '/') END AS held
    FROM (SELECT *, strpos({_T}, whole) AS pos FROM (SELECT *, regexp_extract({_T}, {quoted(cascade.CLEARANCE)}, 0) AS whole FROM jobs0)))"""


@query(JOBS + f"SELECT id, CASE WHEN held IS NOT NULL THEN true END AS requires_security_clearance, {cascade.CLEARANCE_LEVEL.sql('held')} AS clearance_level FROM {_HELD}")
def feat_clearance(spark, sf):
    return _values(spark, sf, "requires_security_clearance", "clearance_level")


@query(JOBS + f"SELECT id, {cascade.CITIZENSHIP.sql(_T)} AS requires_citizenship FROM jobs0")
def feat_citizenship(spark, sf):
    return _values(spark, sf, "requires_citizenship")


@query(JOBS + f"SELECT id, {cascade.VISA.sql(_T)} AS offers_visa_sponsorship FROM jobs0")
def feat_visa(spark, sf):
    return _values(spark, sf, "offers_visa_sponsorship")


@query(JOBS + f"SELECT id, {cascade.REMOTE.sql(_T)} AS remote_policy_extracted FROM jobs0")
def feat_remote(spark, sf):
    return _values(spark, sf, "remote_policy_extracted")


@query(JOBS + f"SELECT id, CAST({cascade.ON_CALL.sql(_T)} AS BOOLEAN) AS on_call_required FROM jobs0")
def feat_oncall(spark, sf):
    return _values(spark, sf, "on_call_required")


_PCT = "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract({_T}, {quoted(cascade.TRAVEL)}, {g}), '') AS INT)" for g in (1, 2, 3)) + ")"


@query(JOBS + f"SELECT id, CAST(CASE WHEN regexp_matches({_T}, {quoted(cascade.NO_TRAVEL)}) THEN 0 WHEN {_PCT} BETWEEN 0 AND 100 THEN {_PCT} END AS INT) AS max_travel_percent FROM jobs0")
def feat_travel(spark, sf):
    return _values(spark, sf, "max_travel_percent")


@query(JOBS + f"SELECT id, CASE WHEN e THEN true END AS offers_equity, CASE WHEN e THEN {cascade.EQUITY_FORM.sql(_T)} END AS equity_form FROM (SELECT *, regexp_matches({_T}, {quoted(cascade.HAS_EQUITY)}) AS e FROM jobs0)")
def feat_equity(spark, sf):
    return _values(spark, sf, "offers_equity", "equity_form")


@query(JOBS + f"SELECT id, CASE WHEN b THEN true END AS bonus_mentioned, CASE WHEN b THEN {cascade.BONUS_KIND.sql(_T)} END AS bonus_type FROM (SELECT *, regexp_matches({_T}, {quoted(cascade.BONUS)}) AS b FROM jobs0)")
def feat_bonus(spark, sf):
    return _values(spark, sf, "bonus_mentioned", "bonus_type")


@query(JOBS + f"SELECT id, CAST({cascade.RELOCATION.sql(_T)} AS BOOLEAN) AS offers_relocation FROM jobs0")
def feat_relocation(spark, sf):
    return _values(spark, sf, "offers_relocation")


@query(JOBS + f"SELECT id, {cascade.CONTRACT.sql(f'title || chr(10) || {_T}')} AS contract_type FROM jobs0")
def feat_contract(spark, sf):
    return _values(spark, sf, "contract_type")


@query(JOBS + f"SELECT id, CASE WHEN regexp_matches(title, {quoted(cascade.EVERGREEN)}) THEN 'evergreen_pool' WHEN regexp_matches(title, {quoted(cascade.COMMUNITY)}) THEN 'talent_community' ELSE 'real' END AS posting_quality FROM jobs0")
def feat_quality(spark, sf):
    return _values(spark, sf, "posting_quality")


@query(JOBS + f"SELECT id, {cascade.LANGUAGES.sql(_T)} AS language_requirements FROM jobs0")
def feat_languages(spark, sf):
    return _values(spark, sf, "language_requirements")


@query(JOBS + f"SELECT id, {cascade.MANAGER.sql('title')} AS manager_role FROM jobs0")
def feat_manager(spark, sf):
    return _values(spark, sf, "manager_role")


@query(JOBS + f"SELECT id, CASE WHEN n BETWEEN 1 AND 200 THEN n END AS direct_reports_count FROM (SELECT id, TRY_CAST(nullif(regexp_extract({_T}, {quoted(cascade.REPORTS)}, 1), '') AS INT) AS n FROM jobs0)")
def feat_reports(spark, sf):
    return _values(spark, sf, "direct_reports_count")


@query(JOBS + "SELECT id, tech_stack FROM jobs")
def feat_tech(spark, sf):
    both = F.concat("title", F.lit("\n"), _T)
    return fixtures.jobs(spark, sf).select("id", cascade.TECH_STACK.column(both).alias("tech_stack"))


@query("SELECT o_orderkey, round(o_totalprice, 0) * 1000 AS v FROM orders")
def feat_number_parse(spark, sf):
    written = F.concat(F.format_number(F.round("o_totalprice", 0), 0), F.lit("k"))
    return fixtures.table(spark, sf, "orders").select("o_orderkey", salary.parse_amount(written).alias("v"))


#: Every field as DuckDB SQL over jobs0: what the single queries above compare, side by side.
_BOTH = f"title || chr(10) || {_T}"
_SQL = {
    "min_years_experience": "span.lo",
    "max_years_experience": "span.hi",
    "min_education": f"coalesce(CASE {_EDU} END, {FirstMatch(cascade.EDUCATION).sql(_T)})",
    "requires_security_clearance": "held",
    "clearance_level": cascade.CLEARANCE_LEVEL.sql("held"),
    "requires_citizenship": cascade.CITIZENSHIP.sql(_T),
    "offers_visa_sponsorship": cascade.VISA.sql(_T),
    "remote_policy_extracted": cascade.REMOTE.sql(_T),
    "on_call_required": cascade.ON_CALL.sql(_T),
    "max_travel_percent": f"CASE WHEN regexp_matches({_T}, {quoted(cascade.NO_TRAVEL)}) THEN 0 WHEN {_PCT} BETWEEN 0 AND 100 THEN {_PCT} END",
    "offers_equity": f"CASE WHEN regexp_matches({_T}, {quoted(cascade.HAS_EQUITY)}) THEN 1 END",
    "equity_form": f"CASE WHEN regexp_matches({_T}, {quoted(cascade.HAS_EQUITY)}) THEN {cascade.EQUITY_FORM.sql(_T)} END",
    "bonus_mentioned": f"CASE WHEN regexp_matches({_T}, {quoted(cascade.BONUS)}) THEN 1 END",
    "bonus_type": f"CASE WHEN regexp_matches({_T}, {quoted(cascade.BONUS)}) THEN {cascade.BONUS_KIND.sql(_T)} END",
    "offers_relocation": cascade.RELOCATION.sql(_T),
    "contract_type": cascade.CONTRACT.sql(_BOTH),
    "posting_quality": "1",
    "language_requirements": cascade.LANGUAGES.sql(_T),
    "manager_role": cascade.MANAGER.sql("title"),
    "direct_reports_count": f"CASE WHEN TRY_CAST(nullif(regexp_extract({_T}, {quoted(cascade.REPORTS)}, 1), '') AS INT) BETWEEN 1 AND 200 THEN 1 END",
    "tech_stack": cascade.TECH_STACK.sql(_BOTH),
}
_FOUND = f"(SELECT id, {', '.join(f'({sql}) IS NOT NULL AS {name}' for name, sql in _SQL.items())} FROM (SELECT *, {_YEARS} AS span FROM {_HELD}))"
_NAMES = ", ".join(f"'{name}'" for name in _SQL)


@query(JOBS + f"SELECT field, 'regex' AS source, n FROM (SELECT unnest([{_NAMES}]) AS field, unnest([{', '.join(f'count(*) FILTER ({name})' for name in _SQL)}]) AS n FROM {_FOUND}) WHERE n > 0")
def cascade_meta_counts(spark, sf):
    return cascade.provenance_counts(fixtures.jobs(spark, sf))


@query()
def cascade_full(spark, sf):
    done = cascade.with_features(fixtures.jobs(spark, sf))
    return done.select("id", "min_education", "contract_type", "tech_stack", "extraction_meta", "extraction_version")


@query(JOBS + f"SELECT unnest([{_NAMES}]) AS \"column\", unnest([{', '.join(f'round(100.0 * count(*) FILTER ({name}) / count(*), 1)' for name in _SQL)}]) AS hit_pct FROM {_FOUND}")
def cascade_hit_rates(spark, sf):
    staged = cascade.with_found(fixtures.jobs(spark, sf)).select(*(F.col(f"_f_{name}.value").alias(name) for name in cascade.FIELDS))
    return views.hit_rates(staged, list(cascade.FIELDS))


#: posting_quality is always found, at 0.6 unless its title says more, which is not below the bound.
@query(JOBS + f"SELECT id, list_filter([{', '.join(f"CASE WHEN NOT {name} THEN '{name}' END" for name in _SQL)}], lambda x: x IS NOT NULL) AS missing FROM {_FOUND}")
def cascade_missing_gate(spark, sf):
    staged = cascade.with_found(fixtures.jobs(spark, sf))
    return staged.select("id", cascade.missing_for_model({name: F.col(f"_f_{name}") for name in cascade.FIELDS}, cascade.FIELDS).alias("missing"))
