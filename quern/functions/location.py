"""Country, region, city and remote policy of a free-text location.

Every step is an expression over the row: the text is split once, and "the first
token that ..." is the head of a filtered array.  Provinces are tried before
states, token by token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let

# Codes and names of regions.
STATES = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas", "CA": "california", "CO": "colorado", "CT": "connecticut", "DE": "delaware",
    "DC": "district of columbia", "FL": "florida", "GA": "georgia", "HI": "hawaii", "ID": "idaho", "IL": "illinois", "IN": "indiana", "IA": "iowa",
    "KS": "kansas", "KY": "kentucky", "LA": "louisiana", "ME": "maine", "MD": "maryland", "MA": "massachusetts", "MI": "michigan", "MN": "minnesota",
    "MS": "mississippi", "MO": "missouri", "MT": "montana", "NE": "nebraska", "NV": "nevada", "NH": "new hampshire", "NJ": "new jersey",
    "NM": "new mexico", "NY": "new york", "NC": "north carolina", "ND": "north dakota", "OH": "ohio", "OK": "oklahoma", "OR": "oregon",
    "PA": "pennsylvania", "RI": "rhode island", "SC": "south carolina", "SD": "south dakota", "TN": "tennessee", "TX": "texas", "UT": "utah",
    "VT": "vermont", "VA": "virginia", "WA": "washington", "WV": "west virginia", "WI": "wisconsin", "WY": "wyoming",
}
PROVINCES = {
    "AB": "alberta", "BC": "british columbia", "MB": "manitoba", "NB": "new brunswick", "NL": "newfoundland and labrador", "NS": "nova scotia",
    "NT": "northwest territories", "NU": "nunavut", "ON": "ontario", "PE": "prince edward island", "QC": "quebec", "SK": "saskatchewan", "YT": "yukon",
}
PROVINCE_ALIASES = {"québec": "QC", "montréal": "QC"}
REMOTE = r"(?i)\bremote\b"
HYBRID = r"(?i)\bhybrid\b"
ONSITE = r"(?i)\b(on-?site|in[- ]office)\b"
CANADA = r"(?i)\bcanada\b"
USA = r"(?i)\b(united states|usa|u\.s\.a\.|u\.s\.)\b"
SPLIT = r"[,/|]|\s+[-–—]\s+"


def _lookup(codes: dict[str, str], more: dict[str, str] | None = None) -> dict[str, str]:
    return {code.lower(): code for code in codes} | {name: code for code, name in codes.items()} | (more or {})


PROVINCE_OF, STATE_OF = _lookup(PROVINCES, PROVINCE_ALIASES), _lookup(STATES)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def parse_location(raw: Column, default: Column | None = None) -> Column:
    """struct<country, region, city, remote_policy>."""
    default = F.lit(None).cast("string") if default is None else default
    tokens = lambda t: F.filter(F.transform(F.split(t, SPLIT), lambda x: F.btrim(x, F.lit(" -"))), lambda x: x != "")
    cut = let(F.coalesce(raw, F.lit("")), lambda t: F.struct(t.alias("text"), tokens(t).alias("tokens")))
    return let(cut, lambda c: _place(raw, c["text"], c["tokens"], default))


def _place(raw: Column, text: Column, tokens: Column, default: Column) -> Column:
    none = F.lit(None).cast("string")
    policy = F.when(text.rlike(REMOTE), "remote").when(text.rlike(HYBRID), "hybrid").when(text.rlike(ONSITE), "onsite")
    keyword = F.when(text.rlike(CANADA), "CA").when(text.rlike(USA), "US")
    country_word = lambda t: F.replace(F.upper(F.rtrim(t, F.lit("."))), F.lit("."), F.lit(""))
    named = F.get(F.filter(F.transform(tokens, lambda t: F.when(country_word(t).isin("US", "USA"), "US").when(country_word(t) == "CANADA", "CA")), lambda c: c.isNotNull()), F.lit(0))
    provinces, states = _map(PROVINCE_OF), _map(STATE_OF)
    of = lambda country, region: F.when(region.isNotNull(), F.struct(F.lit(country).alias("country"), region.alias("region")))
    region_of = lambda t: F.coalesce(of("CA", F.try_element_at(provinces, F.lower(t))), of("US", F.try_element_at(states, F.lower(t))))
    is_country = lambda t: country_word(t).isin("US", "USA", "CANADA") | t.rlike(CANADA) | t.rlike(USA)
    is_policy = lambda t: t.rlike(REMOTE) | t.rlike(HYBRID) | t.rlike(ONSITE)
    is_region = lambda t: F.map_contains_key(provinces, F.lower(t)) | F.map_contains_key(states, F.lower(t))
    city = F.get(F.filter(tokens, lambda t: ~is_country(t) & ~is_policy(t) & ~is_region(t)), F.lit(0))
    empty = raw.isNull() | (raw == "")

    def made(region: Column) -> Column:
        country = F.coalesce(region["country"], named, keyword, default)
        final = F.when((policy == "remote") & country.isin("US", "CA"), "remote-na").otherwise(policy)
        return F.struct(
            F.when(empty, default).otherwise(country).alias("country"),
            F.when(empty, none).otherwise(region["region"]).alias("region"),
            F.when(empty, none).otherwise(city).alias("city"),
            F.when(empty, none).otherwise(final).alias("remote_policy"),
        )

    return let(F.get(F.filter(F.transform(tokens, region_of), lambda r: r.isNotNull()), F.lit(0)), made)


def _sql_map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


#: DuckDB SQL over a table ``raw(id, location_raw)``.
LOCATION_SQL = f"""
SELECT id, CASE WHEN coalesce(location_raw, '') = '' THEN NULL ELSE coalesce(rc, named, keyword) END AS country,
    region, city, CASE WHEN policy = 'remote' AND coalesce(rc, named, keyword) IN ('US', 'CA') THEN 'remote-na' ELSE policy END AS remote_policy
FROM (
    SELECT *, list_filter(list_transform(tokens, lambda t: CASE WHEN replace(upper(rtrim(t, '.')), '.', '') IN ('US', 'USA') THEN 'US'
            WHEN replace(upper(rtrim(t, '.')), '.', '') = 'CANADA' THEN 'CA' END), lambda c: c IS NOT NULL)[1] AS named,
        list_filter(list_transform(tokens, lambda t: CASE WHEN p[lower(t)] IS NOT NULL THEN 'CA' WHEN s[lower(t)] IS NOT NULL THEN 'US' END), lambda c: c IS NOT NULL)[1] AS rc,
        list_filter(list_transform(tokens, lambda t: coalesce(p[lower(t)], s[lower(t)])), lambda c: c IS NOT NULL)[1] AS region,
        list_filter(tokens, lambda t: replace(upper(rtrim(t, '.')), '.', '') NOT IN ('US', 'USA', 'CANADA') AND NOT regexp_matches(t, '{CANADA}') AND NOT regexp_matches(t, '{USA}')
            AND NOT regexp_matches(t, '{REMOTE}') AND NOT regexp_matches(t, '{HYBRID}') AND NOT regexp_matches(t, '{ONSITE}')
            AND p[lower(t)] IS NULL AND s[lower(t)] IS NULL)[1] AS city
    FROM (SELECT id, location_raw, {_sql_map(PROVINCE_OF)} AS p, {_sql_map(STATE_OF)} AS s,
        CASE WHEN regexp_matches(location_raw, '{REMOTE}') THEN 'remote' WHEN regexp_matches(location_raw, '{HYBRID}') THEN 'hybrid' WHEN regexp_matches(location_raw, '{ONSITE}') THEN 'onsite' END AS policy,
        CASE WHEN regexp_matches(location_raw, '{CANADA}') THEN 'CA' WHEN regexp_matches(location_raw, '{USA}') THEN 'US' END AS keyword,
        list_filter(list_transform(string_split_regex(coalesce(location_raw, ''), '{SPLIT}'), lambda t: trim(t, ' -')), lambda t: t <> '') AS tokens
        FROM raw))
"""
