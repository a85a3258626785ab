"""Small text functions: ids, dates, HTML, money, snippets, language."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import unicode

# Words of the French test.
FRENCH_TITLE = (
    r"(?i)^\s*(ingénieur(e)?|développeur(euse)?|programmeur(euse)?|analyste|spécialiste|conseiller(ère)?|stagiaire|adjoint(e)?|chef"
    r"|responsable|technicien(ne)?|gestionnaire|directeur(rice)?|architecte|scientifique des données)\b"
)
FRENCH_WORDS = r"(?i)\b(nous|avec|notre|leur|cette|votre|pour|dans|qui|sont|aux?|des|été|être|équipe|développ|expérience|exigences|responsabilités)\b"
FRENCH_CHARS, FRENCH_HITS = 800, 5


def stable_id(slug: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", slug, url), 256), 1, 16)


def payload_hash(*fields: Column) -> Column:
    """Hash of the fields as one JSON object."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def parse_iso(text: Column) -> Column:
    """ISO-8601 in UTC unless it names an offset; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "[zZ]$", "+00:00"))


def parse_epoch_ms(value: Column) -> Column:
    return F.timestamp_millis(value.try_cast("bigint"))


def is_french(title: Column, text: Column, region: Column, location: Column) -> Column:
    hits = F.regexp_count(F.substring(F.coalesce(text, F.lit("")), 1, FRENCH_CHARS), F.lit(unicode(FRENCH_WORDS)))
    there = (F.coalesce(region, F.lit("")) == "QC") | F.lower(F.coalesce(location, F.lit(""))).contains("québec")
    return F.coalesce(title, F.lit("")).rlike(unicode(FRENCH_TITLE)) | ((hits >= FRENCH_HITS) & there)


def strip_html(page: Column) -> Column:
    """Text of a page: no script, style or tags, the five basic entities, single spaces."""
    text = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("p", "div", "ul", "ol", "section", "article"):
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def markdown_of(page: str | None) -> str:
    """Markdown of one page; entities are unescaped before it is parsed, as boards escape twice."""
    parser = _Markdown()
    parser.feed(html.unescape(page or ""))
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(parser.out)).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(page: pd.Series) -> pd.Series:
    return page.map(markdown_of)


def money(value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit("$"), F.format_number(value, 0))).otherwise("—")


def snippet(text: Column, limit: int = 280) -> Column:
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("…"))).otherwise(flat)


def clean_list(values: Column) -> Column:
    """No nulls and blanks; null becomes an empty list."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))


def map_skills(skills: Column, taxonomy: dict[str, str]) -> Column:
    """Canonical names: exact key, else the first key that the skill starts with as a word; each once, in order."""
    clean = lambda s: F.rtrim(F.regexp_replace(F.lower(F.trim(s)), r"\s+", " "), F.lit("."))
    table = F.create_map(*(F.lit(x) for kv in taxonomy.items() for x in kv))
    keys = F.array(*(F.lit(k) for k in taxonomy))

    def one(s: Column) -> Column:
        prefix = F.get(F.filter(keys, lambda k: F.startswith(clean(s), F.concat(k, F.lit(" ")))), F.lit(0))
        return F.coalesce(F.try_element_at(table, clean(s)), F.try_element_at(table, prefix))

    return F.array_distinct(F.array_compact(F.transform(clean_list(skills), one)))


def override(value: Column, base: Column) -> Column:
    """A non-empty override wins."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), base)
