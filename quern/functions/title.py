"""Seniority, role family and clean forms of a posting's title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import FirstMatch

# Label and pattern, in order; the first that occurs counts.
SENIORITY = FirstMatch(
    (
        ("intern", r"(?i)\b(intern|co-?op|stagiaire)\b"),
        ("junior", r"(?i)\b(junior|jr\.?|associate|entry[- ]level|new grad|graduate|grad)\b"),
        ("staff", r"(?i)\b(staff)\b"),
        ("principal", r"(?i)\b(principal|distinguished|fellow)\b"),
        ("director", r"(?i)\b(director|head of|vp|vice[- ]president)\b"),
        ("manager", r"(?i)\b(manager|mgr\.?|lead)\b"),
        ("senior", r"(?i)\b(senior|sr\.?|sénior)\b"),
    ),
    default="mid",
)
ROLE_FAMILY = FirstMatch(
    (
        ("MLE", r"(?i)\b(machine learning engineer|ml engineer|mle\b|deep learning engineer)\b"),
        ("RS", r"(?i)\b(research scientist|research engineer|applied scientist)\b"),
        ("DS", r"(?i)\b(data scientist|ml scientist|quant(itative)?)\b"),
        ("DE", r"(?i)\b(data engineer|analytics engineer|etl engineer)\b"),
        ("DA", r"(?i)\b(data analyst|business analyst|product analyst|bi analyst)\b"),
        ("AS", r"(?i)\b(analytics scientist|growth scientist|decision scientist)\b"),
        ("SWE-ML", r"(?i)\b(ai engineer|ml platform|llm engineer|gen[- ]?ai engineer)\b"),
        ("Manager", r"(?i)\b(manager|director|head of|vp of)\b"),
    ),
    default="Other",
)


def strip_suffix(title: Column) -> Column:
    """The title without one trailing (...) or [...]; itself if nothing would be left."""
    cut = F.regexp_replace(title, r"\s*(\([^()]*\)|\[[^\[\]]*\])\s*$", "")
    return F.coalesce(F.nullif(F.trim(cut), F.lit("")), title)


def normalized(title: Column) -> Column:
    """Lower case, without bracketed spans and roman numerals i to vi, single spaces."""
    bare = F.regexp_replace(F.lower(title), r"\(.*?\)|\[.*?\]", " ")
    bare = F.regexp_replace(bare, r"\b(i|ii|iii|iv|v|vi)\b", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def classifier_text(title: Column, description: Column, chars: int) -> Column:
    """Title, an em dash, and the first characters of the description."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" — "), F.substring(F.coalesce(description, F.lit("")), 1, chars))
