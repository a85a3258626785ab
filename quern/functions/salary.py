"""Yearly salaries in US dollars, and salary ranges mined from text."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FX_TO_USD, PERIODS_PER_YEAR
from .lets import let, running_sum
from .rules import plain, unicode, with_forms

# Patterns, words, bands and weights of the salary miner.
NUMBER = r"\d{1,3}(?:[,.]?\d{3})*(?:\.\d{1,2})?(?:\s?[KkMm]\b)?"
BEFORE = r"(?:\$\s?(?:USD|CAD|US|CDN)?\s?|USD\s?\$?\s?|CAD\s?\$?\s?|US\$\s?|CA\$\s?|C\$\s?)"
AFTER = r"(?:\s?(?:USD|CAD|US|CDN|US\s?dollars?|Canadian\s?dollars?))?"
BETWEEN = r"\s*(?:[-–—]|to|–|—)\s*"
RANGE = rf"(?i){BEFORE}({NUMBER}){AFTER}{BETWEEN}(?:{BEFORE})?({NUMBER}){AFTER}"
ANCHOR = (
    r"(?i)\b(?:salary|compensation|pay\s+range|base\s+pay|base\s+salary|annual\s+(?:base|salary|pay)|target\s+(?:earnings|pay)"
    r"|expected\s+(?:salary|compensation)|wage|hourly\s+rate|range\s+is)\b"
)
CANADIAN = ("CAD", "CDN", "C$", "CA$", "CANADIAN")
BANDS = {"year": (30_000, 1_500_000), "month": (2_000, 100_000), "day": (200, 4_000), "hour": (10, 500)}
WINDOW, HOURLY_BELOW = 100, 5_000


def usd_yearly(low: Column, high: Column, currency: Column, period: Column) -> tuple[Column, Column]:
    """Both ends in US dollars a year; nulls if both are null, or currency or period is unknown."""
    rate = F.lit(None).cast("double")
    for name, value in FX_TO_USD.items():
        rate = F.when(currency == name, F.lit(value)).otherwise(rate)
    times = F.lit(None).cast("int")
    for name, value in PERIODS_PER_YEAR.items():
        times = F.when(F.coalesce(period, F.lit("year")) == name, F.lit(value)).otherwise(times)
    return low * rate * times, high * rate * times


def parse_amount(text: Column) -> Column:
    """A number with commas and an optional k or M suffix; null if it is none."""
    bare = F.lower(F.regexp_replace(text, r"[,\s]", ""))
    factor = F.when(bare.endswith("k"), 1e3).when(bare.endswith("m"), 1e6).otherwise(1.0)
    return F.regexp_replace(bare, "[km]$", "").try_cast("double") * factor


def _period(window: Column, high: Column) -> Column:
    """What the words near a range say of its period; a value too small for a year is an hour's."""
    low = F.lower(window)
    says = lambda *words: functools.reduce(operator.or_, (F.contains(low, F.lit(w)) for w in words))
    hourly = says("hour", "/hr") | (~says("/yr") & says("/h"))
    return F.when(hourly & ~says("annual", "per year"), "hour").when(says("month"), "month").when(says("day"), "day").when(high < HOURLY_BELOW, "hour").otherwise("year")


def _plausible(period: Column, value: Column) -> Column:
    out = F.lit(False)
    for name, (low, high) in BANDS.items():
        out = out | ((period == name) & value.between(low, high))
    return out


def _ranges(text: Column, written: Callable[[str], str]) -> Column:
    """Structs (low, high, start, end) of all ranges of a text that are two numbers, in order."""
    pattern = F.lit(written(RANGE))
    every = lambda g: F.regexp_extract_all(text, pattern, F.lit(g))

    def placed(pieces: Column) -> Column:
        def of_ranges(found: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m["0"]))

            def at_starts(starts: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    a, b = parse_amount(m["1"]), parse_amount(m["2"])
                    start = F.get(starts, i) + F.length(F.get(pieces, i))
                    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), (a.isNotNull() & b.isNotNull()).alias("whole"), start.alias("start"), (start + F.length(m["0"])).alias("end"))

                return F.filter(F.transform(found, one), lambda m: m["whole"])

            return let(let(steps, running_sum), at_starts)

        return let(F.arrays_zip(every(0).alias("0"), every(1).alias("1"), every(2).alias("2")), of_ranges)

    return let(F.split(text, pattern, -1), placed)


def mine_salary(text: Column) -> Column:
    """struct(salary_min, salary_max, salary_currency, salary_period, confidence) of the best anchored range, or null.

    Ranges nearer to their anchor score higher, and years above other periods; the earliest of equal scores counts.
    """
    # Every range has one of these before it.
    there = lambda t: functools.reduce(operator.or_, (F.contains(t.low, F.lit(w)) for w in ("$", "usd", "cad")))
    of = lambda t: F.when(t.plain, F.when(there(t), _mined(t.low, plain))).otherwise(_mined(t.text, unicode))
    return with_forms(text, of)


def _mined(text: Column, written: Callable[[str], str]) -> Column:
    def with_window(m: Column) -> Column:
        begin = F.greatest(F.lit(0), m["start"] - WINDOW)
        window = F.substring(text, begin + 1, m["end"] + WINDOW - begin)
        return let(window, lambda w: F.struct(m.alias("m"), w.alias("window"), F.regexp_instr(w, F.lit(written(ANCHOR))).alias("anchor"), _period(w, m["high"]).alias("period"), (m["start"] - begin).alias("at")))

    def scored(x: Column, i: Column) -> Column:
        far = F.least(F.abs(x["anchor"] - 1 - x["at"]), F.lit(100))
        score = F.when(x["period"] == "year", 1.0).otherwise(0.7) * (1 - far / 200)
        upper = F.upper(x["window"])
        canadian = functools.reduce(operator.or_, (F.contains(upper, F.lit(w)) for w in CANADIAN))
        mined = F.struct(
            x["m"]["low"].alias("salary_min"),
            x["m"]["high"].alias("salary_max"),
            F.when(canadian, "CAD").otherwise("USD").alias("salary_currency"),
            x["period"].alias("salary_period"),
            F.round(F.least(F.lit(0.95), 0.7 + 0.25 * score), 3).alias("confidence"),
        )
        return F.struct(score.alias("score"), (-i).alias("order"), mined.alias("mined"))

    usable = lambda x: (x["anchor"] > 0) & _plausible(x["period"], x["m"]["high"])
    best = F.array_max(F.transform(F.filter(F.transform(_ranges(text, written), with_window), usable), scored))
    return F.when(text.rlike(written(RANGE)), best["mined"])


def cross_fill(disclosed: Column, listed: Column, mined: Column) -> Column:
    """A mined value counts only where no structured one is disclosed."""
    return F.when(~F.coalesce(disclosed, F.lit(False)) & mined.isNotNull(), mined).otherwise(listed)
