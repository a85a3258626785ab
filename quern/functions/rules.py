"""Ordered pattern rules, as Spark columns and as DuckDB SQL."""

from __future__ import annotations

import functools
import operator
import re
import re._constants as sre
from collections.abc import Callable
from dataclasses import dataclass
from re._parser import parse as sre_parse

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def unicode(pattern: str) -> str:
    """The pattern with classes and boundaries that know all letters and spaces, as the JVM takes it."""
    return "(?iU)" + pattern[4:] if pattern.startswith("(?i)") else "(?U)" + pattern


def plain(pattern: str) -> str:
    """The pattern for plain ASCII in lower case (in the text's own case, if case counts), where all classes and boundaries are the same.

    Without folding, and without tables of letters, the JVM takes a fraction of the time.
    """
    if not pattern.startswith("(?i)"):
        return pattern
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern[4:])


def is_plain(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


@dataclass(frozen=True)
class Forms:
    """A text, the same in lower case, and whether it is plain ASCII: computed once for all patterns tried on it."""

    text: Column
    low: Column
    plain: Column

    @staticmethod
    def of(made: Column) -> Forms:
        return Forms(made["text"], made["low"], made["plain"])


def forms(text: Column) -> Column:
    """struct(text, low, plain)."""
    return let(text, lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"), is_plain(t).alias("plain")))


def with_forms(text: Column | Forms, body: Callable[[Forms], Column]) -> Column:
    """body(the forms of the text)."""
    return body(text) if isinstance(text, Forms) else let(forms(text), lambda made: body(Forms.of(made)))


def _needed(parsed) -> frozenset[str] | None:
    """Strings of which every match holds one, as long as can be had; None where there are none."""
    found: list[frozenset[str]] = []
    run = ""
    for op, value in [*parsed, (None, None)]:
        if op is sre.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run]))
        run = ""
        inner: list = []
        if op is sre.SUBPATTERN:
            inner = [value[3]]
        elif op is sre.BRANCH:
            inner = value[1]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            inner = [value[2]]
        parts = [_needed(x) for x in inner]
        if parts and all(parts):
            found.append(frozenset().union(*parts))
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


@functools.cache
def needed(pattern: str) -> tuple[str, ...]:
    """Strings of which every match of the pattern holds one; none if they would be too short, or not plain letters, to tell anything."""
    strings = _needed(sre_parse(pattern.removeprefix("(?i)")))
    return tuple(sorted(strings)) if strings and min(map(len, strings)) > 1 and all(x.isascii() for x in strings) else ()


def occurs(text: Column | Forms, pattern: str) -> Column:
    """Whether the pattern occurs.  In plain ASCII the engine is asked only where a string that it needs is there."""
    if not isinstance(text, Forms):
        return with_forms(text, lambda made: occurs(made, pattern))
    strings, hay = list(needed(pattern)), text.text
    if pattern.startswith("(?i)"):
        strings, hay = [x.lower() for x in strings], text.low
    found = hay.rlike(plain(pattern))
    if strings:
        found = functools.reduce(operator.or_, (F.contains(hay, F.lit(x)) for x in strings)) & found
    return F.when(text.plain, found).otherwise(text.text.rlike(unicode(pattern)))


@dataclass(frozen=True)
class FirstMatch:
    """The value of the first rule whose pattern occurs in the text, else the default.

    Patterns are literals of their expressions, so each is compiled once.
    """

    rules: tuple[tuple[str, str], ...]
    default: str | None = None

    def column(self, text: Column | Forms) -> Column:
        if not isinstance(text, Forms):
            return with_forms(text, self.column)
        out = F.lit(self.default)
        for value, pattern in reversed(self.rules):
            out = F.when(occurs(text, pattern), F.lit(value)).otherwise(out)
        return out

    def sql(self, text: str) -> str:
        cases = " ".join(f"WHEN regexp_matches({text}, {quoted(pattern)}) THEN {quoted(value)}" for value, pattern in self.rules)
        return f"CASE {cases} ELSE {quoted(self.default) if self.default is not None else 'NULL'} END"


@dataclass(frozen=True)
class AllMatches:
    """The values of all rules whose patterns occur, in rule order; null when none does.

    ``spelled`` has DuckDB conditions, over ``{t}``, of the values whose patterns look ahead, which its engine cannot.
    """

    rules: tuple[tuple[str, str], ...]
    spelled: tuple[tuple[str, str], ...] = ()

    def column(self, text: Column | Forms) -> Column:
        if not isinstance(text, Forms):
            return with_forms(text, self.column)
        found = F.array_compact(F.array(*(F.when(occurs(text, p), F.lit(v)) for v, p in self.rules)))
        return let(found, lambda x: F.when(F.size(x) > 0, x))

    def sql(self, text: str) -> str:
        own = dict(self.spelled)
        items = ", ".join(f"CASE WHEN {own[v].format(t=text) if v in own else f'regexp_matches({text}, {quoted(p)})'} THEN {quoted(v)} END" for v, p in self.rules)
        return f"(SELECT CASE WHEN len(l) > 0 THEN l END FROM (SELECT list_filter([{items}], lambda x: x IS NOT NULL) AS l))"
