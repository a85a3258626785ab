"""Column expressions that name a value more than once and compute it once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnested(df: DataFrame, values: Column | str, name: str, *kept: str) -> DataFrame:
    """The columns ``kept`` with a row for each item of a list, which is computed once.

    A plain explode has its list tested by a filter of Spark's own, which computes it two times more, and does so as near to the
    scan as it gets, before rows are dealt to all tasks.
    """
    return df.select(*kept, F.posexplode_outer(values).alias("_at", name)).where("_at is not null").drop("_at")


def running_sum(values: Column) -> Column:
    """For each item, the sum of all items before it; short arrays only, as every sum is folded anew."""
    return F.transform(values, lambda _, i: F.aggregate(F.slice(values, F.lit(1), i), F.lit(0), lambda a, b: a + b))
