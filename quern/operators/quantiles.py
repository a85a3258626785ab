"""Exact quantiles without a buffer of values.

One pass over the rows takes a mergeable sketch a group, whose two points around each
wanted rank are a bracket that is sure to hold it.  A second pass counts what lies
below a bracket and keeps, value by value, only what lies in it; running counts inside
the bracket then name the value of the wanted rank.  The largest thing in one place
is a bracket's distinct values: at most some ``6 / ACCURACY`` of a group's rows, or
``ACCURACY`` values where a group has no more.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Ranks on either side of a wanted one, in units of the sketch's rank error (1 / accuracy).
MARGIN = 3


def _bracket_shares(q: float, accuracy: int) -> tuple[float, float]:
    return max(0.0, q - MARGIN / accuracy), min(1.0, q + MARGIN / accuracy)


def brackets(value: Column, shares: Sequence[float], accuracy: int = ACCURACY) -> Column:
    """Aggregate: (low, high) of each share's bracket in turn, as one array; null where there is no value."""
    return F.percentile_approx(value.cast("double"), [s for q in shares for s in _bracket_shares(q, accuracy)], accuracy)


def bounds(edges: Column, size: Column, i: int, q: float, accuracy: int) -> tuple[Column, Column]:
    """The i-th bracket: open at ends that the sketch is not sure of, and wholly so for no more values than the sketch holds."""
    least, most = _bracket_shares(q, accuracy)
    low = F.when(size <= accuracy, -math.inf).otherwise(F.get(edges, F.lit(2 * i))) if least > 0 else F.lit(-math.inf)
    high = F.when(size <= accuracy, math.inf).otherwise(F.get(edges, F.lit(2 * i + 1))) if most < 1 else F.lit(math.inf)
    return low, high


def _null_safe(keys: Sequence[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}"))
    return out


def aggregate(df: DataFrame, keys: Sequence[str], plain: Sequence[Column], quantiles: dict[str, tuple[str, float]], accuracy: int = ACCURACY) -> DataFrame:
    """``df.groupBy(keys).agg(plain, exact quantiles)``; ``quantiles`` maps names to (numeric column, share).

    A quantile lies between the two values around its rank in proportion, as ``percentile`` has it; nulls do not count.
    ``plain`` are aliased aggregates of the rows.  A bracket that does not hold its rank is an error, not a wrong value.
    """
    columns = list(dict.fromkeys(c for c, _ in quantiles.values()))
    shares = {c: list(dict.fromkeys(q for d, q in quantiles.values() if d == c)) for c in columns}
    wanted = [(c, q, shares[c].index(q)) for c in columns for q in shares[c]]
    sizes = [F.count(c).alias(f"_size_{c}") for c in columns]
    sketch = df.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys)).agg(*sizes, *(brackets(F.col(c), shares[c], accuracy).alias(f"_edges_{c}") for c in columns))
    wide = df.join(sketch, _null_safe(keys, "", "_key_")) if keys else df.crossJoin(F.broadcast(sketch))

    def entry(n: int, column: str, q: float, i: int) -> Column:
        value = F.col(column).cast("double")
        low, high = bounds(F.col(f"_edges_{column}"), F.col(f"_size_{column}"), i, q, accuracy)
        return F.when(value <= high, F.struct(F.lit(n).alias("n"), F.when(value >= low, value).alias("v")))

    # Every row has one entry of its own (-1); the plain aggregates are those of these and are not worked out for a bracket's
    # values: what divides may do so for all rows, but not for the few of one value.
    own = F.struct(F.lit(-1).alias("n"), F.lit(None).cast("double").alias("v"))
    entries = F.filter(F.array(own, *(entry(n, *w) for n, w in enumerate(wanted))), lambda e: e.isNotNull())
    rows = wide.withColumn("_cell", F.explode(entries)).withColumns({"_n": F.col("_cell.n"), "_v": F.col("_cell.v")})
    kept = [f"_plain_{i}" for i in range(len(plain))]
    cells = rows.groupBy(*keys, "_n", "_v").agg(F.count("*").alias("_c"), *(F.max(f"_size_{c}").alias(f"_size_{c}") for c in columns), *(F.when(F.col("_n") == -1, p).alias(n) for p, n in zip(plain, kept, strict=True)))
    # Of one group and rank: the count below the bracket first, then the bracket's values.
    order = Window.partitionBy(*keys, "_n").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.withColumn("_upto", F.sum("_c").over(order))
    found = []
    for n, (c, q, _) in enumerate(wanted):
        rank = F.lit(q) * (F.col(f"_size_{c}") - 1)
        here = F.col("_n") == n
        for name, at in (("low", F.floor(rank)), ("high", F.ceil(rank))):
            found.append(F.min(F.when(here & (F.col("_upto") > at), F.col("_v"))).alias(f"_{name}_{n}"))
        found.append(F.max(F.when(here & F.col("_v").isNull(), F.col("_c") > F.floor(rank))).alias(f"_bad_{n}"))
    one = placed.groupBy(*keys).agg(*(F.max(f"_size_{c}").alias(f"_size_{c}") for c in columns), *(F.max(k).alias(k) for k in kept), *found)

    def value(c: str, q: float) -> Column:
        n = wanted.index((c, q, shares[c].index(q)))
        rank = F.lit(q) * (F.col(f"_size_{c}") - 1)
        low, high = F.col(f"_low_{n}"), F.col(f"_high_{n}")
        between = F.when(low == high, low).otherwise((F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high)
        lost = (F.col(f"_size_{c}") > 0) & (low.isNull() | high.isNull() | F.coalesce(F.col(f"_bad_{n}"), F.lit(False)))
        return F.when(lost, F.raise_error(F.lit(f"a bracket of {c} does not hold its rank")).cast("double")).otherwise(between)

    names = df.sparkSession.createDataFrame([], df.schema).groupBy(*keys).agg(*plain).columns[len(keys) :] if plain else []
    return one.select(*keys, *(F.col(k).alias(n) for k, n in zip(kept, names, strict=True)), *(value(c, q).alias(n) for n, (c, q) in quantiles.items()))


def medians(df: DataFrame, columns: Sequence[str], prefix: str = "_med_") -> DataFrame:
    """One row of exact medians."""
    return aggregate(df.select(*columns), [], [], {f"{prefix}{c}": (c, 0.5) for c in columns})
