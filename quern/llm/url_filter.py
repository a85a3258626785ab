r"""URL verdicts: explicit rules first, then logistic regression on character n-grams.

A rule is a host suffix and a path prefix, as in ``example.com/en/7``; it fits
its host and all subdomains where the path starts with the rule's, and the
longest fitting rule wins.  Urls that no rule fits are judged by a logistic
regression on hashed 3- to 5-grams of host and path, fitted to a small labelled
table of at most ``FIT_ROWS`` urls (those with the smallest hashes).

Cost at scale.  Scoring is one pass without a shuffle; weights are 2**BITS floats,
whatever the input.  Rules are one expression in the JVM.

Defined results.  A null url, or one without ``://``, has empty host and path and
is judged as such.  Without labelled rows of both kinds, the method allows.
Repeated ids and rows are judged each on its own; only id and url are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import fold
from .hashed_text import Features, adam, char_ngrams, sigmoid

BITS = 16
FIT_ROWS = 20_000
STEPS, RATE, L2 = 80, 0.2, 1e-4
RULES: tuple[tuple[str, str], ...] = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


def host_of(url: Column) -> Column:
    return fold(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def fit(host: pa.Array, path: pa.Array, blocked: np.ndarray) -> np.ndarray | None:
    """Weights, the intercept last; None without examples of both kinds."""
    if len(blocked) == 0 or blocked.min() == blocked.max():
        return None
    x: Features = char_ngrams([host, path], 3, 5, BITS)
    y = blocked.astype(float)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        p = sigmoid(x.scores(w[:-1]) + w[-1])
        d = (p - y) / len(y)
        g = np.append(x.gradient(d, 1 << BITS), d.sum())
        g[:-1] += L2 * w[:-1]
        return 0.0, g

    return adam(loss, np.zeros((1 << BITS) + 1), STEPS, RATE)


def fit_on(labelled: DataFrame, url_col: str, blocked_col: str, rows: int = FIT_ROWS) -> np.ndarray | None:
    """Fit to a labelled table, of which at most ``rows`` rows reach the driver."""
    url = F.col(url_col)
    known = labelled.where(url.isNotNull() & F.col(blocked_col).isNotNull())
    table = known.select(url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(blocked_col).cast("int").alias("blocked")).orderBy(F.xxhash64("url"), "url", "blocked").limit(rows).toArrow()
    return fit(table["host"].combine_chunks(), table["path"].combine_chunks(), table["blocked"].to_numpy())


def _scorer(weights: np.ndarray | None):
    small = None if weights is None else weights.astype(np.float32)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                if small is None:
                    p = np.zeros(part.num_rows)
                else:
                    p = sigmoid(char_ngrams([part.column(1), part.column(2)], 3, 5, BITS).scores(small[:-1]) + small[-1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, "block_probability"])

    return run


def judge_urls(pages: DataFrame, weights: np.ndarray | None, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability), one row per row of ``pages``."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    scored = own.mapInArrow(_scorer(weights), "page_id long, host string, path string, block_probability double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "block_probability")
