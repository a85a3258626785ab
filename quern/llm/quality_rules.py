"""Document quality rules, and host verdicts from shrunk failure rates.

Each document is measured by DataFrame functions alone, inside its row.  Rule
failures are then counted by host; a host's failure rate is shrunk towards the
rate of all hosts with a beta prior fitted to the hosts by moments; hosts whose
shrunk rate exceeds the threshold are rejected, and the verdict is joined back.

Cost at scale.  Repeated three-word windows are found by sorting a document's
window hashes, n log n in its length, and only where a hash repeats at all.
Measures are written once, eight narrow columns a row, so texts are read once
and never shuffled.  Host counts are combined before the shuffle; the join back
is a plain equi-join that adaptive execution broadcasts by measured size or
splits where a host holds a large share of the rows.

Defined results.  A null text has no words and fails; a null host is a host of
its own.  Rows with equal or null ids are judged each on its own.  With fewer
than two hosts, or hosts that don't differ, the prior weighs as ``prior_weight``
documents.  Only id, text and host columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import SPACE_CHARS, let, words
from .scratch import materialize

SYMBOLS = "#*$%&|<>"
MAX_RATE = 0.7
PRIOR_WEIGHT = 10.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _repeat_words(hashes: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more."""

    def counted(h: Column) -> Column:
        grams = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))

        def of_grams(g: Column) -> Column:
            def of_sorted(s: Column) -> Column:
                key = lambda i: F.get(s, i)["g"]
                again = F.filter(s, lambda x, i: (x["g"] == key(i + 1)).eqNullSafe(F.lit(True)) | (x["g"] == key(i - 1)).eqNullSafe(F.lit(True)))
                places = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
                return F.size(F.array_distinct(places))

            ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(ordered, of_sorted))

        return let(grams, of_grams)

    return let(hashes, counted)


def measures(text: Column) -> dict[str, Column]:
    """The measures of one text, by name."""
    text = F.coalesce(text, F.lit(""))
    length = F.length(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    return {
        "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "hashes": F.transform(words(text), lambda w: F.xxhash64(w)),
    }


def host_rates(judged: DataFrame, host: str, failed: str, prior_weight: float = PRIOR_WEIGHT) -> DataFrame:
    """(host, n, failures, shrunk_rate): one row a host, the prior Beta(a, b) fitted over hosts by moments."""
    hosts = judged.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    # Between-host variance is what the rates vary beyond binomial noise.
    prior = hosts.agg(
        (F.sum("failures") / F.sum("n")).alias("mean"),
        F.when(F.count("*") > 1, F.var_samp(rate)).alias("var"),
        F.avg(1.0 / F.col("n")).alias("noise"),
    )
    spread = F.col("mean") * (1 - F.col("mean"))
    between = F.col("var") - spread * F.col("noise")
    weight = F.when(between > 0, F.greatest(F.lit(1.0), spread / between - 1)).otherwise(F.lit(prior_weight))
    fitted = prior.select("mean", F.coalesce(weight, F.lit(prior_weight)).alias("weight")).first()
    mean, weight = F.lit(fitted.mean or 0.0), F.lit(fitted.weight)
    return hosts.select(host, "n", "failures", ((F.col("failures") + mean * weight) / (F.col("n") + weight)).alias("shrunk_rate"))


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, host_rate)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    measured = own.select("doc_id", "host", *(v.alias(k) for k, v in measures(F.col("text")).items()))
    measured = measured.withColumn("n_words", F.size("hashes").cast("long")).withColumn("n_repeat_words", _repeat_words(F.col("hashes")).cast("long")).drop("hashes")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    judged = materialize(measured.withColumn("base_failed", failed), "measures")
    rates = host_rates(judged, "host", "base_failed").select(F.col("host").alias("rated"), F.col("shrunk_rate").alias("host_rate"))
    out = judged.join(rates, F.col("host").eqNullSafe(F.col("rated")), "left")
    kept = ~F.col("base_failed") & (F.col("host_rate") <= max_rate)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host", F.round("host_rate", 9).alias("host_rate"))
