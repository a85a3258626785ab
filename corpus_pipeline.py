"""Documents to training sequences: select, clean, deduplicate, sanitise, pack.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs.  All
but the last return the columns of ``documents``.  Each stage works on all that
its predecessor kept.

Defined results.  Ids may be null or repeat: rows are judged, cleaned and sanitised
each on its own, and near copies are found among texts, so a text goes only where a
near copy of it stays.  Of rows with equal id and text one stays; of a group of near
copies, the smallest id.  Rows without id, or without words, go for what the
classifier says of them alone.  Empty tables give empty ones.  Columns beyond id and
text pass through, whatever their names; ``n_chars`` follows the text wherever a
stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.line_dedup import strip_lines
from quern.llm.minhash import keep_one_of_each
from quern.llm.ordinal_quality import fit_on, grade_of_labels, select_documents
from quern.llm.packing import pack
from quern.llm.pii import sanitise
from quern.llm.scratch import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return select_documents(docs, fit_on(docs, grade_of_labels(labels), 3))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; the documents stay."""
    return _counted(strip_lines(docs))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return keep_one_of_each(docs, shingle_words=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced or removed."""
    return _counted(sanitise(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the permitted lengths."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the fitted classifier; the tests hold the rows of each stage against plain versions on a small corpus.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
