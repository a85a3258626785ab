"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .additive_ann import nearest
from .impact_index import build_index, search
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .neighbour_graph import near_vectors
from .oracles import ORACLE_SQL
from .ordinal_quality import fit_on, grade_of_labels, graded
from .packing import pack
from .pii import pii_report
from .quality_rules import judge_documents
from .sentencepiece_codec import round_trip_digest
from .substring_dedup import dedup_substrings
from .url_filter import fit_on as fit_urls
from .url_filter import judge_urls
from .vector_codes import compress

__all__ = ["ORACLE_SQL", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Path of the public 32k piece model on the driver."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled urls are those of pages whose document, named by number in the path, is in ``labels``."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    blocked = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = pages.select("url", F.regexp_extract("url", r"/(\d{1,18})(?=\D|$)", 1).alias("number")).where("number <> ''").withColumn("doc_id", F.col("number").cast("long"))
    labelled = labelled.join(labels.select("doc_id", blocked.alias("blocked")), "doc_id")
    return judge_urls(pages, fit_urls(labelled, "url", "blocked")).drop("block_probability")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(_table(spark, sf_dir, "documents")).drop("host", "host_rate")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return graded(docs, fit_on(docs, grade_of_labels(_table(spark, sf_dir, "labels")), 3))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digest(_table(spark, sf_dir, "documents"), piece_model())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = pii_report(_table(spark, sf_dir, "documents"))
    return report.withColumn("base_sha256", F.sha2(F.col("base").cast("binary"), 256)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op11_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(_table(spark, sf_dir, "embeddings"))


def op13_impact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_additive_ann": op8_additive_ann,
    "op9_line_dedup": op9_line_dedup,
    "op10_pii": op10_pii,
    "op11_neighbour_graph": op11_neighbour_graph,
    "op12_vector_codes": op12_vector_codes,
    "op13_impact_index": op13_impact_index,
}
