"""The queries of this folder's operators, opN_<name>, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, html_text, jaccard_join, mixing, packing, quality_model, secret_forest, spot_signatures, substring_dedup, suffix_dedup
from .common import table
from .oracles import ORACLE_SQL


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the highest grade) and kept for every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_model.rated(docs, table(spark, sf_dir, "labels")).drop("text")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_candidates, n_secrets, findings (start, end, score) and the digest of the masked text for every document."""
    found = secret_forest.scanned(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    digest = F.sha2(F.coalesce("clean_text", F.lit("")), 256)
    return found.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), "findings", digest.alias("clean_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_words(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, epoch and place of every time that a document is taken."""
    return mixing.mixed(table(spark, sf_dir, "documents", "doc_id", "source", "text")).drop("text")


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_quality_classifier,
        op3_secret_scan,
        op4_suffix_dedup,
        op5_fingerprint_index,
        op6_best_fit_packing,
        op7_jaccard_join,
        op8_temperature_mixing,
        op9_spot_signatures,
        op10_multi_index_dedup,
    )
}


__all__ = ["ORACLE_SQL", "QUERIES"]
