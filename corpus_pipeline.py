"""Stages that turn raw documents into packed training sequences.

Each stage reads what the one before it kept and returns the columns of documents, the last one packed pieces.
Between stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import jaccard_join, mixing, packing, quality_model, secret_forest
from tesserine.llm.common import as_rows, stash, table, unstash


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null and empty texts are judged by their statistics; repeated rows alike; all columns go on, whatever their names.
    """
    return quality_model.kept_rows(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the n-gram Jaccard join.

    Rows repeated under one doc_id are one document; documents without words and those without a doc_id all stay; all columns
    go on, whatever their names.
    """
    groups = jaccard_join.join_components(docs)
    kept = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times")).select(F.col("doc_id").alias("id"), "times")
    rows = as_rows(docs)
    out = rows.join(kept.hint("merge"), F.col("row.doc_id") == F.col("id"))
    once = out.where("times = 1").select("row")
    again = out.where("times > 1").groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return once.union(again).union(rows.where("row.doc_id is null")).select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; n_chars follows the text.

    Null and empty texts stay as they are; repeated rows are masked alike; all columns go on, whatever their names.
    """
    found = secret_forest.scanned_rows(docs)
    n_chars = F.when(F.size("findings") > 0, F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    own = {"text": F.col("clean_text"), "n_chars": n_chars}
    return found.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources up to twice, as the temperature asks.

    Null sources are one source; repeated rows are taken together; all columns go on, whatever their names.
    """
    return mixing.taken_rows(docs).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences.

    Null and empty texts are one piece of the end id; repeated rows are packed as often as they come.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", reject_poor),
    ("near_duplicates", one_of_each),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL cannot express the trained models, the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name)
            if i:
                unstash(before)
    return docs
