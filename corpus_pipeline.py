"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir), reads what its predecessor has kept as a Parquet
table, and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscreen.llm.decontaminate import find_passages
from mailscreen.llm.langid import identify, train_languages
from mailscreen.llm.near_dup import near_duplicates
from mailscreen.llm.packing import pack_documents
from mailscreen.llm.quality import judge_quality
from mailscreen.llm.registry import table
from mailscreen.session import join_summary, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the distribution divergence keep."""
    return judge_quality(docs).where("kept").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language's centroids.  The model is learnt from their labels."""
    return identify(docs, train_languages(docs)).where("NOT rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    The verdict is taken by id and text, so rows without an id and different texts under one id
    are judged apart.  Rows with the same id as well as the same text are one document, of which
    one row stays.
    """
    keep = near_duplicates(docs).where("stands").select(*_row_key(F.col("doc_id"), F.col("text_hash"))).distinct()
    rows = docs.select("*", *_row_key(F.col("doc_id"), F.xxhash64("text")))
    return rows.join(keep, ["_id", "_no_id", "_hash"], "left_semi").dropDuplicates(["_id", "_no_id", "_hash"]).select(*docs.columns)


def _row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    return [F.coalesce(doc_id, F.lit(-1)).alias("_id"), doc_id.isNull().alias("_no_id"), text_hash.alias("_hash")]


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = find_passages(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    # Rows without an id are told apart from all others, so that they can be hit as well.
    key = {"_id": F.coalesce("doc_id", F.lit(-1)), "_no_id": F.col("doc_id").isNull()}
    hit = written(found.withColumns(key).select("_id", "_no_id").distinct(), "contaminated").withColumn("_hit", F.lit(True))
    return join_summary(docs.withColumns(key), hit, ["_id", "_no_id"], "left").where("_hit IS NULL").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

# Tokens, hashes of them and language models have no counterpart in SQL; tests/llm has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
