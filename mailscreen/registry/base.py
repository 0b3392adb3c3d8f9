"""Registration, and the frames that several queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscreen.functions.probability import confidence
from mailscreen.functions.stats import with_email_stats
from mailscreen.operators.corpus import finalize
from mailscreen.session import plain_unions, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Sources that stand in for the held-out ham folders.
HAM_SOURCES = ["src1", "src2", "src3"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# Tables with texts and the column that names a row; they are dealt out when small.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    plain_unions(spark)
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows, TEXT_TABLES[name]) if name in TEXT_TABLES else rows


def labelled(spark: SparkSession, folder: str, how: str = "inner") -> DataFrame:
    """documents with the `toxic` label; the labels cover some of them."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id", how)


def mail(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled documents as mail rows, plus doc_id."""
    return finalize(labelled(spark, folder), F.col("source"), "doc_id", "text", "toxic", extra=("doc_id",))


def rule_scores(df: DataFrame, text: str = "text", digits: int | None = 6, logit: str | None = None) -> DataFrame:
    """A fixed scoring rule, so that everything behind a score has an exact answer.

    Not a product model.  Keeps all columns.  `digits=None` leaves the score unrounded,
    for queries that round it again; `logit` names a column for the score's logit.
    """
    keep = df.columns
    used = ("uppercase_ratio", "digit_ratio", "exclamation_count", "currency_count")
    stats = with_email_stats(df.withColumn("_text", F.col(text)), "_text", keep, used)
    length = F.greatest(F.length(text), F.lit(1))
    z = (
        F.lit(-3.0)
        + F.col("uppercase_ratio") * 30.0
        + F.col("digit_ratio") * 20.0
        + F.col("exclamation_count") * 0.05
        + F.col("currency_count") * 40.0 / length
    )
    p = 1.0 / (1.0 + F.exp(-z))
    extra = [z.alias(logit)] if logit else []
    return stats.select(*keep, (p if digits is None else F.round(p, digits)).alias("spam_probability"), *extra)


def scored_mail(spark: SparkSession, folder: str, digits: int | None = 6) -> DataFrame:
    """Mail rows with spam_probability, prediction and confidence."""
    p = F.col("spam_probability")
    return rule_scores(mail(spark, folder), digits=digits).withColumns(
        {"prediction": F.when(p > 0.5, 1).otherwise(0), "confidence": confidence(p)}
    )


def six(*columns: str) -> list[Column]:
    """Columns rounded to six decimals for comparison across engines."""
    return [F.round(F.col(c).cast("double"), 6).alias(c) for c in columns]
