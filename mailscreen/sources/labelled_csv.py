"""Labelled CSV corpora of two shapes, and the raw view of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailscreen.functions.probability import label_from_name
from mailscreen.functions.text import strip
from mailscreen.operators.corpus import finalize, whole_number
from mailscreen.operators.sampling import cap_per_group
from mailscreen.session import join_summary, seeded_hash, written

KAGGLE_SOURCE = "kaggle_venky73_spam_mails"
ENRON_SOURCE = "enron_spam_setfit"

KAGGLE_REQUIRED = ("label", "text")
KAGGLE_ROW_NAMES = ("row", "Unnamed: 0", "_c0", "")
# The columns such files have; the last four may be missing.
ENRON_COLUMNS = ("message_id", "text", "label", "label_text", "subject", "message", "date")
ENRON_REQUIRED = ENRON_COLUMNS[:3]

# Cells that count as missing in labelled CSV files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
           "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_quoted_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """CSV with header, quoted line breaks and doubled quotes; all cells as strings.

    Columns go by the names in the header, in any order; one of `required` that is missing
    is an error.  A quoted line break means a file cannot be split, so keep files of
    moderate size.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return rows


def _present(column: str) -> Column:
    return F.when(~F.col(column).isin(*MISSING), F.col(column))


def kaggle_corpus(raw: DataFrame, source: str | Column = KAGGLE_SOURCE) -> DataFrame:
    """Mail rows of the `row, label, text, label_num` shape.

    The number wins over the label text where the file has one.
    """
    name = F.lower(strip(F.coalesce(F.col("label"), F.lit(""))))
    number = F.col("label_num") if "label_num" in raw.columns else label_from_name(name)
    numbered = next((c for c in KAGGLE_ROW_NAMES if c in raw.columns), None)
    row = F.col(f"`{numbered}`") if numbered is not None else F.lit(None).cast("string")
    rows = raw.select(
        row.alias("email_id"), _present("text").alias("text"), number.cast("string").alias("label"), name.alias("label_name")
    )
    return finalize(rows, source, "email_id", "text", "label", "label_name")


def enron_corpus(raw: DataFrame, source: str | Column = ENRON_SOURCE) -> DataFrame:
    """Mail rows of the message shape: subject and text joined by a line break."""
    body = F.coalesce(_present("text"), F.lit(""))
    if "subject" in raw.columns:
        body = strip(F.concat(strip(F.coalesce(_present("subject"), F.lit(""))), F.lit("\n"), body))
    named = "label_text" in raw.columns
    rows = raw.select(
        _present("message_id").alias("email_id"), body.alias("text"), "label", *(["label_text"] if named else [])
    )
    return finalize(rows, source, "email_id", "text", "label", "label_text" if named else None)


def read_kaggle(spark: SparkSession, path: str) -> DataFrame:
    return kaggle_corpus(read_quoted_csv(spark, path, KAGGLE_REQUIRED))


def read_enron(spark: SparkSession, path: str) -> DataFrame:
    return enron_corpus(read_quoted_csv(spark, path, ENRON_REQUIRED))


def _raw_rows(raw: DataFrame, source: str, row_id: str, keep: Column, label: Column, name: Column) -> DataFrame:
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    rows = raw.select(
        F.col(row_id).alias("_row"), F.lit(source).alias("source"), label.alias("label"), name.alias("label_name"), text.alias("text"), keep.alias("_keep")
    )
    return rows.withColumn("text_length", F.length("text"))


def raw_kaggle(raw: DataFrame, row_id: str = "row") -> DataFrame:
    """Uncleaned rows; only the names spam and ham count."""
    name = F.lower(strip(F.coalesce(F.col("label"), F.lit(""))))
    return _raw_rows(raw, "kaggle_raw", row_id, name.isin("spam", "ham"), label_from_name(name), name)


def raw_enron(raw: DataFrame, row_id: str = "message_id") -> DataFrame:
    """Uncleaned rows; every whole number is a label and all but 1 are named ham."""
    label = whole_number(F.col("label"))
    return _raw_rows(raw, "enron_raw", row_id, label.isNotNull(), label, F.when(label == 1, "spam").otherwise("ham"))


def raw_corpus(sources: list[DataFrame], cap: int | None = None, seed: int = 42) -> DataFrame:
    """At most `cap` random rows per source (None: all), then the usable ones, ids `<source>_<i>`.

    The running number counts the capped rows of a source in hash order, unusable ones
    included, so it stays below `cap`.  It is a place within a range of hashes plus the
    rows of the ranges before: no task numbers a whole source.
    """
    rows = reduce(DataFrame.unionByName, sources)
    capped = cap_per_group(rows, "source", cap, ["_row"], seed).withColumn("_h", seeded_hash(seed, "_row"))
    ordered = written(capped.withColumn("_range", F.substring("_h", 1, 3)), "raw")
    sizes = ordered.groupBy("source", "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("source", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("source", "_range").orderBy("_h", "_row", F.xxhash64("text")))
    return (
        join_summary(ordered.withColumn("_place", place), offsets, ["source", "_range"])
        .withColumn("_i", F.col("_before") + F.col("_place") - 1)
        .filter(F.col("_keep") & (F.col("text") != ""))
        .select(
            F.concat("source", F.lit("_"), F.col("_i")).alias("email_id"), "source", "label", "label_name", "text", "text_length"
        )
    )
