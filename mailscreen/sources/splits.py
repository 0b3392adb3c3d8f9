"""The written corpus: parquet partitioned by split, or CSV per split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.operators.corpus import MAIL_SCHEMA

SPLITS = ("train", "validation", "test")


def read_splits(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Mail rows with `split`; naming splits reads only their folders."""
    schema = T.StructType([*MAIL_SCHEMA.fields, T.StructField("split", T.StringType())])
    rows = spark.read.schema(schema).parquet(path)
    return rows.filter(F.col("split").isin(*names)) if names else rows


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """Mail rows of one split kept as CSV."""
    return (
        spark.read.schema(MAIL_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        .fillna("", ["text", "email_id"])
    )
