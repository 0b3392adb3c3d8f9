"""Checks on batches of texts that come in for scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscreen.functions.text import squeeze
from mailscreen.session import computed

# Status and error codes.
OK, BLANK, TOO_LARGE = "ok", "blank", "text_too_large"
EMPTY_BATCH, BATCH_TOO_LARGE = "empty_batch", "batch_too_large"


class BatchRejected(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def check_texts(df: DataFrame, text: str = "text", max_length: int | None = None) -> DataFrame:
    """Squeeze white space and add `status`: ok, blank or, with a `max_length`, text_too_large."""
    others = [c for c in df.columns if c != text]
    raw = df.select(*others, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    squeezed = computed(raw, **{text: squeeze("_text")}).select(*[F.col(c) for c in df.columns])
    length = F.length(text)
    status = F.when(length == 0, BLANK)
    if max_length is not None:
        status = status.when(length > max_length, TOO_LARGE)
    return squeezed.withColumn("status", status.otherwise(OK))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("status") == OK).drop("status")


def rejected(checked: DataFrame) -> DataFrame:
    """Rows set aside instead of failing the job; blank rows are not among them."""
    return checked.filter(F.col("status") == TOO_LARGE)


def batch_status(checked: DataFrame, max_rows: int | None = None) -> DataFrame:
    """One row: counts, and the code a whole-batch check would end with."""
    counts = checked.agg(
        F.count("*").alias("rows"),
        *[
            F.coalesce(F.sum(F.when(F.col("status") == code, 1).otherwise(0)), F.lit(0)).alias(name)
            for code, name in ((OK, "accepted"), (BLANK, "blank"), (TOO_LARGE, "too_large"))
        ],
    )
    code = F.when(F.col("too_large") > 0, TOO_LARGE).when(F.col("accepted") == 0, EMPTY_BATCH)
    if max_rows is not None:
        code = code.when(F.col("accepted") > max_rows, BATCH_TOO_LARGE)
    return counts.withColumn("code", code.otherwise(OK))


def validate(checked: DataFrame, mode: str = "quarantine", max_rows: int | None = None) -> DataFrame:
    """The rows to score.  `strict` raises BatchRejected where a request would be refused."""
    if mode == "strict":
        code = batch_status(checked, max_rows).first()["code"]
        if code != OK:
            raise BatchRejected(code)
    elif mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    return accepted(checked)
