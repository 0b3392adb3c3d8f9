"""Writers for splits and batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscreen.functions.probability import plain_number, signals_json
from mailscreen.operators.corpus import MAIL_COLUMNS

EXPORT_COLUMNS = ("row", "text", "preview", "label", "confidence", "spam_probability", "ham_probability", "top_signals")


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so reading a split touches nothing else."""
    df.select(*MAIL_COLUMNS, "split").write.mode("overwrite").partitionBy("split").parquet(path)


def write_split_csv(df: DataFrame, path: str) -> None:
    """One CSV folder per split with the mail columns."""
    for name in ("train", "validation", "test"):
        rows = df.filter(F.col("split") == name).select(*MAIL_COLUMNS)
        _csv(rows, f"{path}/{name}", quote_all=False)


def _csv(df: DataFrame, path: str, quote_all: bool) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", quote_all)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export_rows(served: DataFrame, row: str = "row_number") -> DataFrame:
    """Served rows in the download's columns, signals as JSON text."""
    values = (
        F.col(row), F.col("text"), F.col("text_preview"), F.col("label"), F.col("confidence"),
        F.col("spam_probability"), F.col("ham_probability"), signals_json(F.col("top_signals")),
    )
    return served.select(*[value.alias(name) for name, value in zip(EXPORT_COLUMNS, values)])


def write_export(served: DataFrame, path: str, row: str = "row_number") -> None:
    """CSV with every cell quoted."""
    rows = export_rows(served, row)
    cells = [plain_number(F.col(c)) if kind == "double" else F.col(c).cast("string") for c, kind in rows.dtypes]
    _csv(rows.select(*[cell.alias(c) for c, cell in zip(EXPORT_COLUMNS, cells)]), path, quote_all=True)
