"""Scoring of files as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from mailscreen.operators.batch import BLANK, OK, check_texts
from mailscreen.plans.model import ScreeningModel, TextFeatures
from mailscreen.session import plain_unions


def stream_files(spark: SparkSession, folder: str, schema: StructType, file_format: str = "json", max_files: int = 1000) -> DataFrame:
    """New files in `folder`, at most `max_files` per micro-batch."""
    return (
        spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", max_files).load(folder)
    )


def score_stream(
    texts: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    text: str = "text",
    max_length: int | None = None,
    continuous: bool = False,
) -> StreamingQuery:
    """Check, score and write to `output/batch=<n>`, one folder per micro-batch.

    The scorer gets each micro-batch as an ordinary table, so a fitted model serves as well
    as a Column rule.  A batch that is run again after a failure overwrites its own folder.
    Blank rows are dropped; with a `max_length`, longer rows are written unscored, with
    their status.
    """

    def score(rows: DataFrame, number: int) -> None:
        plain_unions(rows.sparkSession)
        checked = check_texts(rows, text, max_length).filter(F.col("status") != BLANK)
        scored = scorer(checked)
        added = [c for c in scored.columns if c not in checked.columns]
        scored = scored.withColumns({c: F.when(F.col("status") == OK, F.col(c)) for c in added})
        scored.write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = texts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(score)
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def append_scores(
    texts: DataFrame,
    model: ScreeningModel,
    output: str,
    checkpoint: str,
    id_column: str,
    text: str = "text",
    signals: int = 0,
    max_length: int | None = None,
    continuous: bool = False,
) -> StreamingQuery:
    """Check and score with a fitted model, and append to Spark's file sink at `output`.

    One streaming plan without state: a row is scored by itself.  The sink's log makes every
    row appear exactly once, whatever is run again after a failure, and readers see whole
    micro-batches only.  Blank rows are dropped; with a `max_length`, longer rows are written
    unscored, with their status.
    """
    if isinstance(model.features, TextFeatures) and (model.features.encoder() is None or (signals and model.features.names() is None)):
        raise ValueError("the vocabulary is too large to score rows one by one; use score_stream")
    checked = check_texts(texts, text, max_length).filter(F.col("status") != BLANK)
    scored = model.score(checked, id_column, text, signals)
    added = [c for c in scored.columns if c not in checked.columns]
    scored = scored.withColumns({c: F.when(F.col("status") == OK, F.col(c)) for c in added})
    writer = scored.writeStream.format("parquet").outputMode("append").option("path", output).option("checkpointLocation", checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start()
