"""Prediction rows and per-text explanations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.functions.probability import (
    centred_score,
    confidence,
    display_feature,
    display_number,
    ham_probability,
    label_name,
    logit_difference,
    stable_softmax,
)
from mailscreen.functions.text import served_preview
from mailscreen.operators.batch import BLANK
from mailscreen.session import plain_unions, sized

SIGNALS = "array<struct<feature:string,contribution:double,direction:string>>"


def prediction_columns(scored: DataFrame, model_name: str | None = None) -> DataFrame:
    """Fill in what follows from `spam_probability`.

    A scorer must give `spam_probability`; `prediction`, `decision_score` and
    `top_signals` are kept where it gives them and derived (or left empty) otherwise.
    """
    p = F.col("spam_probability")
    given = set(scored.columns)
    if "prediction" not in given:
        # The larger probability wins; one half is ham.
        scored = scored.withColumn("prediction", F.when(p > 0.5, 1).otherwise(0))
    if "decision_score" not in given:
        scored = scored.withColumn("decision_score", centred_score(p))
    if "top_signals" not in given:
        scored = scored.withColumn("top_signals", F.array().cast(SIGNALS))
    return scored.withColumns(
        {
            "label_id": F.col("prediction"),
            "predicted_label": label_name(F.col("prediction")),
            "ham_probability": ham_probability(p),
            "confidence": confidence(p),
            "model_name": F.lit(model_name).cast("string"),
        }
    )


def served_rows(predicted: DataFrame, keep: list[str], text: str = "text", model_source: str | None = None) -> DataFrame:
    """Rows as delivered: numbers at four decimals, preview, nested scores, and where the model is from."""
    spam, ham = display_number(F.col("spam_probability")), display_number(F.col("ham_probability"))
    return predicted.select(
        *keep,
        text,
        served_preview(text).alias("text_preview"),
        F.col("predicted_label").alias("label"),
        "label_id",
        display_number(F.col("confidence")).alias("confidence"),
        display_number(F.col("decision_score")).alias("decision_score"),
        spam.alias("spam_probability"),
        ham.alias("ham_probability"),
        F.struct(spam.alias("spam"), ham.alias("ham")).alias("scores"),
        "top_signals",
        "model_name",
        F.lit(model_source).cast("string").alias("model_source"),
    )


def with_warnings(summary: DataFrame, checked: DataFrame) -> DataFrame:
    """A batch summary with `warnings`: one line on the blank rows that `check_texts` found, if any."""
    blank = checked.agg(F.coalesce(F.sum((F.col("status") == BLANK).cast("long")), F.lit(0)).alias("_blank"))
    line = F.when(F.col("_blank") > 0, F.array(F.format_string("%d blank rows were left out.", "_blank"))).otherwise(F.array().cast("array<string>"))
    return summary.withColumn("_one", F.lit(1)).join(blank.withColumn("_one", F.lit(1)), "_one").withColumn("warnings", line).drop("_one", "_blank")


def batch_summary(rows: DataFrame, source: str, label: str = "label") -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"),
        F.sum(F.when(F.col(label) == "spam", 1).otherwise(0)).alias("spam"),
        F.sum(F.when(F.col(label) == "ham", 1).otherwise(0)).alias("ham"),
    ).select(F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("spam", F.lit(0)).alias("spam"), F.coalesce("ham", F.lit(0)).alias("ham"), F.lit(source).alias("source"))


def contributions(weights: DataFrame, coefficients: DataFrame, id_column: str) -> DataFrame:
    """(id, feature, contribution) of a linear model; zeros are left out.

    `coefficients` is (feature, coefficient), one row per feature of the model; it is
    broadcast if it is small enough.
    """
    return (
        weights.join(sized(coefficients), "feature")
        .select(id_column, "feature", (F.col("weight") * F.col("coefficient")).alias("contribution"))
        .filter(F.col("contribution") != 0)
    )


def top_signals(blocks: DataFrame | list[DataFrame], predictions: DataFrame, id_column: str, n: int = 8) -> DataFrame:
    """(id, rank, feature, contribution, direction): what speaks for the predicted class.

    The `n` strongest contributions toward the prediction, without any that point the
    other way.  With several blocks of contributions, each is cut to its own first `n`
    before they meet.
    """
    blocks = blocks if isinstance(blocks, list) else [blocks]
    plain_unions(predictions.sparkSession)
    sign = F.when(F.col("prediction") == 1, 1.0).otherwise(-1.0)
    rank = F.row_number().over(Window.partitionBy(id_column).orderBy(F.desc("_toward"), "feature"))
    called = predictions.select(id_column, "prediction")

    def strongest(parts: DataFrame) -> DataFrame:
        return parts.withColumn("rank", rank).filter(F.col("rank") <= n)

    leaders = [
        strongest(parts.join(called, id_column).withColumn("_toward", F.col("contribution") * sign).filter(F.col("_toward") > 0))
        for parts in blocks
    ]
    merged = strongest(reduce(DataFrame.unionByName, leaders)) if len(leaders) > 1 else leaders[0]
    return merged.select(
        id_column,
        "rank",
        display_feature(F.col("feature")).alias("feature"),
        F.bround(F.abs("contribution"), 6).alias("contribution"),
        F.when(F.col("contribution") > 0, "spam").otherwise("ham").alias("direction"),
    )


def signal_lists(signals: DataFrame, id_column: str) -> DataFrame:
    """(id, top_signals) with the signals of a text in rank order."""
    entry = F.struct("rank", F.struct("feature", "contribution", "direction").alias("signal"))
    ordered = F.array_sort(F.collect_list(entry))
    return signals.groupBy(id_column).agg(F.transform(ordered, lambda e: e.signal).alias("top_signals"))


POOLS = ("mean", "max", "first")
# Characters whose windows a task holds at once (one text more, if it is longer).
PORTION = 1 << 22


def token_windows(text: str, max_length: int | None, overlap: int = 0) -> list[str]:
    """Pieces of at most `max_length` tokens (runs without white space) that overlap by `overlap`.

    A text within the limit is one piece, as it is; the tokens of longer ones are joined by blanks.
    """
    tokens = text.split()
    if max_length is None or len(tokens) <= max_length:
        return [text]
    return [" ".join(tokens[at : at + max_length]) for at in range(0, len(tokens) - overlap, max_length - overlap)]


def portions(lengths: np.ndarray, most: int = PORTION) -> Iterator[slice]:
    """Rows in runs of at most `most` characters; a longer text is a run of its own."""
    start = total = 0
    for at, length in enumerate(lengths):
        if at > start and total + length > most:
            yield slice(start, at)
            start, total = at, 0
        total += length
    if len(lengths) > start:
        yield slice(start, len(lengths))


def score_with_plugin(
    df: DataFrame,
    make_predict: Callable[[], Callable[[list[str]], np.ndarray]],
    text: str = "text",
    batch_size: int = 16,
    max_length: int | None = None,
    overlap: int = 0,
    pool: str = "mean",
) -> DataFrame:
    """Score with any batch model that gives two logits (ham, spam) per text.

    `make_predict` runs once per task and returns the model function; texts reach it in
    lists of `batch_size`.  Without a `max_length` they are whole.  With one, a longer text
    is cut into windows of that many tokens; windows of all rows of a portion (`PORTION`) are
    batched by length, so short ones are not padded to long ones, and the logits of a
    text's windows are pooled: their mean, those of the window that looks most like spam
    (`max`), or those of the first window, which is what truncation gives (`first`).
    Softmax and decision score are Column expressions.
    """
    if pool not in POOLS:
        raise ValueError(f"pool must be one of {POOLS}")
    if max_length is not None and not 0 <= overlap < max_length:
        raise ValueError("windows must be longer than their overlap")
    fields = [f for f in df.schema.fields if f.name not in ("_ham", "_spam")]
    schema = T.StructType([*fields, T.StructField("_ham", T.DoubleType()), T.StructField("_spam", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for frame in (whole.iloc[rows] for whole in frames for rows in portions(whole[text].str.len().fillna(0).astype(int).to_numpy())):
            cut = [token_windows(t, max_length, overlap) for t in frame[text].fillna("")]
            if pool == "first":
                cut = [windows[:1] for windows in cut]
            owner = np.repeat(np.arange(len(cut)), [len(windows) for windows in cut])
            pieces = [piece for windows in cut for piece in windows]
            if max_length is None:
                order = np.arange(len(pieces))
            else:
                order = np.argsort([len(piece) for piece in pieces], kind="stable").astype(int)
            logits = np.empty((len(pieces), 2))
            for at in range(0, len(pieces), batch_size):
                taken = order[at : at + batch_size]
                logits[taken] = np.asarray(predict([pieces[i] for i in taken]), dtype=float)
            yield frame.assign(**dict(zip(("_ham", "_spam"), _pooled(logits, owner, len(cut), pool).T)))

    scored = df.mapInPandas(run, schema)
    probabilities = stable_softmax(F.col("_ham"), F.col("_spam"))
    return (
        scored.withColumn("spam_probability", probabilities.getField("spam"))
        .withColumn("decision_score", logit_difference(F.col("_ham"), F.col("_spam")))
        .drop("_ham", "_spam")
    )


def _pooled(logits: np.ndarray, owner: np.ndarray, rows: int, pool: str) -> np.ndarray:
    """(rows, 2) from the logits of all windows; every row has one at least."""
    if len(owner) == rows:
        return logits
    if pool == "mean":
        return np.stack([np.bincount(owner, logits[:, k], minlength=rows) / np.bincount(owner, minlength=rows) for k in (0, 1)], axis=1)
    # By row, then the largest difference first, then the window's place.
    order = np.lexsort((np.arange(len(owner)), logits[:, 0] - logits[:, 1], owner))
    return logits[order[np.searchsorted(owner[order], np.arange(rows))]]
