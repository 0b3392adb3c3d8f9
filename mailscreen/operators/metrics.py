"""Classification metrics.  Input: `label` 0/1, `prediction` 0/1, `spam_probability`."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16  # float64 machine epsilon, the log-loss clip
AUC_BUCKETS = 512


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def outcome_counts(df: DataFrame, prediction: Column | None = None) -> DataFrame:
    """One row: tp, fp, fn, tn."""
    predicted = F.col("prediction") if prediction is None else prediction
    actual = F.col("label")
    return df.agg(
        _count((actual == 1) & (predicted == 1)).alias("tp"),
        _count((actual == 0) & (predicted == 1)).alias("fp"),
        _count((actual == 1) & (predicted == 0)).alias("fn"),
        _count((actual == 0) & (predicted == 0)).alias("tn"),
    )


def precision_recall(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(tp * 2.0, tp * 2.0 + fp + fn),
    }


def binary_metrics(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1_score in one pass."""
    values = precision_recall(*map(F.col, ("tp", "fp", "fn", "tn")))
    return outcome_counts(df).select(*[column.alias(name) for name, column in values.items()])


def confusion_matrix(df: DataFrame) -> DataFrame:
    """All four (actual, predicted) cells, empty ones included."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    entries = F.array(
        *[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("rows")) for a, p, n in cells]
    )
    return outcome_counts(df).select(F.explode(entries).alias("c")).select("c.*")


def classification_report(df: DataFrame) -> DataFrame:
    """Long form: one row for each class, `accuracy`, `macro avg`, `weighted avg`."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    per_class = {"0": (tn, fn, fp), "1": (tp, fp, fn)}
    staged = outcome_counts(df)
    for name, (hit, wrong, missed) in per_class.items():
        staged = staged.withColumns(
            {
                f"p{name}": ratio(hit, hit + wrong),
                f"r{name}": ratio(hit, hit + missed),
                f"f{name}": ratio(hit * 2.0, hit * 2.0 + wrong + missed),
                f"s{name}": hit + missed,
            }
        )
    total = F.col("s0") + F.col("s1")

    def entry(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"),
            f1.cast("double").alias("f1_score"),
            support.cast("long").alias("support"),
        )

    def mean(kind: str) -> Column:
        return (F.col(f"{kind}0") + F.col(f"{kind}1")) / 2.0

    def weighted(kind: str) -> Column:
        return ratio(F.col(f"{kind}0") * F.col("s0") + F.col(f"{kind}1") * F.col("s1"), total)

    accuracy = ratio(tp + tn, total)
    rows = F.array(
        entry("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        entry("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        entry("accuracy", accuracy, accuracy, accuracy, total),
        entry("macro avg", mean("p"), mean("r"), mean("f"), total),
        entry("weighted avg", weighted("p"), weighted("r"), weighted("f"), total),
    )
    return staged.select(F.explode(rows).alias("e")).select("e.*")


def roc_auc(df: DataFrame, score: str = "spam_probability", buckets: int = AUC_BUCKETS) -> DataFrame:
    """One row: the exact area under the ROC curve, ties counted half; NULL for one class.

    Scores are cut into ranges at their quantiles.  Pairs within a range are counted by
    a running sum over its distinct scores, pairs across ranges from the range totals,
    so no task ever holds the whole score order.
    """
    given = F.col(score).cast("double")
    value = F.when(given.isNotNull() & ~F.isnan(given), given).otherwise(F.raise_error(F.lit(f"{score}: NULL or NaN has no place in a ranking")).cast("double"))
    rows = df.select(value.alias("s"), (F.col("label") == 1).cast("long").alias("pos"))
    fractions = [i / buckets for i in range(1, buckets)]
    points = rows.agg(F.percentile_approx("s", F.array(*map(F.lit, fractions)), F.lit(buckets * 20))).first()[0] or []
    splits = [float("-inf"), *sorted(set(points)), float("inf")]
    ranged = (
        Bucketizer(splits=splits, inputCol="s", outputCol="range").transform(rows)
        if len(splits) > 2
        else rows.withColumn("range", F.lit(0.0))
    )
    scores = ranged.groupBy("range", "s").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    higher = Window.partitionBy("range").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("pos").over(higher), F.lit(0))
    won = F.col("neg").cast("double") * (above + F.col("pos") / 2.0)
    totals = (
        scores.withColumn("won", won).groupBy("range").agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    # At most `buckets` rows from here on.
    higher_ranges = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    across = F.col("neg").cast("double") * F.coalesce(F.sum("pos").over(higher_ranges), F.lit(0))
    summed = totals.withColumn("across", across).agg(
        F.sum(F.col("won") + F.col("across")).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    pairs = F.col("pos").cast("double") * F.col("neg")
    return summed.select(F.when(pairs > 0, F.col("won") / pairs).alias("roc_auc"))


def probability_losses(df: DataFrame) -> DataFrame:
    """One row: brier_score and log_loss."""
    p = F.col("spam_probability").cast("double")
    y = F.col("label").cast("double")
    clipped = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    return df.agg(
        F.avg((p - y) * (p - y)).alias("brier_score"),
        F.avg(-F.log(F.when(F.col("label") == 1, clipped).otherwise(1.0 - clipped))).alias("log_loss"),
    )


def evaluate(df: DataFrame) -> dict:
    """All metrics as one nested dict for metadata; the frames behind it have a few rows.

    `df` is scanned several times, so hand in a written or cached table.
    """
    metrics = {name: value for name, value in binary_metrics(df).first().asDict().items()}
    cells = {(r["actual"], r["predicted"]): r["rows"] for r in confusion_matrix(df).collect()}
    metrics["confusion_matrix"] = [[cells[a, p] for p in (0, 1)] for a in (0, 1)]
    metrics["classification_report"] = {
        r["class"]: {k: r[k] for k in ("precision", "recall", "f1_score", "support")} for r in classification_report(df).collect()
    }
    metrics["roc_auc"] = roc_auc(df).first()["roc_auc"]
    metrics.update(probability_losses(df).first().asDict())
    return metrics


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The row with the highest (accuracy, f1_score); the first by `position` wins ties."""
    return candidates.orderBy(F.desc("accuracy"), F.desc("f1_score"), "position").limit(1)


def scoring_diagnostics(df: DataFrame) -> DataFrame:
    """One row: accuracy overall and per class, confidence and probability ranges, predictions."""
    right = F.col("label") == F.col("prediction")
    confidence, p = F.col("confidence"), F.col("spam_probability")
    sums = df.agg(
        F.count("*").alias("total"),
        _count(right).alias("correct"),
        _count(right & (F.col("label") == 1)).alias("spam_correct"),
        _count(F.col("label") == 1).alias("spam_total"),
        _count(right & (F.col("label") == 0)).alias("ham_correct"),
        _count(F.col("label") == 0).alias("ham_total"),
        F.avg(confidence).alias("avg_confidence"),
        F.min(confidence).alias("min_confidence"),
        F.max(confidence).alias("max_confidence"),
        F.avg(p).alias("avg_spam_probability"),
        F.min(p).alias("min_spam_probability"),
        F.max(p).alias("max_spam_probability"),
        _count(F.col("prediction") == 1).alias("predicted_spam"),
        _count(F.col("prediction") == 0).alias("predicted_ham"),
    )
    return sums.withColumns(
        {
            "accuracy": ratio(F.col("correct"), F.col("total")),
            "spam_accuracy": ratio(F.col("spam_correct"), F.col("spam_total")),
            "ham_accuracy": ratio(F.col("ham_correct"), F.col("ham_total")),
        }
    )


def health_verdict(diagnostics: DataFrame) -> DataFrame:
    """Accuracy band, low-confidence flag and prediction bias of a diagnostics row."""
    percent = F.col("accuracy") * 100
    spam_share = ratio(F.col("predicted_spam"), F.col("total"))
    return diagnostics.select(
        F.when(percent < 60, "critical").when(percent < 80, "warning").when(percent < 90, "ok").otherwise("excellent").alias("band"),
        (F.col("avg_confidence") < 0.6).alias("low_confidence"),
        F.when(spam_share > 0.7, "spam").when(spam_share < 0.3, "ham").otherwise("none").alias("bias"),
    )


def with_outcome(df: DataFrame) -> DataFrame:
    return df.withColumn("outcome", F.when(F.col("label") == F.col("prediction"), "correct").otherwise("incorrect"))


def error_examples(df: DataFrame, order: list[str], text: str = "text", n: int = 10) -> DataFrame:
    """The first `n` wrong predictions by `order`, text cut to 100 characters."""
    from mailscreen.functions.text import error_preview

    return df.filter(F.col("label") != F.col("prediction")).orderBy(*order).limit(n).withColumn(text, error_preview(text))
