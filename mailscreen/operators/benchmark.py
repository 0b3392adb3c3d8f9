"""False positives on ham-only sources, threshold sweep, recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscreen.config import HAM
from mailscreen.functions.probability import display_number
from mailscreen.functions.text import report_preview
from mailscreen.operators.metrics import precision_recall, ratio

FOLDER_PREFIX = "spamassassin_"
THRESHOLDS = (0.50, 0.60, 0.70, 0.80, 0.90, 0.95)

# Decisions and the false-positive rates that lead to them.
AUGMENT, TUNE, KEEP = "augment_ham_data_and_retrain", "tune_threshold_then_retest", "keep_current_model"
STRICT_THRESHOLD, STRICT_LIMIT = 0.95, 0.20
BASE_THRESHOLD, BASE_LIMIT = 0.50, 0.10


def dataset_sources(folders: list[str] | tuple[str, ...], prefix: str = FOLDER_PREFIX) -> list[str]:
    return [f"{prefix}{name}" for name in folders]


def heldout_ham(df: DataFrame, sources: list[str]) -> DataFrame:
    """Ham rows of the configured sources; sources without rows simply do not show up."""
    return df.filter(F.col("source").isin(list(sources)) & (F.col("label") == HAM))


def benchmark_mode(counts: DataFrame, sources: list[str]) -> DataFrame:
    """`counts` is (source, ...) of the training corpus; one row with the mode."""
    inside = F.max(F.col("source").isin(list(sources)))
    return counts.agg(
        F.when(F.coalesce(inside, F.lit(False)), "heldout_test_sources").otherwise("external_corpora").alias("mode")
    )


def _fpr_columns() -> list[Column]:
    flagged = F.col("prediction") == 1
    return [
        F.count("*").alias("samples"),
        F.sum(F.when(F.col("prediction") == 0, 1).otherwise(0)).alias("predicted_ham"),
        F.sum(F.when(flagged, 1).otherwise(0)).alias("predicted_spam"),
        F.avg(flagged.cast("double")).alias("false_positive_rate"),
        F.avg("spam_probability").alias("avg_spam_probability"),
    ]


def ham_by_source(ham: DataFrame) -> DataFrame:
    return ham.groupBy("source").agg(*_fpr_columns())


def ham_with_total(ham: DataFrame) -> DataFrame:
    """Per-source rows plus the row-weighted total over all sources (`is_total` = 1)."""
    return ham.rollup("source").agg(F.grouping("source").cast("int").alias("is_total"), *_fpr_columns())


def threshold_sweep(scored: DataFrame, is_test: Column, is_ham: Column, thresholds=THRESHOLDS) -> DataFrame:
    """Test metrics and the all-ham false-positive rate at every threshold.

    `is_test` and `is_ham` tell which rows belong to the test split and to the ham
    benchmark; a row may be in both.  Every threshold is a set of conditional sums in
    one aggregation, so rows are neither copied nor joined.
    """
    p, label = F.col("spam_probability"), F.col("label")

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))

    sums = [count(is_test & (label == 1)).alias("pos"), count(is_test & (label == 0)).alias("neg"), count(is_ham).alias("ham")]
    for i, t in enumerate(thresholds):
        sums += [
            count(is_test & (label == 1) & (p >= t)).alias(f"tp{i}"),
            count(is_test & (label == 0) & (p >= t)).alias(f"fp{i}"),
            count(is_ham & (p >= t)).alias(f"hit{i}"),
        ]
    entries = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"hit{i}").alias("hit"))
        for i, t in enumerate(thresholds)
    ]
    rows = scored.agg(*sums).select("pos", "neg", "ham", F.explode(F.array(*entries)).alias("e")).select("pos", "neg", "ham", "e.*")
    values = precision_recall(F.col("tp"), F.col("fp"), F.col("pos") - F.col("tp"), F.col("neg") - F.col("fp"))
    return rows.select(
        "threshold",
        values["accuracy"].alias("test_accuracy"),
        values["precision"].alias("test_precision"),
        values["recall"].alias("test_recall"),
        values["f1_score"].alias("test_f1"),
        ratio(F.col("hit"), F.col("ham")).alias("all_ham_fpr"),
    )


def sweep_by_source(ham: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(source, threshold, false_positive_rate) in long form."""
    p = F.col("spam_probability")
    rates = [F.avg((p >= t).cast("double")).alias(f"r{i}") for i, t in enumerate(thresholds)]
    entries = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"r{i}").alias("false_positive_rate")) for i, t in enumerate(thresholds)]
    return ham.groupBy("source").agg(*rates).select("source", F.explode(F.array(*entries)).alias("e")).select("source", "e.*")


def recommend(sweep: DataFrame) -> DataFrame:
    """One row with the decision the sweep leads to."""

    def rate_at(threshold: float) -> Column:
        return F.max(F.when(F.abs(F.col("threshold") - threshold) < 1e-9, F.col("all_ham_fpr")))

    rates = sweep.agg(rate_at(STRICT_THRESHOLD).alias("strict_fpr"), rate_at(BASE_THRESHOLD).alias("base_fpr"))
    decision = F.when(F.col("strict_fpr") > STRICT_LIMIT, AUGMENT).when(F.col("base_fpr") > BASE_LIMIT, TUNE).otherwise(KEEP)
    return rates.select(decision.alias("decision"), "base_fpr", "strict_fpr")


def top_false_positives(ham: DataFrame, order: list[str], n: int = 5, text: str = "text") -> DataFrame:
    """The `n` ham rows of each source that look most like spam.

    Ranked within salted parts of a source first, then within the source, so a source
    with a third of all rows is not ranked by one task.
    """
    flagged = ham.filter(F.col("prediction") == 1).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    by_rank = [F.desc("spam_probability"), *order]
    part = F.row_number().over(Window.partitionBy("source", "_salt").orderBy(*by_rank))
    whole = F.row_number().over(Window.partitionBy("source").orderBy(*by_rank))
    leaders = flagged.withColumn("_part", part).filter(F.col("_part") <= n)
    return (
        leaders.withColumn("rank", whole)
        .filter(F.col("rank") <= n)
        .select("source", "rank", display_number(F.col("spam_probability")).alias("spam_probability"), report_preview(text).alias("preview"))
    )
