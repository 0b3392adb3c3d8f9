"""Markdown reports and the model-info extract, as one-row DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen.functions.probability import display_number
from mailscreen.operators.benchmark import AUGMENT, TUNE

# Fixed values: (metric read, metric shown); the first that is present wins from the right.
METRIC_NAMES = (("accuracy", "accuracy"), ("precision", "precision"), ("recall", "recall"), ("f1", "f1"),
                ("f1_score", "f1"), ("roc_auc", "roc_auc"), ("auc", "roc_auc"))
COUNT_NAMES = ("tp", "tn", "fp", "fn", "support")


def _four(value: Column) -> Column:
    return F.format_string("%.4f", F.coalesce(value.cast("double"), F.lit(0.0)))


def _percent(value: Column) -> Column:
    return F.format_string("%.2f%%", value.cast("double") * 100)


def _lines(*parts: str | Column) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def metrics_markdown(title: str, metrics: DataFrame) -> DataFrame:
    """`metrics` is one row: accuracy .. f1_score, roc_auc, brier_score, log_loss (may be
    NULL), tp, fp, fn, tn.  One row, column `report`."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))

    def triple(hit: Column, wrong: Column, missed: Column) -> Column:
        def share(top: Column, bottom: Column) -> Column:
            return _four(F.when(bottom > 0, top / bottom))

        return F.concat_ws(" / ", share(hit, hit + wrong), share(hit, hit + missed), share(hit * 2, hit * 2 + wrong + missed))

    optional = [
        F.when(F.col(name).isNotNull(), F.concat(F.lit(f"- {shown}: "), _four(F.col(name))))
        for name, shown in (("roc_auc", "ROC AUC"), ("brier_score", "Brier Score"), ("log_loss", "Log Loss"))
    ]
    overall = [
        F.concat(F.lit(f"- {shown}: "), _four(F.col(name)))
        for name, shown in (("accuracy", "Accuracy"), ("precision", "Precision"), ("recall", "Recall"), ("f1_score", "F1-score"))
    ]
    # The lines of the report.
    report = _lines(
        f"# {title}", "", "## Overall Metrics", "", *overall, *optional, "", "## Per-Class Metrics", "",
        F.concat(F.lit("- Ham precision/recall/F1: "), triple(tn, fn, fp)),
        F.concat(F.lit("- Spam precision/recall/F1: "), triple(tp, fp, fn)),
        "", "## Confusion Matrix", "", "| Actual \\ Predicted | Ham | Spam |", "| --- | ---: | ---: |",
        F.format_string("| Ham | %d | %d |", tn, fp), F.format_string("| Spam | %d | %d |", fn, tp), "",
    )
    return metrics.select(report.alias("report"))


def _advice(decision: Column) -> tuple[Column, Column]:
    reason = (
        F.when(decision == AUGMENT, "Even at the strictest threshold too many legitimate mails are flagged.")
        .when(decision == TUNE, "Legitimate mails are flagged, but a higher threshold helps.")
        .otherwise("The false-positive rate on legitimate mail is acceptable.")
    )
    step = (
        F.when(decision == AUGMENT, "Add ham sources to the training corpus, retrain and run the benchmark again.")
        .when(decision == TUNE, "Calibrate or raise the threshold, then check precision and recall again.")
        .otherwise("Keep the model and watch for drift.")
    )
    return reason, step


def benchmark_markdown(
    model_name: str, mode: DataFrame, by_source: DataFrame, sweep: DataFrame, source_sweep: DataFrame, decision: DataFrame, examples: DataFrame
) -> DataFrame:
    """One row, column `report`.

    Every section is a few lines (sources x thresholds); they are gathered as
    (section, order, line) rows and joined in order.
    """
    rate = F.format_string("%s %s", F.col("source"), _percent(F.col("false_positive_rate")))
    rates = source_sweep.groupBy("threshold").agg(F.array_join(F.array_sort(F.collect_list(rate)), ", ").alias("rates"))

    def section(frame: DataFrame, number: int, order: Column, line: Column) -> DataFrame:
        return frame.select(F.lit(number).alias("section"), order.cast("string").alias("order"), line.alias("line"))

    def heading(number: int, *lines: str) -> DataFrame:
        return section(mode, number, F.lit(""), _lines(*lines))

    intro = F.when(
        F.col("mode") == "heldout_test_sources",
        "Measured on the held-out test rows of ham sources that are part of the training corpus.",
    ).otherwise("Measured on ham-only corpora that are not part of the training corpus.")
    reason, step = _advice(F.col("decision"))
    parts = [
        section(mode, 0, F.lit(""), _lines(f"# Non-Spam Generalization Benchmark ({model_name})", "", "## Summary", "", intro, "")),
        heading(1, "## Ham-Only Source Results", "", "| Source | Samples | Predicted Ham | Predicted Spam | False-Positive Rate | Avg Spam Probability |",
                "| --- | ---: | ---: | ---: | ---: | ---: |"),
        section(by_source, 2, F.col("source"), F.concat(F.format_string(
            "| %s | %d | %d | %d | ", "source", "samples", "predicted_ham", "predicted_spam"),
            _percent(F.col("false_positive_rate")), F.lit(" | "), _percent(F.col("avg_spam_probability")), F.lit(" |"))),
        heading(3, "", "## Threshold Sweep", "", "| Threshold | Test Accuracy | Test Precision | Test Recall | Test F1 | All Ham FPR | FPR by source |",
                "| --- | ---: | ---: | ---: | ---: | ---: | --- |"),
        section(sweep.join(rates, "threshold", "left"), 4, F.format_string("%.4f", F.col("threshold")), F.concat(
            F.format_string("| %.2f | ", F.col("threshold")),
            F.concat_ws(" | ", *[_percent(F.col(c)) for c in ("test_accuracy", "test_precision", "test_recall", "test_f1", "all_ham_fpr")], F.coalesce("rates", F.lit(""))), F.lit(" |"))),
        section(decision, 5, F.lit(""), _lines("", "## Decision", "", F.concat(F.lit("- Decision: `"), F.col("decision"), F.lit("`")),
                F.concat(F.lit("- Reason: "), reason), F.concat(F.lit("- Recommended next step: "), step), "", "## Representative False Positives", "")),
        section(by_source.join(examples.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "spam_probability", "preview"))).alias("e")), "source", "left"),
                6, F.col("source"), F.concat(F.lit("### "), F.col("source"), F.lit("\n\n"), F.coalesce(F.array_join(F.transform(
                    "e", lambda e: F.concat(F.lit("- Spam probability `"), _four(e.spam_probability), F.lit("`: "), e.preview)), "\n"), F.lit("- No false positives found.")), F.lit("\n"))),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    ordered = F.array_sort(F.collect_list(F.struct("section", "order", "line")))
    return lines.agg(F.concat(F.rtrim(F.array_join(F.transform(ordered, lambda e: e.line), "\n")), F.lit("\n")).alias("report"))


def model_info(metadata: DataFrame, column: str = "metadata") -> DataFrame:
    """Long form (section, metric, value) from metadata JSON: test metrics, and validation
    metrics of the best model, at four decimals."""

    def value(part: Column, name: str) -> Column:
        return F.try_variant_get(part, f"$.{name}", "double")

    parsed = metadata.select(F.parse_json(column).alias("m"))
    best = F.try_variant_get("m", "$.best_model", "string")
    validation = F.from_json(F.to_json(F.try_variant_get("m", "$.validation_results", "variant")), "map<string,variant>")
    sections = parsed.select(
        best.alias("best_model"),
        F.try_variant_get("m", "$.test_metrics", "variant").alias("test"),
        F.try_element_at(validation, best).alias("validation"),
    )
    shown = list(dict.fromkeys(name for _, name in METRIC_NAMES))
    entries = []
    for part in ("test", "validation"):
        for name in shown:
            keys = [key for key, target in METRIC_NAMES if target == name]
            number = F.coalesce(*[value(F.col(part), key) for key in reversed(keys)])
            entries.append((part, name, display_number(number)))
        for name in COUNT_NAMES:
            entries.append((part, name, F.floor(value(F.col(part), name)).cast("double")))
    rows = F.array(*[F.struct(F.lit(p).alias("section"), F.lit(n).alias("metric"), v.alias("value")) for p, n, v in entries])
    return sections.select("best_model", F.explode(rows).alias("e")).select("best_model", "e.*").filter(F.col("value").isNotNull())
