import math
import random

import pytest
from pyspark.sql import functions as F

from mailscreen.operators import benchmark as bench
from mailscreen.operators import metrics as ops
from mailscreen.plans.ham_benchmark import run_ham_benchmark
from mailscreen.sinks import reports


def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, spam_probability double")


def pairwise_auc(rows):
    pos = [p for l, _, p in rows if l == 1]
    neg = [p for l, _, p in rows if l == 0]
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [1, 2, 6])
@pytest.mark.parametrize("buckets", [1, 2, 64])
def test_auc_counts_pairs(spark, digits, buckets):
    rng = random.Random(digits)
    rows = []
    for _ in range(700):
        label = int(rng.random() < 0.3)
        rows.append((label, 0, round(min(max(rng.gauss(0.4 + 0.2 * label, 0.2), 0.0), 1.0), digits)))
    rows += [(i % 2, 0, 0.5) for i in range(350)]  # one score holds a third of the rows
    assert ops.roc_auc(frame(spark, rows), buckets=buckets).first()[0] == pytest.approx(pairwise_auc(rows), abs=1e-12)


def test_auc_needs_both_classes(spark):
    assert ops.roc_auc(frame(spark, [(1, 1, 0.5)])).first()[0] is None
    assert ops.roc_auc(frame(spark, [(1, 1, 0.5)]).limit(0)).first()[0] is None


def test_published_confusion_matrix(spark):
    cells = [(0, 0, 3444), (0, 1, 26), (1, 0, 14), (1, 1, 2388)]
    rows = spark.createDataFrame(cells, "label int, prediction int, n int").withColumn("i", F.explode(F.expr("sequence(1, n)")))
    got = ops.binary_metrics(rows).first()
    assert [round(v, 4) for v in got] == [0.9932, 0.9892, 0.9942, 0.9917]


def test_division_by_zero_gives_zero(spark):
    got = ops.binary_metrics(frame(spark, [(0, 0, 0.1)])).first()
    assert (got["accuracy"], got["precision"], got["recall"], got["f1_score"]) == (1.0, 0.0, 0.0, 0.0)
    report = {r["class"]: r for r in ops.classification_report(frame(spark, [(0, 0, 0.1)])).collect()}
    assert report["1"]["support"] == 0 and report["weighted avg"]["precision"] == 1.0


def test_log_loss_is_clipped(spark):
    got = ops.probability_losses(frame(spark, [(1, 0, 0.0), (0, 0, 0.25)])).first()
    assert got["log_loss"] == pytest.approx((-math.log(2.220446049250313e-16) - math.log(0.75)) / 2)
    assert got["brier_score"] == pytest.approx((1 + 0.0625) / 2)


def test_first_candidate_wins_ties(spark):
    rows = [(1, "b", 0.9, 0.8), (0, "a", 0.9, 0.8), (2, "c", 0.9, 0.7)]
    df = spark.createDataFrame(rows, "position int, name string, accuracy double, f1_score double")
    assert ops.best_candidate(df).first()["name"] == "a"


@pytest.mark.parametrize(
    "base, strict, decision",
    [(0.53, 0.29, "augment_ham_data_and_retrain"), (0.12, 0.08, "tune_threshold_then_retest"), (0.05, 0.02, "keep_current_model"), (0.10, 0.20, "keep_current_model")],
)
def test_recommendation(spark, base, strict, decision):
    sweep = spark.createDataFrame([(0.5, base), (0.7, 0.2), (0.95, strict)], "threshold double, all_ham_fpr double")
    assert bench.recommend(sweep).first()["decision"] == decision


@pytest.mark.parametrize(
    "accuracy, confidence, spam, want",
    [(0.5, 0.5, 0.8, ("critical", True, "spam")), (0.6, 0.7, 0.5, ("warning", False, "none")), (0.8, 0.7, 0.2, ("ok", False, "ham")), (0.9, 0.7, 0.7, ("excellent", False, "none"))],
)
def test_health_verdict(spark, accuracy, confidence, spam, want):
    df = spark.createDataFrame([(accuracy, confidence, int(spam * 10), 10)], "accuracy double, avg_confidence double, predicted_spam long, total long")
    assert tuple(ops.health_verdict(df).first()) == want


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = []
    for i in range(2000):
        p = round(rng.random(), 3)
        rows.append((i, rng.choice(["hot"] * 5 + ["b", "c"]), int(rng.random() < 0.4), f"text {i}\n" + "z" * 300, p, int(p > 0.5)))
    schema = "id long, source string, label int, text string, spam_probability double, prediction int"
    return rows, spark.createDataFrame(rows, schema).repartition(6).cache()


def test_top_false_positives_by_hand(scored):
    rows, df = scored
    got = {(r["source"], r["rank"]): (r["spam_probability"], r["preview"]) for r in bench.top_false_positives(bench.heldout_ham(df, ["hot", "b"]), ["id"]).collect()}
    for source in ("hot", "b"):
        best = sorted((-r[4], r[0], r[3]) for r in rows if r[1] == source and r[2] == 0 and r[5] == 1)[:5]
        for rank, (p, _, text) in enumerate(best, 1):
            assert got[source, rank] == (-p, text[:180].replace("\n", " "))
    assert len(got) == 10


@pytest.mark.parametrize("inside", [True, False])
def test_benchmark_end_to_end(spark, scored, inside):
    rows, df = scored
    counts = df.groupBy("source").count()
    if inside:
        b = run_ham_benchmark(df, counts, ["hot", "b"], ["id"])
        ham = [r for r in rows if r[1] in ("hot", "b") and r[2] == 0]
    else:
        outside = df.filter("label = 0").withColumn("source", F.concat(F.lit("x_"), "source"))
        b = run_ham_benchmark(df, counts, ["nowhere"], ["id"], external=outside)
        ham = [r for r in rows if r[2] == 0]
    sweep = {r["threshold"]: r for r in b.sweep.collect()}
    for t in bench.THRESHOLDS:
        assert sweep[t]["all_ham_fpr"] == pytest.approx(sum(r[4] >= t for r in ham) / len(ham))
        assert sweep[t]["test_accuracy"] == pytest.approx(sum((r[4] >= t) == (r[2] == 1) for r in rows) / len(rows))
    text = b.report("m").first()["report"]
    order = [text.index(h) for h in ("# Non-Spam", "## Summary", "## Ham-Only", "## Threshold Sweep", "| 0.50 |", "| 0.95 |", "## Decision", "## Representative")]
    assert order == sorted(order) and text.endswith("\n") and ("held-out" in text) == inside
    with pytest.raises(ValueError):
        run_ham_benchmark(df, counts, ["nowhere"], ["id"])


def test_metrics_report(spark):
    row = spark.createDataFrame(
        [(0.9932, 0.9892, 0.9942, 0.9917, 0.9996, 0.0063, None, 2388, 26, 14, 3444)],
        "accuracy double, precision double, recall double, f1_score double, roc_auc double, brier_score double, log_loss double, tp long, fp long, fn long, tn long",
    )
    lines = reports.metrics_markdown("Results", row).first()["report"].split("\n")
    assert lines[0] == "# Results" and "- Accuracy: 0.9932" in lines and "- ROC AUC: 0.9996" in lines
    assert "| Ham | 3444 | 26 |" in lines and "| Spam | 14 | 2388 |" in lines and not any("Log Loss" in line for line in lines)


def test_model_info_aliases(spark):
    metadata = '{"best_model":"m","test_metrics":{"f1":0.1,"f1_score":0.98765,"auc":0.5,"tp":3.9,"accuracy":null},"validation_results":{"m":{"accuracy":1},"n":{"recall":1}}}'
    got = {(r["section"], r["metric"]): r["value"] for r in reports.model_info(spark.createDataFrame([(metadata,)], "metadata string")).collect()}
    assert got == {("test", "f1"): 0.9876, ("test", "roc_auc"): 0.5, ("test", "tp"): 3.0, ("validation", "accuracy"): 1.0}
    assert reports.model_info(spark.createDataFrame([("{}",)], "metadata string")).count() == 0
