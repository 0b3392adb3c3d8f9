"""Planted signals: a model must find them in held-out rows, and must not find what is not there."""

import random

import pytest
from pyspark.sql import functions as F

from mailscreen.config import FitOptions, ScreeningConfig, TermOptions
from mailscreen.operators.corpus import finalize
from mailscreen.operators.metrics import roc_auc
from mailscreen.plans import model as models
from mailscreen.plans import train as plans
from mailscreen.plans.prepare import prepare_corpus

CONFIG = ScreeningConfig(terms=TermOptions(300, 300), fit=FitOptions(max_iterations=30))
SPAM_WORDS, HAM_WORDS = ["prize", "winner", "free", "click"], ["meeting", "project", "report", "lunch"]
NEUTRAL = ["monday", "table", "river", "window", "paper", "green", "seven", "music", "water", "stone"]


def mails(n, seed, shuffle=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = i % 2
        words = rng.choices(NEUTRAL, k=8) + rng.choices(SPAM_WORDS if label else HAM_WORDS, k=2)
        rng.shuffle(words)
        rows.append((str(i), " ".join(words) + f" n{i}", rng.randint(0, 1) if shuffle else label))
    return rows


def corpus(spark, rows):
    return prepare_corpus([finalize(spark.createDataFrame(rows, "k string, t string, l int"), "s", "k", "t", "l")])


@pytest.fixture(scope="module")
def trained(spark):
    bundle = corpus(spark, mails(200, 1))
    return bundle, plans.train_and_evaluate(bundle, CONFIG)


def test_planted_words_are_found(trained):
    _, model = trained
    assert set(model.metadata["validation_results"]) == {models.LOGISTIC, models.CALIBRATED_SVC}
    assert model.metadata["test_metrics"]["accuracy"] > 0.9 and model.metadata["test_metrics"]["roc_auc"] > 0.95
    assert model.metadata["dataset_summary"]["total_samples"] == 200


def test_signals_name_the_planted_words(trained, spark):
    _, model = trained
    df = spark.createDataFrame([(1, "Free prize waiting for you click now"), (2, "Project meeting moved to next week"), (3, "<b></b>")], "id long, text string")
    got = {r["id"]: r for r in model.score(df, "id", signals=8).collect()}
    assert got[1]["predicted_label"] == "spam" and got[2]["predicted_label"] == "ham" and len(got) == 3
    assert {"prize", "click"} & {s["feature"] for s in got[1]["top_signals"]}
    assert all(s["direction"] == "ham" for s in got[2]["top_signals"])
    assert len(got[1]["top_signals"]) <= 8 and got[1]["model_name"] == model.name


def test_saved_model_scores_alike(trained, spark, tmp_path):
    bundle, model = trained
    model.save(str(tmp_path / "m"))
    again = models.ScreeningModel.load(spark, str(tmp_path / "m"))
    assert again.metadata == model.metadata
    a = {r["text_key"]: r["spam_probability"] for r in model.score(bundle.part("test"), "text_key").collect()}
    b = {r["text_key"]: r["spam_probability"] for r in again.score(bundle.part("test"), "text_key").collect()}
    assert a == pytest.approx(b)
    assert plans.evaluate_model(again, bundle.part("test"), "text_key")["accuracy"] > 0.9
    with pytest.raises(RuntimeError):
        models.require_same_version("3.5.1", "4.1.2")
    models.require_same_version("4.1.0", "4.1.2")


def test_calibrated_margins_rank_and_calibrate(spark):
    bundle = corpus(spark, mails(150, 2))
    features = models.TextFeatures.fit(bundle.part("train"), "text_key", "text", CONFIG)
    train = models.training_vectors(features, bundle.part("train"), "text_key")
    held_out = models.training_vectors(features, bundle.part("validation", "test"), "text_key")
    classifier = models.fit_calibrated_svc(train, "text_key", CONFIG)
    assert len(classifier.members) == 3 and all(slope > 0 for slope, _ in classifier.sigmoids)
    scored = classifier.score(held_out)
    assert roc_auc(scored).first()[0] > 0.95
    assert scored.filter("spam_probability < 0 OR spam_probability > 1").count() == 0


def test_shuffled_labels_carry_nothing(spark):
    bundle = corpus(spark, mails(400, 3, shuffle=True))
    features = models.TextFeatures.fit(bundle.part("train"), "text_key", "text", CONFIG)
    classifier = models.fit_logistic_classifier(models.training_vectors(features, bundle.part("train"), "text_key"), CONFIG)
    scored = classifier.score(models.training_vectors(features, bundle.part("validation", "test"), "text_key"))
    assert abs(roc_auc(scored).first()[0] - 0.5) < 0.2


def test_head_on_embeddings(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, int(i % 5 == 0), [rng.gauss(1.5 if i % 5 == 0 and d == 0 else 0.0, 1.0) for d in range(8)], f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<float>, text string").withColumn("text_key", F.col("text"))
    from mailscreen.operators.corpus import dataset_summary
    from mailscreen.operators.sampling import stratified_split
    from mailscreen.plans.prepare import Corpus

    split = stratified_split(df, ["id"]).withColumns({"source": F.lit("s"), "text_length": F.lit(2)})
    model = plans.train_and_evaluate(Corpus(split, dataset_summary(split)), CONFIG, "contextual", embedding="embedding")
    assert model.classifier.kind == models.EMBEDDING_HEAD and model.metadata["test_metrics"]["roc_auc"] > 0.75
    model.save(str(tmp_path / "contextual"))
    again = models.ScreeningModel.load(spark, str(tmp_path / "contextual"))
    test = split.filter("split = 'test'")
    scored = again.score(test, "text_key", signals=3).collect()
    assert len(scored) == test.count() and all(r["top_signals"] == [] and 0 <= r["spam_probability"] <= 1 for r in scored)
    with pytest.raises(ValueError):
        plans.train_and_evaluate(Corpus(split, dataset_summary(split)), CONFIG, "contextual")


def test_sigmoid_pulls_in_targets(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 1.0), (0, -1.0), (0, -2.0)], "label int, margin double")
    slope, _ = models.fit_sigmoid(df)
    assert 0 < slope < 5


def test_training_queries_fit_to_the_tolerance():
    from mailscreen.registry.training_queries import CONFIG as used

    assert used == ScreeningConfig()
