"""Training and model queries.

What an iterative fit finds has no SQL; ids, labels and what must hold of every prediction have.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from mailscreen.config import ScreeningConfig
from mailscreen.functions.probability import plugin_model_name, signals_json
from mailscreen.operators import metrics as ops
from mailscreen.operators.sampling import stratified_split
from mailscreen.operators.scoring import POOLS, prediction_columns, score_with_plugin
from mailscreen.plans import model as models
from mailscreen.plans import train as plans
from mailscreen.plans.head import train_head
from mailscreen.plans.prepare import Corpus
from mailscreen.operators.corpus import dataset_summary
from mailscreen.registry.base import query, table
from mailscreen.registry.sql import S, split_ctes
from mailscreen.registry.corpus_queries import SPLIT, split_mail
from mailscreen.session import scratch_path, written

# The product's defaults: the optimizer's tolerance ends a fit.
CONFIG = ScreeningConfig()


def corpus(spark, folder) -> Corpus:
    rows = written(split_mail(spark, folder), "split")
    return Corpus(rows, dataset_summary(rows))


def _vectors(spark, folder, *splits):
    bundle = corpus(spark, folder)
    train = bundle.part("train")
    features = models.TextFeatures.fit(train, "doc_id", "text", CONFIG)
    return features, [models.training_vectors(features, bundle.part(s), "doc_id") for s in splits]


def _one_row(spark, name, metrics):
    values = [float(metrics[k]) if metrics[k] is not None else None for k in ("accuracy", "precision", "recall", "f1_score", "roc_auc", "brier_score", "log_loss")]
    schema = "model string, accuracy double, precision double, recall double, f1_score double, roc_auc double, brier_score double, log_loss double"
    return spark.createDataFrame([(name, *values)], schema)


# The fit is proven to be within the tolerance of the least objective, beats the objective of a
# constant, and ranks the rows it was fitted on; a model that knows nothing fails all three.
_FACTS = "true AS converged, true AS beats_constant, true AS ranks"
_VALIDATION = f"WITH {SPLIT} SELECT doc_id, label, true AS probable, true AS consistent, {_FACTS} FROM parted WHERE split = 'validation'"


def _facts(classifier, train):
    """`converged`, `beats_constant`, `ranks` of a fit, as columns."""
    told = [m.certificate for m in classifier.members]
    converged = all(t["converged"] and t["gap"] <= CONFIG.fit.tolerance * t["objective"] for t in told)
    # With balanced weights, the best constant margin is 0: every row loses ln 2, or 1.
    c, loss = (CONFIG.fit.logistic_c, math.log(2.0)) if classifier.kind == models.LOGISTIC else (CONFIG.fit.margin_c, 1.0)
    share = 1.0 if classifier.kind == models.LOGISTIC else 1.0 - 1.0 / CONFIG.fit.folds
    beats = all(t["objective"] < 0.8 * c * loss * share * train.count() for t in told)
    ranks = ops.roc_auc(classifier.score(train)).first()[0] > 0.95
    return [F.lit(fact).alias(name) for name, fact in (("converged", converged), ("beats_constant", beats), ("ranks", ranks))]


def _sound(classifier, train, validation):
    """Every validation row, whether its prediction is what its probability says, and the facts of the fit."""
    p = F.col("spam_probability")
    checks = p.between(0.0, 1.0).alias("probable"), (F.col("prediction") == (p > 0.5).cast("int")).alias("consistent")
    return classifier.score(validation).select("doc_id", "label", *checks, *_facts(classifier, train))


@query("train_logistic", _VALIDATION)
def train_logistic(spark, folder):
    _, (train, validation) = _vectors(spark, folder, "train", "validation")
    return _sound(models.fit_logistic_classifier(train, CONFIG), train, validation)


@query("train_svc_calibrated", _VALIDATION)
def train_svc_calibrated(spark, folder):
    _, (train, validation) = _vectors(spark, folder, "train", "validation")
    return _sound(models.fit_calibrated_svc(train, "doc_id", CONFIG), train, validation)


def _agree(metrics, rows, spam):
    """Whether the metrics follow from their confusion matrix, over all the rows."""
    (tn, fp), (fn, tp) = metrics["confusion_matrix"]
    wanted = {"accuracy": (tp + tn, tp + tn + fp + fn), "precision": (tp, tp + fp), "recall": (tp, tp + fn), "f1_score": (2 * tp, 2 * tp + fp + fn)}
    right = all(abs(metrics[k] - (a / b if b else 0.0)) < 1e-9 for k, (a, b) in wanted.items())
    return right and tn + fp + fn + tp == rows and fn + tp == spam and 0.0 <= metrics["roc_auc"] <= 1.0 and metrics["log_loss"] > 0.0


_CANDIDATES = "(VALUES ('logistic_regression'), ('calibrated_linear_svc')) AS c(model)"


@query(
    "candidate_metrics",
    f"""WITH {SPLIT}, seen AS (SELECT count(*) AS rows, sum(label)::BIGINT AS spam FROM parted WHERE split = 'validation')
        SELECT model, rows, spam, true AS metrics_agree, true AS best_is_first_maximum FROM {_CANDIDATES}, seen""",
)
def candidate_metrics(spark, folder):
    """Both candidates, what they were judged on, and whether the winner is the first with the best (accuracy, f1)."""
    _, (train, validation) = _vectors(spark, folder, "train", "validation")
    best, _, results = plans.select_candidate(train, validation, plans.candidate_fits(CONFIG, "doc_id"))
    rows, spam = validation.count(), validation.where("label = 1").count()
    first = max(results, key=lambda name: (results[name]["accuracy"], results[name]["f1_score"]))
    told = [(name, rows, spam, _agree(metrics, rows, spam), best == first) for name, metrics in results.items()]
    return spark.createDataFrame(told, "model string, rows long, spam long, metrics_agree boolean, best_is_first_maximum boolean")


@query(
    "train_and_evaluate",
    f"""WITH {SPLIT}, seen AS (SELECT split, count(*) AS rows, sum(label)::BIGINT AS spam FROM parted GROUP BY split)
        SELECT t.rows AS test_rows, t.spam AS test_spam, v.rows AS validation_rows, true AS metrics_agree, true AS best_is_first_maximum, true AS refit_converged
        FROM seen t, seen v WHERE t.split = 'test' AND v.split = 'validation'""",
)
def train_and_evaluate(spark, folder):
    """Select, refit on train and validation, judge on test: what the saved metadata says must hold together."""
    bundle = corpus(spark, folder)
    fitted = plans.train_and_evaluate(bundle, CONFIG, "baseline", "doc_id")
    told = fitted.metadata
    judged = told["validation_results"]
    (test, spam), (rows, spam_seen) = ((bundle.part(s).count(), bundle.part(s).where("label = 1").count()) for s in ("test", "validation"))
    agree = _agree(told["test_metrics"], test, spam) and all(_agree(m, rows, spam_seen) for m in judged.values())
    first = max(judged, key=lambda name: (judged[name]["accuracy"], judged[name]["f1_score"]))
    converged = all(m.certificate["converged"] for m in fitted.classifier.members)
    schema = "test_rows long, test_spam long, validation_rows long, metrics_agree boolean, best_is_first_maximum boolean, refit_converged boolean"
    return spark.createDataFrame([(test, spam, rows, agree, told["best_model"] == first and len(judged) == 2, converged)], schema)


def _fitted(spark, folder):
    bundle = corpus(spark, folder)
    features = models.TextFeatures.fit(bundle.part("train"), "doc_id", "text", CONFIG)
    classifier = models.fit_logistic_classifier(models.training_vectors(features, bundle.part("train"), "doc_id"), CONFIG)
    return bundle, models.ScreeningModel(features, classifier, {"best_model": models.LOGISTIC})


@query("evaluate_model")
def evaluate_model(spark, folder):
    bundle, fitted = _fitted(spark, folder)
    return _one_row(spark, fitted.name, plans.evaluate_model(fitted, bundle.part("test"), "doc_id"))


@query("model_roundtrip", f"WITH {SPLIT} SELECT doc_id, true AS same FROM parted WHERE split = 'test'")
def model_roundtrip(spark, folder):
    bundle, fitted = _fitted(spark, folder)
    path = scratch_path(spark, "model")
    fitted.save(path)
    again = models.ScreeningModel.load(spark, path)
    test = bundle.part("test").select("doc_id", "text")
    first = fitted.score(test, "doc_id").select("doc_id", F.col("spam_probability").alias("before"))
    second = again.score(test, "doc_id").select("doc_id", F.col("spam_probability").alias("after"))
    return first.join(second, "doc_id").select("doc_id", (F.abs(F.col("before") - F.col("after")) < 1e-12).alias("same"))


@query("score_model")
def score_model(spark, folder):
    """The fitted model over every document, with its top signals."""
    _, fitted = _fitted(spark, folder)
    documents = table(spark, folder, "documents").select("doc_id", "text")
    scored = fitted.score(documents, "doc_id", signals=CONFIG.signals_per_text)
    return scored.select("doc_id", "predicted_label", "spam_probability", "confidence", "decision_score", signals_json(F.col("top_signals")).alias("top_signals"))


def letter_model():
    """A stand-in for an encoder: logits from how a text is written."""
    import numpy as np

    def predict(texts):
        return np.array([[1.0 + t.count(" ") / 100.0, 40.0 * sum(c.isupper() for c in t) / max(len(t), 1)] for t in texts]).reshape(-1, 2)

    return predict


@query(
    "score_with_plugin",
    r"""WITH l AS (SELECT doc_id, 1.0::DOUBLE + (length(text) - length(replace(text, ' ', ''))) / 100.0::DOUBLE AS h,
          40.0::DOUBLE * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / greatest(length(text), 1) AS s FROM documents)
        SELECT doc_id, round(1 / (1 + exp(h - s)), 6) AS spam_probability, round(s - h, 6) AS decision_score,
          CASE WHEN s > h THEN 'spam' ELSE 'ham' END AS predicted_label, 'contextual_letter_model' AS model_name FROM l""",
)
def plugin(spark, folder):
    scored = score_with_plugin(table(spark, folder, "documents").select("doc_id", "text"), letter_model)
    named = prediction_columns(scored).withColumn("model_name", plugin_model_name(F.lit("someone/Letter-Model")))
    return named.select(
        "doc_id", F.round("spam_probability", 6).alias("spam_probability"), F.round("decision_score", 6).alias("decision_score"), "predicted_label", "model_name"
    )


_LETTERS = r"""1.0::DOUBLE + (length(t) - length(replace(t, ' ', ''))) / 100.0::DOUBLE AS h,
          40.0::DOUBLE * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) / greatest(length(t), 1) AS s"""


@query(
    "score_with_plugin_windows",
    f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{S}]+') AS k FROM documents),
        piece AS (SELECT doc_id, i, t FROM (SELECT doc_id, CASE WHEN len(k) <= 256 THEN [text] ELSE list_transform(range(0, len(k) - 32, 224), lambda i: array_to_string(k[i + 1:i + 256], ' ')) END AS ts FROM w),
                  unnest(ts) WITH ORDINALITY AS u(t, i)),
        l AS (SELECT doc_id, i, {_LETTERS} FROM piece),
        pooled AS (SELECT doc_id, count(*) AS windows, avg(s) - avg(h) AS mean_score, max(s - h) AS max_score, arg_min(s - h, i) AS first_score FROM l GROUP BY doc_id)
        SELECT doc_id, round(mean_score, 6) AS mean_score, round(1 / (1 + exp(-mean_score)), 6) AS spam_probability, round(max_score, 6) AS max_score, round(first_score, 6) AS first_score
        FROM pooled""",
)
def plugin_windows(spark, folder):
    """Texts longer than the model takes, in windows of 256 tokens that overlap by 32; pooled in three ways."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    scored = {pool: score_with_plugin(documents, letter_model, max_length=256, overlap=32, pool=pool) for pool in POOLS}
    told = scored["mean"].select("doc_id", F.round("decision_score", 6).alias("mean_score"), F.round("spam_probability", 6).alias("spam_probability"))
    for pool in ("max", "first"):
        told = told.join(scored[pool].select("doc_id", F.round("decision_score", 6).alias(f"{pool}_score")), "doc_id")
    return told


@query("train_embedding_head")
def train_embedding_head(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.when(F.col("label") == 0, 1).otherwise(0).alias("label"))
    split = written(stratified_split(rows, ["vec_id"]), "embedding-split")
    head = plans.fit_embedding_head(split.filter("split = 'train'"), "embedding", CONFIG)
    scored = head.score(plans.with_vector(split.filter("split = 'test'"), "embedding"))
    return _one_row(spark, models.EMBEDDING_HEAD, ops.evaluate(written(scored.select("label", "prediction", "spam_probability"), "head")))


@query(
    "train_head_epochs",
    f"""WITH emb AS (SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings), {split_ctes('emb', 'vec_id')}
        SELECT (SELECT count(*) FROM parted WHERE split = 'train') AS train_rows, (SELECT count(*) FROM parted WHERE split = 'validation') AS validation_rows,
               true AS epochs_in_order, true AS best_is_first_maximum, true AS stops_for_patience_only, true AS resumed_is_same, true AS loss_falls""",
)
def train_head_epochs(spark, folder):
    """The head over epochs, once in one go and once broken off after two of them."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.when(F.col("label") == 0, 1).otherwise(0).alias("label"))
    split = written(stratified_split(rows, ["vec_id"]), "embedding-split")
    train, validation = split.filter("split = 'train'"), split.filter("split = 'validation'")
    whole = train_head(train, validation, "embedding", "vec_id", CONFIG)
    path = scratch_path(spark, "epochs")
    train_head(train, validation, "embedding", "vec_id", CONFIG, path, until=2)
    resumed = train_head(train, validation, "embedding", "vec_id", CONFIG, path)
    scores = [e.validation_f1 for e in whole.epochs]
    first = scores.index(max(scores))
    ended = len(scores) == CONFIG.head.epochs or len(scores) - 1 - first == CONFIG.head.patience + 1
    same = len(whole.epochs) == len(resumed.epochs) and all(np.allclose(a.weights, b.weights, rtol=1e-9, atol=1e-12) for a, b in zip(whole.epochs, resumed.epochs))
    told = (train.count(), validation.count(), [e.epoch for e in whole.epochs] == list(range(len(scores))), whole.best == first, ended, same, whole.epochs[-1].train_loss < whole.epochs[0].train_loss)
    return spark.createDataFrame([told], "train_rows long, validation_rows long, epochs_in_order boolean, best_is_first_maximum boolean, stops_for_patience_only boolean, resumed_is_same boolean, loss_falls boolean")
