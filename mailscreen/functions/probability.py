"""Probabilities, scores and display values of a prediction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the numerically safe softmax.
LOGIT_LIMIT = 1e4
EXP_LOW, EXP_HIGH = -745.0, 709.0

# Block names in front of a feature, dropped for display.
FEATURE_PREFIXES = ("word_tfidf__", "char_tfidf__", "email_stats__", "stats__")


def _safe_logit(logit: Column) -> Column:
    """NaN to 0, infinities to +-1e4; finite values pass unchanged."""
    infinity = F.lit(float("inf"))
    return (
        F.when(F.isnan(logit), F.lit(0.0))
        .when(logit == infinity, F.lit(LOGIT_LIMIT))
        .when(logit == -infinity, F.lit(-LOGIT_LIMIT))
        .otherwise(logit)
    )


def stable_softmax(ham_logit: Column, spam_logit: Column) -> Column:
    """struct<ham, spam> of probabilities that are finite and add up to 1."""
    ham, spam = _safe_logit(ham_logit), _safe_logit(spam_logit)
    top = F.greatest(ham, spam)

    def power(value: Column) -> Column:
        return F.exp(F.least(F.greatest(value - top, F.lit(EXP_LOW)), F.lit(EXP_HIGH)))

    total = power(ham) + power(spam)
    return F.struct((power(ham) / total).alias("ham"), (power(spam) / total).alias("spam"))


def logit_difference(ham_logit: Column, spam_logit: Column) -> Column:
    return spam_logit - ham_logit


def centred_score(spam_probability: Column) -> Column:
    """Decision score of a model that only gives probabilities."""
    return spam_probability * 2.0 - 1.0


def ham_probability(spam_probability: Column) -> Column:
    return F.lit(1.0) - spam_probability


def confidence(spam_probability: Column) -> Column:
    return F.greatest(spam_probability, ham_probability(spam_probability))


def label_name(label_id: Column) -> Column:
    return F.when(label_id == 1, "spam").otherwise("ham")


def label_from_name(name: Column) -> Column:
    """1 for spam, 0 for ham, NULL for anything else."""
    return F.when(name == "spam", 1).when(name == "ham", 0)


def display_number(value: Column) -> Column:
    """Four decimals, halves to even; NaN and NULL become NULL."""
    number = value.cast("double")
    return F.when(~F.isnan(number), F.bround(number, 4))


def plain_number(value: Column, digits: int = 4) -> Column:
    """A number of up to `digits` decimals as text; Spark's own text of one below 0.001 has an exponent."""
    small = F.regexp_replace(value.cast(f"decimal(38,{digits})").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(value) < 0.001, small).otherwise(value.cast("string"))


def scores_json(scores: Column) -> Column:
    """struct<spam, ham> as JSON with plain numbers; a NULL one is left out."""
    parts = [F.concat(F.lit(f'"{name}":'), plain_number(scores.getField(name))) for name in ("spam", "ham")]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def signals_json(signals: Column) -> Column:
    """Top signals as JSON with plain numbers."""

    def told(s: Column) -> Column:
        opened = F.regexp_replace(F.to_json(F.struct(s.feature.alias("feature"))), r"\}$", ",")
        closed = F.regexp_replace(F.to_json(F.struct(s.direction.alias("direction"))), r"^\{", ",")
        return F.concat(opened, F.lit('"contribution":'), plain_number(s.contribution, 6), closed)

    return F.when(signals.isNotNull(), F.concat(F.lit("["), F.concat_ws(",", F.transform(signals, told)), F.lit("]")))


def display_feature(name: Column) -> Column:
    """Feature name without its block prefix."""
    for prefix in FEATURE_PREFIXES:
        name = F.replace(name, F.lit(prefix), F.lit(""))
    return name


def plugin_model_name(name: Column) -> Column:
    """`org/Some-Model` as `contextual_some_model`."""
    short = F.lower(F.element_at(F.split(name, "/"), -1))
    slug = F.regexp_replace(F.regexp_replace(short, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("contextual_"), F.when(slug == "", "transformer").otherwise(slug))
