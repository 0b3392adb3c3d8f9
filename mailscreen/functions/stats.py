"""The eleven hand-made text statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen.functions.text import DIGIT, URL, WORD, clean_text, only_with, url_hits
from mailscreen.session import computed

# The statistics in their output order.
STATISTICS = (
    "char_count",
    "word_count",
    "avg_word_length",
    "uppercase_ratio",
    "digit_ratio",
    "exclamation_count",
    "question_count",
    "url_count",
    "currency_count",
    "html_tag_count",
    "suspicious_keyword_hits",
)

# What is counted in the raw text.
KEYWORDS = ("free", "winner", "offer", "credit", "urgent", "money", "bonus", "click", "remove", "unsubscribe")
CURRENCY = r"(?=[$€£UuEeVv])(?iu:[$€£]|usd|eur|vnd)"
HTML_LIKE = r"</?[A-Za-z][^>]*>"

# The first letter is looked at before anything else; most places end there.
_INITIALS = "".join(sorted({letter for word in KEYWORDS for letter in (word[0], word[0].upper())}))
KEYWORD_HIT = rf"(?=[{_INITIALS}])(?<![{WORD}])(?iu:{'|'.join(KEYWORDS)})(?![{WORD}])"


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _characters(text: Column, others: str) -> Column:
    """Characters left once runs of `others` are gone."""
    return F.length(F.regexp_replace(text, others, ""))


def _spaced(text: Column) -> Column:
    """The words of `text` with one blank between them.

    Only what stands between words other than a single blank is searched for: far fewer
    matches than there are words, and no array of the words is made.
    """
    blanks = F.regexp_replace(text, f"[^{WORD} ][^{WORD}]*", " ")
    return F.trim(only_with(["  "], blanks, lambda t: F.regexp_replace(t, " {2,}", " "), lambda t: t))


def _literal_hits(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def with_email_stats(df: DataFrame, text: str, keep: list[str], only: tuple[str, ...] = STATISTICS, clean: str | None = None) -> DataFrame:
    """`keep` columns plus the statistics of `text` (all, or those named), as doubles.

    The first three describe the cleaned text, the other eight the text as given.  `clean`
    names the column that holds the cleaned text, if there is one already.
    """
    known = clean
    raw, clean = F.col("_raw"), F.col("_clean")
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_raw"), *([F.col(known).alias("_clean")] if known else []))
    on_clean = {
        "char_count": lambda: F.length(clean),
        "word_count": lambda: F.col("_words"),
        "avg_word_length": lambda: F.when(F.col("_words") > 0, (F.length("_spaced") - F.col("_words") + 1) / F.col("_words")).otherwise(0.0),
    }
    length = F.greatest(F.length(raw), F.lit(1))
    on_raw = {
        "uppercase_ratio": lambda: _characters(raw, "[^A-Z]+") / length,
        "digit_ratio": lambda: _characters(raw, f"[^{DIGIT}]+") / length,
        "exclamation_count": lambda: _literal_hits(raw, "!"),
        "question_count": lambda: _literal_hits(raw, "?"),
        "url_count": lambda: url_hits(raw),
        "currency_count": lambda: _hits(raw, CURRENCY),
        "html_tag_count": lambda: F.when(F.contains(raw, F.lit("<")), _hits(raw, HTML_LIKE)).otherwise(0),
        "suspicious_keyword_hits": lambda: _hits(raw, KEYWORD_HIT),
    }
    if any(name in on_clean for name in only):
        rows = rows if known else computed(rows, _clean=clean_text(raw))
    if "word_count" in only or "avg_word_length" in only:
        rows = computed(rows, _spaced=_spaced(clean))
        rows = computed(rows, _words=F.when(F.col("_spaced") == "", 0).otherwise(_literal_hits(F.col("_spaced"), " ") + 1))
    values = {**on_clean, **on_raw}
    return computed(rows, **{name: values[name]().cast("double") for name in only}).select(*keep, *only)
