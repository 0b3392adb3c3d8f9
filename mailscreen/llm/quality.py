"""Quality rules: how far a document's make-up is from its language's.

Two histograms describe a text: characters by class, and words by common word (one bin
each for the most common words of the language, one for all others).  The reference of a
language is the sum over all its documents of at least `min_words` words; a document is
judged by its Jensen-Shannon distance (base 2, 0 to 1) to both.

Base rules, on words `[^\\x20\\x09-\\x0D]+` of the whole text: at least `min_words` words, and at
most half of them in three-word windows that occur twice or more in the text.  The guards:
a text of fewer than `min_words` words is not judged by its histograms at all (it failed
already), and the word histogram counts only from `min_common_words` words on, since
a short text has too few words to show the usual share of common ones.

A text without any common word is at a distance that the language's share of common words
fixes alone (0.34 at a share of 0.21), so a fixed limit on the word distance finds texts with
too much of a common word only.  Lack of common words is judged apart, as two bins (common,
other): a text fails if it is over `max_common_lack` of the way to having none, and its
shortfall is over `min_deviations` standard deviations of a sample of its length.

All Column expressions; documents are shuffled nowhere, the references are small (classes
and common words per language) and are joined back to the documents by broadcast.

Edge cases: a null text has no words and fails; a null language is a language of its own;
a language without any document of that length has no reference, and none to judge;
ties among common words go to the smaller word; repeated rows are judged alike; columns
named like the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscreen.session import computed, join_summary, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
CLASSES = 7  # see class_counts


@dataclass(frozen=True)
class QualityLimits:
    min_words: int = 50
    max_repeated: float = 0.5
    max_class_distance: float = 0.3
    max_word_distance: float = 0.4
    min_common_words: int = 50
    common_words: int = 20
    max_common_lack: float = 0.5
    min_deviations: float = 3.0


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    If the hashes of a text's windows all differ, so do its windows, and nothing is
    repeated (most texts).  For the others the windows themselves are sorted with their
    places, equal neighbours found, and the places they cover counted once.
    """
    last = F.size(words) - 3

    def windows(form) -> Column:
        made = F.transform(F.sequence(F.lit(0), last), lambda i: form(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        return F.when(last > 0, made)

    alike = _let(windows(F.xxhash64), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.coalesce(alike, F.lit(False)), _covered(windows(lambda *w: F.concat_ws(" ", *w)))).otherwise(0)


def _covered(windows: Column) -> Column:
    """Places covered by windows (of three) that are not unique."""
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def again(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        same = F.filter(
            sorted_,
            lambda x, k: ((k > 0) & (F.get(sorted_, k - 1)["w"] == x["w"])) | ((k < last) & (F.get(sorted_, k + 1)["w"] == x["w"])),
        )
        return _let(F.sort_array(F.transform(same, lambda x: x["i"])), gaps)

    def gaps(places: Column) -> Column:
        # Each window adds as many places as it lies before the next one, at most three.
        last = F.size(places) - 1
        added = F.transform(places, lambda p, k: F.when(k < last, F.least(F.lit(3), F.get(places, k + 1) - p)).otherwise(3))
        return F.aggregate(added, F.lit(0), lambda a, b: a + b)

    return _let(placed, again)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def base_columns(docs: DataFrame, limits: QualityLimits = QualityLimits(), text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, _words, _rare."""
    worded = computed(docs, _words=words_of(F.col(text)), _rare=rare_characters(F.col(text)))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = computed(
        worded,
        n_words=F.size("_words").cast("bigint"),
        word_chars=F.length(F.array_join("_words", "")).cast("bigint"),
        n_symbols=F.regexp_count("_rare", F.lit(SYMBOLS)).cast("bigint"),
        n_dup_lines=_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        n_repeat_words=repeated_words(F.col("_words")).cast("bigint"),
    )
    failed = (F.col("n_words") < limits.min_words) | (F.col("n_repeat_words") > F.col("n_words") * limits.max_repeated)
    return counted.withColumn("base_failed", failed)


def rare_characters(text: Column) -> Column:
    """A text without lower-case letters and white space: what is left is short and scanned cheaply."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[a-z\x20\x09-\x0D\p{Ll}]+", "")


def class_counts(length: Column, n_space: Column, rare: Column, n_symbols: Column) -> Column:
    """Characters per class: lower, upper, digit, closing mark, space, symbol, other."""
    few = [F.regexp_count(rare, F.lit(pattern)) for pattern in (r"\p{Lu}", r"\p{Nd}", r"[.,;:!?]")]
    counts = F.array(length - n_space - F.length(rare), *few, n_space, n_symbols, length).cast("array<bigint>")
    return _let(counts, lambda c: F.transform(c, lambda x, i: F.when(i < 6, x).otherwise(2 * x - _total(c))))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda x, y: x + y)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, each adding up to 1."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)))


def lacks_common(rest: Column, ref_rest: Column, n_words: Column, limits: QualityLimits) -> Column:
    """Whether a text has too few common words; both arguments are shares of all other words."""
    usual = 1 - ref_rest
    here = js_distance(F.array(1 - rest, rest), F.array(usual, ref_rest))
    none = js_distance(F.array(F.lit(0.0), F.lit(1.0)), F.array(usual, ref_rest))
    shortfall = n_words * (rest - ref_rest)
    return (here > none * limits.max_common_lack) & (shortfall > limits.min_deviations * F.sqrt(n_words * usual * ref_rest))


def shares(counts: Column) -> Column:
    return _let(counts, lambda known: _let(_total(known), lambda t: F.transform(known, lambda c: c / F.greatest(t, F.lit(1)))))


def language_references(docs: DataFrame, limits: QualityLimits = QualityLimits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(_lang, class_ref, common, word_ref) over all documents of at least `min_words` words."""
    worded = computed(docs.select(language_key(F.col(lang)).alias("_lang"), F.col(text).alias("text")), _words=words_of(F.col("text")))
    judged = worded.where(F.size("_words") >= limits.min_words)
    spaces = F.length("text") - F.length(F.array_join("_words", ""))
    scanned = computed(judged.withColumn("_spaces", spaces), _rare=rare_characters(F.col("text")))
    symbols = F.regexp_count(F.col("_rare"), F.lit(SYMBOLS))
    classes = computed(scanned, _c=class_counts(F.length("text"), F.col("_spaces"), F.col("_rare"), symbols)).groupBy("_lang")
    classes = written(classes.agg(F.array(*[F.sum(F.col("_c")[i]) for i in range(CLASSES)]).alias("class_counts")), "class-counts")
    words = judged.select("_lang", F.explode("_words").alias("word"))
    counts = written(words.groupBy("_lang", "word").agg(F.count("*").alias("n")), "word-counts")
    totals = counts.groupBy("_lang").agg(F.sum("n").alias("total"))
    # row_number under a limit keeps a few rows per task before anything is shuffled.
    place = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("n"), "word"))
    ranked = counts.withColumn("place", place).where(F.col("place") <= limits.common_words)
    common = ranked.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    joined = classes.join(common, "_lang").join(totals, "_lang")
    rest = F.col("total") - F.aggregate("top", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    word_counts = F.array_append(F.transform("top", lambda x: x["n"]), rest)
    return joined.select("_lang", shares(F.col("class_counts")).alias("class_ref"), F.transform("top", lambda x: x["word"]).alias("common"), shares(word_counts).alias("word_ref"))


def language_key(lang: Column) -> Column:
    """A key to join on; null is a language of its own."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("null"))


def common_counts(words: Column, common: Column, most: int) -> Column:
    """How often each of the common words occurs, then all other words together.

    Words too long to be common are passed over; every other one becomes one character,
    its place among the common words, so that counting a word is counting a character.
    """
    codes = "".join(chr(0x100 + i) for i in range(most + 1))
    longest = F.array_max(F.transform(common, lambda c: F.octet_length(c)))
    short = _let(longest, lambda most_bytes: F.filter(words, lambda w: F.octet_length(w) <= most_bytes))
    coded = F.array_join(F.transform(short, lambda w: F.substring(F.lit(codes), F.array_position(common, w).cast("int") + 1, F.lit(1))), "")

    def counted(s: Column) -> Column:
        each = [F.length(s) - F.length(F.replace(s, F.lit(c), F.lit(""))) for c in codes[1:]]
        present = F.slice(F.array(*each), F.lit(1), F.size(common)).cast("array<bigint>")
        return _let(present, lambda p: F.array_append(p, F.size(words) - _total(p)))

    return _let(coded, counted)


def judge_quality(docs: DataFrame, limits: QualityLimits = QualityLimits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with the base columns, class_distance, word_distance and kept."""
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    plain = docs.drop(*results, "_words", "_rare", "_lang", "class_ref", "common", "word_ref")
    references = language_references(plain, limits, text, lang)
    based = base_columns(plain, limits, text).withColumn("_lang", language_key(F.col(lang)))
    joined = join_summary(based, references, ["_lang"], "left")
    judged = F.col("n_words") >= limits.min_words
    spaces = F.length(text) - F.col("word_chars")
    histograms = computed(
        joined,
        _classes=F.when(judged, shares(class_counts(F.length(text), spaces, F.col("_rare"), F.col("n_symbols")))),
        _common=F.when(judged, shares(common_counts(F.col("_words"), F.col("common"), limits.common_words))),
    )
    measured = computed(
        histograms,
        class_distance=js_distance(F.col("_classes"), F.col("class_ref")),
        word_distance=js_distance(F.col("_common"), F.col("word_ref")),
        _lacking=lacks_common(F.element_at("_common", -1), F.element_at("word_ref", -1), F.col("n_words"), limits),
    )
    near = (F.col("class_distance") <= limits.max_class_distance) & (
        (F.col("n_words") < limits.min_common_words) | ((F.col("word_distance") <= limits.max_word_distance) & ~F.col("_lacking"))
    )
    verdict = F.when(F.col("base_failed"), False).otherwise(F.coalesce(near, F.lit(False)))
    return measured.withColumn("kept", verdict).select(*plain.columns, *results)
