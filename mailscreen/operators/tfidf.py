"""Word and character TF-IDF in long form: (id, term, weight).

Vocabularies are counted with the texts partitioned by document, so a document's terms are
counted in place and only the per-term totals are shuffled, after partial aggregation.

Character windows are many times the text, so they are cut from the text's code points as arrays
of places and 64-bit hashes, and only those that are new in a chunk of texts become strings.
Their weights are worked out row by row against a sorted vocabulary of such hashes: counting,
weighing and normalising need no other row, hence no shuffle, join or window.  Words go the same way as
codes of a batch's distinct tokens, where every row has an id of its own; texts whose rows share ids, and
vocabularies beyond `MOST_BYTES`, are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscreen.functions.text import WORD, clean_text
from mailscreen.session import Shared, computed, parallelism, sized, written


# What a vocabulary may take in each task: hash, IDF, number and name of every term.
MOST_BYTES = 512 << 20


def default_stop_words() -> list[str]:
    """Spark's English list; compared as written, so only lower-case tokens are dropped."""
    return sorted(StopWordsRemover.loadDefaultStopWords("english"))


def word_tokens(clean: Column, stop_words: list[str]) -> Column:
    """Runs of two or more word characters, case kept, stop words dropped."""
    tokens = F.regexp_extract_all(clean, F.lit(f"([{WORD}]{{2,}})"), 1)
    return F.filter(tokens, lambda token: ~token.isin(stop_words)) if stop_words else tokens


def with_bigrams(tokens: Column) -> Column:
    """The tokens followed by each pair of neighbours joined by a blank."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    bigrams = F.zip_with(
        F.slice(tokens, F.lit(1), pairs), F.slice(tokens, F.lit(2), pairs), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.concat(tokens, bigrams)


def char_ngrams(word: Column, shortest: int = 3, longest: int = 5) -> Column:
    """All windows of 3, 4 and 5 characters of a word that is padded by one blank on each side."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    windows = [F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{n}}}))."), 1) for n in range(shortest, longest + 1)]
    return F.concat(*windows)


@dataclass(frozen=True)
class TermSettings:
    """Which terms are taken from a text and which of them make the vocabulary."""

    analyzer: str  # "word" or "char_wb"
    max_features: int | None = None
    min_df: int = 2
    max_df: float = 1.0

    @property
    def prefix(self) -> str:
        return "word_tfidf__" if self.analyzer == "word" else "char_tfidf__"


def word_settings(max_features: int | None = None) -> TermSettings:
    return TermSettings("word", max_features, min_df=2, max_df=0.98)


def char_settings(max_features: int | None = None) -> TermSettings:
    return TermSettings("char_wb", max_features, min_df=2)


def text_terms(clean: Column, settings: TermSettings, stop_words: list[str]) -> Column:
    """All terms of a cleaned text as one array, in order and with repetitions."""
    if settings.analyzer == "word":
        return with_bigrams(word_tokens(clean, stop_words))
    words = F.filter(F.split(clean, " "), lambda word: word != "")
    return F.flatten(F.transform(words, lambda word: char_ngrams(word)))


# Code points whose windows a task cuts at once (one text more, if it is longer).
CHUNK = 1 << 20
_PRIMES = tuple(np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _hashed(points: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """64 bits for each `n` code points (as uint64) from `start` on, mixed after every two of them."""
    keys = np.full(len(start), n, dtype=np.uint64)
    for k in range(0, n, 2):
        pair = points[start + k] << np.uint64(21)
        if k + 1 < n:
            pair |= points[start + k + 1]
        keys = _mixed((keys ^ pair) + _PRIMES[0])
    return keys.view(np.int64)


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(30))) * _PRIMES[1]
    keys = (keys ^ (keys >> np.uint64(27))) * _PRIMES[2]
    return keys ^ (keys >> np.uint64(31))


@dataclass(frozen=True)
class Windows:
    """The character windows of some texts: row, place in the padded code points, length and hash of each."""

    points: np.ndarray
    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    hashes: np.ndarray

    def terms(self, at: np.ndarray) -> list[str]:
        return [self.points[i : i + n].tobytes().decode("utf-32-le", "surrogatepass") for i, n in zip(self.start[at].tolist(), self.length[at].tolist())]


def char_windows(texts: list[str], shortest: int = 3, longest: int = 5) -> Windows:
    """What `char_ngrams` cuts from every word of cleaned texts, for all of them at once.

    With a blank around each text, a window that has no blank but at its ends is one of a
    padded word.
    """
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    wide, letter = points.astype(np.uint64), points != 32
    pieces = []
    for n in range(shortest, longest + 1):
        many = max(len(points) - n + 1, 0)
        inside = np.ones(many, dtype=bool)
        for k in range(1, n - 1):
            inside &= letter[k : k + many]
        start = np.flatnonzero(inside)
        pieces.append((owner[start], start, np.full(len(start), n, dtype=np.int8), _hashed(wide, start, n)))
    return Windows(points, *(np.concatenate(p) for p in zip(*pieces)))


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of at most `most` characters; a longer text is a run of its own."""
    first, held, size = 0, [], 0
    for at, text in enumerate(texts.to_pylist()):
        text = text or ""
        if held and size + len(text) > most:
            yield first, held
            first, held, size = at, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


@dataclass(frozen=True)
class Words:
    """The words and pairs of neighbours of some texts: row, hash, and numbers of the first and second token (-1: none)."""

    tokens: pa.Array
    row: np.ndarray
    first: np.ndarray
    second: np.ndarray
    hashes: np.ndarray

    def terms(self, at: np.ndarray) -> pa.Array:
        second = self.second[at]
        alone = second < 0
        head = self.tokens.take(pa.array(self.first[at]))
        pairs = pc.binary_join_element_wise(head, self.tokens.take(pa.array(second, mask=alone)), " ", null_handling="skip")
        return pc.if_else(pa.array(alone), head, pairs)


def words_of(lists: pa.ListArray, stop_words: list[str]) -> Words:
    """What `with_bigrams` makes of the tokens of each row once stop words are dropped, for all rows at once."""
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    tokens, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    told = ~pc.is_in(tokens, value_set=pa.array(stop_words, tokens.type)).to_numpy(zero_copy_only=False)
    kept = told[code]
    row, code = row[kept], code[kept]
    left = np.flatnonzero(row[1:] == row[:-1])
    alone = _hashed_texts(tokens)
    first = np.concatenate([code, code[left]])
    second = np.concatenate([np.full(len(code), -1), code[left + 1]])
    return Words(tokens, np.concatenate([row, row[left]]), first, second, np.concatenate([alone[code], _paired(alone[code[left]], alone[code[left + 1]])]))


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(first.view(np.uint64) + _PRIMES[0]) ^ second.view(np.uint64)).view(np.int64)


def word_hash(terms: pa.Array) -> np.ndarray:
    """The hash that words and pairs of the given names have."""
    halves = pc.split_pattern(terms, " ", max_splits=1)
    if not len(terms):
        return np.zeros(0, dtype=np.int64)
    # Tokens are far fewer than pairs of them.
    coded = halves.flatten().dictionary_encode()
    hashes = _hashed_texts(coded.dictionary)[coded.indices.to_numpy()]
    sizes = pc.list_value_length(halves).to_numpy()
    first = np.cumsum(sizes) - sizes
    return np.where(sizes > 1, _paired(hashes[first], hashes[first + sizes - 1]), hashes[first])


def token_chunks(lists: pa.ListArray, most: int = CHUNK // 2) -> Iterator[tuple[int, pa.ListArray]]:
    """(first row, rows) of runs of at most `most` tokens; a row with more is a run of its own."""
    ends, first = lists.offsets.to_numpy(), 0
    while first < len(lists):
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, lists.slice(first, end - first)
        first = end


def cut_texts(column: pa.Array, settings: "TermSettings", stop_words: list[str]) -> Iterator[tuple[int, int, "Windows | Words"]]:
    """(first row, rows, terms) of a batch of `cut_input`, a chunk at a time."""
    if settings.analyzer == "word":
        yield from ((first, len(some), words_of(some, stop_words)) for first, some in token_chunks(column))
    else:
        yield from ((first, len(some), char_windows(some)) for first, some in chunks(column))


def cut_input(settings: "TermSettings") -> Column:
    """What a task cuts terms from: all tokens, or the cleaned text."""
    return F.coalesce(word_tokens(F.col("_clean"), []), F.array().cast("array<string>")) if settings.analyzer == "word" else F.col("_clean")


def row_frequencies(clean: DataFrame, settings: "TermSettings", stop_words: list[str]) -> DataFrame:
    """(term, df, cf) of `_clean`, every row a document.

    A task counts a chunk of texts at a time and hands on one row for each of its terms.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, cut in cut_texts(batch.column(0), settings, stop_words):
                first, df, cf = counted(cut)
                names = cut.terms(first)
                yield pa.RecordBatch.from_arrays([names if isinstance(names, pa.Array) else pa.array(names, pa.string()), pa.array(df, pa.int64()), pa.array(cf, pa.int64())], names=["term", "df", "cf"])

    found = clean.select(cut_input(settings).alias("_cut")).mapInArrow(count, "term string, df long, cf long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def counted(cut: "Windows | Words") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first, rows that have it, how often) of each term, in the order of their hashes.

    Terms of one hash are all words, all pairs or all of one length, and each of these kinds comes row
    by row, so one stable sort by hash also brings a term's rows together.
    """
    order = np.argsort(cut.hashes, kind="stable")
    hashes, row = cut.hashes[order], cut.row[order]
    head = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(order)]
    start = np.flatnonzero(head)
    if not len(start):
        return start, start, start
    head[1:] |= row[1:] != row[:-1]
    return order[start], np.add.reduceat(head, start, dtype=np.int64), np.diff(start, append=len(order))


def char_frequencies(clean: DataFrame) -> DataFrame:
    """`row_frequencies` of the character windows."""
    return row_frequencies(clean, char_settings(), [])


def hash_of(terms: pa.Array) -> np.ndarray:
    """The hash that character windows of the given names have."""
    return _hashed_texts(terms)


def _hashed_texts(terms: pa.Array) -> np.ndarray:
    texts = terms.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(length) - length
    keys = np.empty(len(texts), dtype=np.int64)
    for n in np.unique(length).tolist():
        here = length == n
        keys[here] = _hashed(points, start[here], n)
    return keys


def hash_column(term: str, settings: "TermSettings") -> Column:
    """The hashes that tasks cut terms to, of a column of their names."""
    hashed = word_hash if settings.analyzer == "word" else hash_of

    @F.arrow_udf("bigint")
    def run(terms: pa.Array) -> pa.Array:
        return pa.array(hashed(terms), pa.int64())

    return run(term)


def term_counts(
    df: DataFrame, id_column: str, text: str, settings: TermSettings, stop_words: list[str] | None = None, preprocess=clean_text
) -> DataFrame:
    """(id, term, tf).  `preprocess` is the text -> text Column function applied first."""
    return clean_term_counts(cleaned(df, id_column, text, preprocess), id_column, settings, stop_words)


def cleaned(df: DataFrame, id_column: str, text: str, preprocess=clean_text) -> DataFrame:
    """(id, _clean): the texts that terms are taken from."""
    return computed(df.select(id_column, F.col(text).alias("_raw")), _clean=preprocess("_raw")).select(id_column, "_clean")


def clean_term_counts(clean: DataFrame, id_column: str, settings: TermSettings, stop_words: list[str] | None = None) -> DataFrame:
    """(id, term, tf) of texts from `cleaned`."""
    by_document = clean.repartition(parallelism(clean.sparkSession), id_column)
    if settings.analyzer == "word":
        words = default_stop_words() if stop_words is None else stop_words
        tokens = by_document.select(id_column, word_tokens(F.col("_clean"), words).alias("_tokens"))
        terms = tokens.select(id_column, F.explode(with_bigrams(F.col("_tokens"))).alias("term"))
        return terms.groupBy(id_column, "term").agg(F.count("*").alias("tf"))
    # A word that comes up again in its document is cut into n-grams only once.
    words = by_document.select(id_column, F.explode(F.split("_clean", " ")).alias("_word")).filter(F.col("_word") != "")
    counted = words.groupBy(id_column, "_word").agg(F.count("*").alias("_n"))
    terms = counted.select(id_column, "_n", F.explode(char_ngrams(F.col("_word"))).alias("term"))
    return terms.groupBy(id_column, "term").agg(F.sum("_n").alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(term, df, cf): documents that have the term, and its total count."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def most_frequent(terms: DataFrame, n: int) -> DataFrame:
    """The `n` terms with the highest `cf`, ties by term.

    A histogram of `cf` in sixteenths of an octave says from which count on terms can be
    among the first `n`; only those enter the sort.
    """
    level = F.floor(F.log2(F.col("cf").cast("double")) * 16)
    histogram = terms.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    lowest, seen = None, 0
    for row in sorted(histogram, key=lambda r: -r["level"]):
        lowest, seen = row["level"], seen + row["n"]
        if seen >= n:
            break
    if lowest is None or seen <= n:
        return terms
    return terms.filter(level >= lowest).orderBy(F.desc("cf"), "term").limit(n)


def frequencies(clean: DataFrame, id_column: str, settings: TermSettings, stop_words: list[str] | None = None) -> DataFrame:
    """(term, df, cf) of texts from `cleaned`, one row a document."""
    words = default_stop_words() if stop_words is None else stop_words
    if settings.analyzer != "word" or own_ids(clean, id_column):
        return row_frequencies(clean, settings, words)
    return document_frequencies(clean_term_counts(clean, id_column, settings, stop_words))


def own_ids(clean: DataFrame, id_column: str) -> bool:
    """Whether no two rows share an id: each row is a document then."""
    return clean.groupBy(id_column).count().where("count > 1").isEmpty()


def fit_vocabulary(counts: DataFrame, documents: int, settings: TermSettings) -> DataFrame:
    """(term, df, cf, idf): the terms that qualify, or the most frequent `max_features` of them.

    `counts` are those of `term_counts`, or already `frequencies`.
    """
    totals = counts if "df" in counts.columns else document_frequencies(counts)
    terms = totals.filter((F.col("df") >= settings.min_df) & (F.col("df") <= settings.max_df * documents))
    kept = terms if settings.max_features is None else most_frequent(written(terms, "terms"), settings.max_features)
    idf = F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0
    return written(kept.withColumn("idf", idf), "vocabulary")


def weigh(counts: DataFrame, id_column: str, vocabulary: DataFrame) -> DataFrame:
    """(id, term, weight): (1 + ln tf) * idf, each document scaled to length 1.

    The vocabulary is broadcast if it is small enough.
    """
    known = counts.join(sized(vocabulary.select("term", "idf")), "term")
    raw = known.select(id_column, "term", ((1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("_w"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_column)))
    return raw.select(id_column, "term", (F.col("_w") / length).alias("weight"))


@dataclass(frozen=True)
class TermTable:
    """A block's vocabulary: sorted hashes, and IDF and feature number of each."""

    hashes: np.ndarray
    idf: np.ndarray
    index: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, idf: np.ndarray, index: np.ndarray) -> "TermTable":
        order = np.argsort(hashes, kind="stable")
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two terms of the vocabulary share a 64-bit hash")
        return cls(hashes[order], idf[order], index[order].astype(np.int32))

    def rows(self, terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, weight) of a batch: (1 + ln tf) * idf, every row scaled to length 1."""
        offsets = terms.offsets.to_numpy()
        flat = terms.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        if not len(self.hashes) or not len(flat):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
        return self.weighed(np.repeat(np.arange(len(terms)), np.diff(offsets)), flat, len(terms))

    def text_rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`rows` of the character windows of cleaned texts."""
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))]
        if len(self.hashes):
            for first, some in chunks(texts):
                cut = char_windows(some)
                row, feature, weight = self.weighed(cut.row, cut.hashes, len(some))
                parts.append((row + first, feature, weight))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def weighed(self, row: np.ndarray, flat: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What `rows` gives for term hashes `flat` of the rows `row`."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
        # Looked up in ascending order, neighbours find the same part of the table still in the processor's cache.
        order = np.argsort(flat)
        place = np.empty(len(flat), dtype=np.int64)
        place[order] = np.minimum(np.searchsorted(self.hashes, flat[order]), len(self.hashes) - 1)
        known = self.hashes[place] == flat
        keys, counts = np.unique(row[known] * len(self.hashes) + place[known], return_counts=True)
        row, place = keys // len(self.hashes), keys % len(self.hashes)
        weight = (1.0 + np.log(counts)) * self.idf[place]
        length = np.sqrt(np.bincount(row, weight * weight, minlength=rows))
        return row, self.index[place], weight / length[row]


def weigh_rows(
    clean: DataFrame, id_column: str, vocabulary: DataFrame, settings: TermSettings, most_bytes: int = MOST_BYTES, stop_words: list[str] | None = None
) -> DataFrame | None:
    """(id, term, weight) of texts from `cleaned`, row by row; None where the vocabulary is too large for that."""
    if (vocabulary.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0) > most_bytes:
        return None
    words = default_stop_words() if stop_words is None else stop_words
    known = vocabulary.select("idf", "term", hash_column("term", settings).alias("hash")).toArrow()
    idf, terms, hashes = known.column(0).to_numpy(), known.column(1).combine_chunks(), known.column(2).to_numpy()
    shared = Shared(clean.sparkSession, (TermTable.of(hashes, idf, np.arange(len(idf))), terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, names = shared.value
        for batch in batches:
            for first, rows, cut in cut_texts(batch.column(1), settings, words):
                row, place, weight = fitted.weighed(cut.row, cut.hashes, rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), names.take(pa.array(place)), pa.array(weight)], names=[id_column, "term", "weight"])

    kind = clean.schema[id_column].dataType.simpleString()
    return clean.select(id_column, cut_input(settings).alias("_cut")).mapInArrow(run, f"`{id_column}` {kind}, term string, weight double")


def tfidf(
    df: DataFrame, id_column: str, text: str, settings: TermSettings, stop_words: list[str] | None = None, preprocess=clean_text
) -> DataFrame:
    """Fit the vocabulary on `df` and weigh the same rows.  Texts are cleaned once, and laid out by document."""
    clean = written(cleaned(df, id_column, text, preprocess), "clean")
    words = default_stop_words() if stop_words is None else stop_words
    vocabulary = fit_vocabulary(frequencies(clean, id_column, settings, words), clean.count(), settings)
    return weights_of(clean, id_column, vocabulary, settings, words)


def weights_of(clean: DataFrame, id_column: str, vocabulary: DataFrame, settings: TermSettings, words: list[str]) -> DataFrame:
    """(id, term, weight) of texts from `cleaned`: row by row where that gives the weights of documents, else joined."""
    by_row = weigh_rows(clean, id_column, vocabulary, settings, stop_words=words) if settings.analyzer != "word" or own_ids(clean, id_column) else None
    return weigh(clean_term_counts(clean, id_column, settings, words), id_column, vocabulary) if by_row is None else by_row
