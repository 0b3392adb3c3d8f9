"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams (1 to 3 code points, A-Z and other letters
in lower case, everything that is no letter as one gap), weighted by TF-IDF, of unit length.
Per language, spherical k-means makes several centroids of the training texts; a text gets
the language of the centroid with the largest cosine.

Rejection goes by distance: for every language the smallest cosine among (all but the
outermost `outliers` share of) its training texts is noted, and a text further away than
`slack` times that is `rejected`.  Its nearest language is reported all the same.

Training reads all labelled texts of a language with up to `max_training` of them, and of
others about so many (those whose hash lies under a cut-off: a uniform sample that does not
depend on the layout), so a rare language is never lost to the common ones.  Their n-gram counts
lie in the shared folder as sparse rows.  Document frequencies, every round of k-means (sums per
language and centroid) and the cosines to note are computed in tasks over those rows and added
up there; the driver holds the centroids, never a vector of a text but the first ones.  All
texts are classified whole.  The model (dimensions x centroids) is of fixed size.

Edge cases: a null text or one without letters is `und`, score 0, rejected; texts without a
label are not trained on; with no training texts everything is `und`; ties between
centroids go to the language first in order; columns named like the results are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscreen.session import written

UNKNOWN = "und"


@dataclass(frozen=True)
class LangSettings:
    dimensions: int = 1 << 13
    centroids: int = 4
    rounds: int = 10
    max_training: int = 5_000
    outliers: float = 0.002
    slack: float = 0.75


@dataclass(frozen=True)
class LangModel:
    """Unit centroids (one per row), their languages, IDF weights, and each language's least cosine."""

    languages: list[str]
    centroids: np.ndarray
    weights: np.ndarray
    least: dict[str, float]

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        counts = ngram_counts(text, len(self.weights))
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        vector = weighted(counts, self.weights)
        cosines = self.centroids @ vector
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        language = self.languages[best]
        return language, score, score < self.least[language]


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or 0 where it is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            table[code] = ord(low[0])
    return table


def ngram_counts(text: str | None, dimensions: int, piece: int = 1 << 18) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams; None for a text without letters.  Long texts go in pieces."""
    if not text:
        return None
    table = _letters()
    counts = np.zeros(dimensions)
    tail = np.zeros(2, dtype=np.uint32)
    some = False
    for at in range(0, len(text), piece):
        raw = table[np.frombuffer(text[at : at + piece].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        some = some or bool(raw.any())
        codes = np.concatenate((tail, raw))
        # Runs of other characters are one gap.
        gap = codes == 0
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        keep[:2] = True
        codes = codes[keep].astype(np.uint64)
        one = codes * np.uint64(0x9E3779B1)
        two = one[1:] + codes[:-1] * np.uint64(0x85EBCA6B)
        three = two[1:] + codes[:-2] * np.uint64(0xC2B2AE35)
        mask = np.uint64(dimensions - 1)
        for salt, grams in ((1, one[2:]), (2, two[1:]), (3, three)):
            mixed = (grams + np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
            counts += np.bincount(((mixed >> np.uint64(40)) & mask).astype(np.int64), minlength=dimensions)
        tail = codes[-2:].astype(np.uint32)
    return counts if some else None


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector: square roots of counts, so that length matters less."""
    vector = np.sqrt(counts) * weights
    norm = np.linalg.norm(vector)
    return vector / norm if norm else vector


_SPARSE = "lang string, h long, places binary, counts binary"
_CLUSTERS = "lang string, sums binary, sizes binary"


def _unit_rows(places: list[bytes], counts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Stored sparse counts as dense unit TF-IDF vectors, one per row."""
    vectors = np.zeros((len(places), len(weights)), dtype=np.float32)
    for row, (p, c) in enumerate(zip(places, counts)):
        vectors[row, np.frombuffer(p, dtype=np.int32)] = np.sqrt(np.frombuffer(c, dtype=np.int64))
    vectors *= weights
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return vectors


def _by_language(frames: Iterator[pd.DataFrame], weights: np.ndarray, piece: int = 512) -> Iterator[tuple[str, np.ndarray]]:
    """(language, unit vectors) for slices of the stored rows."""
    for pdf in frames:
        for lang, own in pdf.groupby("lang"):
            for at in range(0, len(own), piece):
                part = own.iloc[at : at + piece]
                yield lang, _unit_rows(part["places"].tolist(), part["counts"].tolist(), weights)


def _moved(stored: DataFrame, centres: dict[str, np.ndarray], weights: np.ndarray) -> dict[str, np.ndarray]:
    """One round of spherical k-means in all languages: the sums are made and added up in tasks."""
    shared = stored.sparkSession.sparkContext.broadcast((centres, weights))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, idf = shared.value
        total: dict[str, list[np.ndarray]] = {}
        for lang, vectors in _by_language(frames, idf):
            nearest = np.argmax(vectors @ known[lang].T, axis=1)
            member = np.zeros((len(known[lang]), len(vectors)), dtype=np.float32)
            member[nearest, np.arange(len(vectors))] = 1.0
            found = [(member @ vectors).astype(np.float64), member.sum(axis=1).astype(np.float64)]
            total[lang] = [a + b for a, b in zip(total[lang], found)] if lang in total else found
        for lang, (summed, sizes) in total.items():
            yield pd.DataFrame({"lang": [lang], "sums": [summed.tobytes()], "sizes": [sizes.tobytes()]})

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list[np.ndarray]] = {}
        for pdf in frames:
            for lang, *found in pdf.itertuples(index=False):
                found = [np.frombuffer(f) for f in found]
                total[lang] = [a + b for a, b in zip(total[lang], found)] if lang in total else found
        for lang, (summed, sizes) in total.items():
            yield pd.DataFrame({"lang": [lang], "sums": [summed.tobytes()], "sizes": [sizes.tobytes()]})

    moved = {}
    for row in stored.mapInPandas(sums, _CLUSTERS).repartition("lang").mapInPandas(added, _CLUSTERS).collect():
        centre = centres[row["lang"]]
        summed, sizes = np.frombuffer(row["sums"]).reshape(centre.shape), np.frombuffer(row["sizes"])
        new = np.where(sizes[:, None] > 0, summed, centre)
        moved[row["lang"]] = (new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    shared.unpersist()
    return centres | moved


def _least_cosines(stored: DataFrame, centres: dict[str, np.ndarray], weights: np.ndarray, outliers: float) -> dict[str, float]:
    """For each language the smallest cosine of its texts, the outermost `outliers` share left out."""
    shared = stored.sparkSession.sparkContext.broadcast((centres, weights))

    def cosines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, idf = shared.value
        for lang, vectors in _by_language(frames, idf):
            yield pd.DataFrame({"lang": lang, "cosine": (vectors @ known[lang].T).max(axis=1).astype(float)})

    # Settings bound a language's texts, so its cosines are a short list.
    ordered = stored.mapInPandas(cosines, "lang string, cosine double").groupBy("lang").agg(F.sort_array(F.collect_list("cosine")).alias("c"))
    place = F.floor(F.lit(outliers) * F.size("c")).cast("int")
    return {r["lang"]: r["least"] for r in ordered.select("lang", F.get("c", place).alias("least")).collect()}


def train_languages(labelled: DataFrame, settings: LangSettings = LangSettings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LangModel:
    """A model from rows with a label; about `max_training` of a language at most."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("_h"))
    totals = rows.groupBy("lang").count().collect()
    spark = labelled.sparkSession
    # A uniform hash is under the cut-off with probability max_training / rows of the language.
    cuts = [(r["lang"], min((1 << 63) - 1, (1 << 64) * settings.max_training // r["count"] - (1 << 63))) for r in totals]
    picked = rows.join(F.broadcast(spark.createDataFrame(cuts, "lang string, _cut long")), "lang").where("_h <= _cut")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for name, h, body in zip(pdf["lang"], pdf["_h"], pdf["text"]):
                counts = ngram_counts(body, settings.dimensions)
                if counts is not None:
                    places = np.flatnonzero(counts)
                    found.append((name, h, places.astype(np.int32).tobytes(), counts[places].astype(np.int64).tobytes()))
            yield pd.DataFrame(found, columns=["lang", "h", "places", "counts"])

    def frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(settings.dimensions, dtype=np.int64), 0
        for pdf in frames:
            for places in pdf["places"]:
                total[np.frombuffer(places, dtype=np.int32)] += 1
            n += len(pdf)
        yield pd.DataFrame({"n": [n], "present": [total.tobytes()]})

    stored = written(picked.select("lang", "text", "_h").repartition("_h").mapInPandas(counted, _SPARSE), "lang-counts")
    sums = stored.select("places").mapInPandas(frequencies, "n long, present binary").collect()
    trained = sum(r["n"] for r in sums)
    if not trained:
        return LangModel([], np.zeros((0, settings.dimensions)), np.ones(settings.dimensions), {})
    present = sum(np.frombuffer(r["present"], dtype=np.int64) for r in sums)
    weights = (np.log((1 + trained) / (1 + present)) + 1).astype(np.float32)
    # The texts with the smallest hashes are a random choice to start from.
    first = Window.partitionBy("lang").orderBy("h", "counts")
    starts: dict[str, list] = {}
    for row in stored.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= settings.centroids).orderBy("lang", "_n").collect():
        starts.setdefault(row["lang"], []).append((row["places"], row["counts"]))
    centres = {name: _unit_rows(*zip(*given), weights) for name, given in starts.items()}
    for _ in range(settings.rounds):
        moved = _moved(stored, centres, weights)
        done = all(np.allclose(moved[name], centres[name], atol=1e-6) for name in centres)
        centres = moved
        if done:
            break
    least = _least_cosines(stored, centres, weights, settings.outliers)
    names = sorted(centres)
    languages = [name for name in names for _ in centres[name]]
    return LangModel(languages, np.concatenate([centres[n] for n in names]), weights, {n: settings.slack * least[n] for n in names})


def identify(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (cosine, 0 to 1) and rejected.  Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.classify(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    kept = docs.drop("lang_pred", "score", "rejected", "_p")
    return kept.withColumn("_p", predict(F.col(text))).select(*kept.columns, "_p.*")


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
