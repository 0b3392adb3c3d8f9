"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation.

1. classes     Documents with one shingle set are one class, known by a hash of the set.
               Classes are formed by a grouped minimum, so copies collapse before the shuffle.
2. bands       256 MinHash samples per class, of which 128 are cut into 32 bands of 4.  A pair
               of similarity 0.75 shares no band with a probability of 5e-6.
3. odd sketch  The samples are folded into 1024 parity bits: sample i flips one bit.  The
               exclusive or of two sketches has about m/2 (1 - exp(-4k(1-J)/m)) bits set,
               which gives J closely where it is high.  Pairs estimated at less than
               `min_estimate` (3.5 standard errors under the threshold) end here, as do pairs
               whose set sizes alone rule the threshold out.
4. confirm     100 |A and B| >= threshold |A or B| on the full shingle sets.
5. components  Connected classes over the confirmed links, and the smallest id in each.

A band's bucket can hold very many classes.  Its pairs are not written out: in each round a
bucket has one pivot, and every member is confirmed against the closest of its pivots; what
belongs together then has one component, and only pairs of different components are still
open.  After `pivot_rounds` all open pairs are compared, sketches first and then full sets,
inside a join that gives nothing but links, so no link which decides a component is lost.

Shingles are 64-bit hashes of five words (A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`).

Edge cases: a text without words is linked with nothing; one with fewer than five words has
its whole sequence as its only shingle; repeated rows are in one class; texts that differ are
judged apart even if they share an id; rows with a null id take part, but an id is smaller than
none (a component of such rows only has a null id); other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen.llm.graph import components
from mailscreen.llm.words import mix, shingle_sets
from mailscreen.session import sized, written

SKETCH_WORDS = 16


@dataclass(frozen=True)
class NearDupSettings:
    width: int = 5
    threshold: int = 75  # percent
    bands: int = 32
    rows: int = 4
    samples: int = 256
    min_estimate: float = 0.65
    pivot_rounds: int = 2


def min_samples(hashes: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One minimum per key pair; long texts go through in slices."""
    flips, factors = keys
    lowest = np.full(len(flips), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024]
        np.minimum(lowest, ((part[None, :] ^ flips[:, None]) * factors[:, None]).min(axis=1), out=lowest)
    return lowest


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bits (SKETCH_WORDS x 64) of the numbered samples."""
    places = mix(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * SKETCH_WORDS)
    parity = np.bincount(places.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, settings: NearDupSettings, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, k1, k2, b0.., s0..): size, 128-bit hash of the set, bands, odd sketch."""
    names = [f"b{i}" for i in range(settings.bands)] + [f"s{i}" for i in range(SKETCH_WORDS)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(7)
        keys = tuple(random.integers(0, 1 << 63, settings.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(k) for k in (0, 1))
        for batch in batches:
            out = np.zeros((batch.num_rows, 3 + len(names)), dtype=np.uint64)
            for i, hashes in enumerate(shingle_sets(batch.column(1), settings.width)):
                if not len(hashes):
                    continue
                samples = min_samples(hashes, keys)
                bands = mix(samples[: settings.bands * settings.rows].reshape(settings.bands, settings.rows) + np.arange(settings.rows, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                out[i, 0] = len(hashes)
                out[i, 1:3] = hashes.sum(dtype=np.uint64), mix(hashes).sum(dtype=np.uint64)
                out[i, 3 : 3 + settings.bands] = mix(bands + np.arange(settings.bands, dtype=np.uint64))
                out[i, 3 + settings.bands :] = odd_sketch(samples)
            columns = [pa.array(c) for c in np.ascontiguousarray(out.T).view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "text_hash", "n_shingles", "k1", "k2", *names])

    schema = ", ".join(f"{n} long" for n in ["doc_id", "text_hash", "n_shingles", "k1", "k2", *names])
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash")).mapInArrow(sign, schema)


def shingles(docs: DataFrame, settings: NearDupSettings, doc_id: str, text: str) -> DataFrame:
    """(node, shingles): the full sets, as sorted arrays of 64-bit hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = pa.array([h.view(np.int64) for h in shingle_sets(part.column(1), settings.width)], type=kind)
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["node", "shingles"])

    return docs.select(F.col(doc_id).cast("bigint").alias("node"), F.col(text).alias("text")).mapInArrow(sets, "node long, shingles array<long>")


def estimate(samples: int, left: list[Column], right: list[Column]) -> Column:
    """Similarity from two odd sketches; 0 where they are too different to tell."""
    bits = 64 * SKETCH_WORDS
    differ = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(left, right)), F.lit(0))
    inside = 1 - 2 * differ / F.lit(float(bits))
    return F.when(inside > 0, 1 + F.lit(bits / (4 * samples)) * F.log(inside)).otherwise(0.0)


def most_differing(samples: int, least: float) -> int:
    """Bits in which two odd sketches may differ if their estimate is to be `least` or more."""
    bits = 64 * SKETCH_WORDS
    return int(bits / 2 * (1.0 - math.exp(-4.0 * samples / bits * (1.0 - least))))


def overlaps(threshold: int, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """100 |A and B| >= threshold |A or B|, with the intersection (the costly part) computed once."""
    return F.size(F.array_intersect(left, right)) * (100 + threshold) >= threshold * (left_size + right_size)


class _Links:
    """Confirms candidate pairs among the classes."""

    def __init__(self, sketches: DataFrame, sets: DataFrame, settings: NearDupSettings) -> None:
        self.sketches, self.sets, self.settings = sketches, sets, settings
        self.names = [f"s{i}" for i in range(SKETCH_WORDS)]

    def side(self, node: str, prefix: str) -> DataFrame:
        return self.sketches.select(F.col("node").alias(node), *[F.col(n).alias(prefix + n) for n in ["n_shingles", *self.names]])

    def likely(self, prefix_a: str, prefix_b: str) -> Column:
        sizes = [F.col(p + "n_shingles") for p in (prefix_a, prefix_b)]
        possible = F.least(*sizes) * 100 >= F.greatest(*sizes) * self.settings.threshold
        differ = sum((F.bit_count(F.col(prefix_a + n).bitwiseXOR(F.col(prefix_b + n))) for n in self.names), F.lit(0))
        return possible & (differ <= most_differing(self.settings.samples, self.settings.min_estimate))

    def closest(self, pairs: DataFrame) -> DataFrame:
        """For each a the b whose sketch is most like its own, if that is enough."""
        both = pairs.distinct().join(self.side("a", "a_"), "a").join(self.side("b", "b_"), "b").where(self.likely("a_", "b_"))
        likeness = estimate(self.settings.samples, *([F.col(p + n) for n in self.names] for p in ("a_", "b_")))
        best = both.groupBy("a").agg(F.max(F.struct(likeness.alias("j"), F.col("b"))).alias("m")).select("a", F.col("m.b").alias("b"))
        return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def across(self, open_: DataFrame) -> DataFrame:
        """The links between different components that meet in a bucket.

        Sketch and full sets are compared inside the join, so only links come out of it, and
        a pair that shares several bands is compared in the first of them only.
        """
        bands = [f"b{i}" for i in range(self.settings.bands)]
        fat = open_.join(self.sketches, "node").join(self.sets, "node")
        carried = ["node", "component", "n_shingles", "shingles", *bands, *self.names]
        left, right = (fat.select("bucket", *[F.col(c).alias(p + c) for c in carried]) for p in ("a_", "b_"))
        first = F.coalesce(*[F.when(F.col("a_" + b) == F.col("b_" + b), F.col("a_" + b)) for b in bands])
        alike = overlaps(self.settings.threshold, F.col("a_shingles"), F.col("b_shingles"), F.col("a_n_shingles"), F.col("b_n_shingles"))
        # From the cheapest test to the dearest; most pairs end at the sketches.
        apart = (left["bucket"] == right["bucket"]) & (F.col("a_component") < F.col("b_component"))
        found = left.join(right, apart & self.likely("a_", "b_") & (first == left["bucket"]) & alike)
        return written(found.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")), "links")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        left = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        alike = overlaps(self.settings.threshold, F.col("sa"), F.col("sb"), F.size("sa"), F.size("sb"))
        return written(pairs.join(left, "a").join(right, "b").where(alike).select("a", "b"), "links")


def _row_key(doc_id: Column, text_hash: Column) -> Column:
    """64 bits that stand for a row's id and text."""
    return F.xxhash64(F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), text_hash)


def near_duplicates(docs: DataFrame, settings: NearDupSettings = NearDupSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, text_hash, class_id, component_id, kept, stands), one row per row of `docs`.

    `class_id` and `component_id` are the smallest ids in the row's class and component.  `stands`
    marks the rows to keep where one text of each component is wanted: the one with the smallest
    (id, hash of the text), ids before null; a text without words stands for itself.
    """
    signed = written(signatures(docs, settings, doc_id, text), "signatures")
    carried = [f"b{i}" for i in range(settings.bands)] + [f"s{i}" for i in range(SKETCH_WORDS)]
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    # A class is known by its set, not by an id, since several texts may share one.
    classes = signed.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min(row).alias("first"), *[F.first(c).alias(c) for c in carried])
    classes = written(classes.withColumn("node", F.xxhash64("k1", "k2", "n_shingles")), "classes")
    placed = classes.select("node", F.explode(F.array(*[F.col(f"b{i}") for i in range(settings.bands)])).alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = written(placed.join(shared, "bucket"), "buckets")
    # One row of each class gives its set; while their keys are small enough, no text is moved for that.
    held = classes.select("node", _row_key(F.col("first.doc_id"), F.col("first.text_hash")).alias("_row")).join(members.select("node").distinct(), "node", "left_semi")
    given = docs.select(_row_key(F.col(doc_id).cast("bigint"), F.xxhash64(text)).alias("_row"), F.col(text).alias("text"))
    rows = given.join(sized(written(held, "members")), "_row").select("node", "text")
    sets = written(shingles(rows, settings, "node", "text").dropDuplicates(["node"]), "shingles")
    confirm = _Links(classes.select("node", "n_shingles", *carried), sets, settings)

    found = _components(members, confirm, settings)
    told = classes.select("k1", "k2", "n_shingles", "first", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tops = told.groupBy("component").agg(F.min("first").alias("top"))
    told = written(told.join(tops, "component").select("k1", "k2", F.col("n_shingles").alias("_n"), F.col("first.doc_id").alias("class_id"), "top"), "components")
    same = (signed["k1"] == told["k1"]) & (signed["k2"] == told["k2"]) & (signed["n_shingles"] == told["_n"])
    judged = signed.select("doc_id", "n_shingles", "text_hash", "k1", "k2").join(told, same, "left").select("doc_id", "n_shingles", "text_hash", "class_id", "top")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("top.doc_id"))
    stands = (F.col("n_shingles") == 0) | (F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("text_hash") == F.col("top.text_hash")))
    return judged.select(
        "doc_id", "n_shingles", "text_hash", "class_id", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"), stands.alias("stands")
    )


def _components(members: DataFrame, confirm: _Links, settings: NearDupSettings) -> DataFrame:
    """(node, component) over confirmed links that join all classes that belong together."""
    open_, links, found = members.withColumn("component", F.col("node")), None, None
    for number in range(settings.pivot_rounds):
        chosen = F.min(F.struct(F.xxhash64("node", F.lit(number)).alias("h"), F.col("node").alias("pivot"), F.col("component").alias("top")))
        pivots = open_.groupBy("bucket").agg(chosen.alias("p")).select("bucket", "p.pivot", "p.top")
        pairs = open_.join(pivots, "bucket").where("component <> top").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        new = confirm.confirmed(confirm.closest(pairs))
        links = new if links is None else written(links.union(new), "links")
        found = written(components(links), "components")
        open_ = _still_open(members, found)
    more = confirm.across(open_)
    # Mostly the pivots have joined everything, and what is known stands.
    if found is not None and more.isEmpty():
        return found
    return components(more if links is None else links.union(more))


def _still_open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets in which more than one component meets."""
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    return written(placed.join(mixed, "bucket"), "open-buckets")
