"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

1. bin       The distinct five-word shingles of a text are hashed once, to 64 bits.  The upper
             bits name one of `bins` bins; a bin's minimum is its smallest hash.  Sorted hashes
             have every minimum at the first place of its bin, which a binary search finds.
2. densify   An empty bin borrows from the bin that a hash of (bin, attempt) names, at the
             first attempt that meets a full one.  The choice depends on the bin alone, so two
             sets borrow alike, and every empty bin chooses for itself (least variance).
3. pack      The `bits` lowest bits of each minimum are kept, packed, as hex digits: with 512
             bins of 4 bits, one digit a bin.
4. compare   Bins agree by chance once in 2^bits; with m the share of bins that agree, the
             similarity is (m - c) / (1 - c), c = 2^-bits, within 0 and 1.

The standard error at similarity J is about sqrt(J (1 - J) / n), n the smaller of bins and
shingles, plus what chance agreement adds.

Edge cases: a null text is empty; a text without words has no shingles, its fingerprint is
empty, and it is like other such texts (1) and unlike all others (0); a text with fewer than
five words has its whole sequence as its only shingle; equal texts have equal fingerprints;
columns named like a result are replaced, other columns stay; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscreen.llm.words import mix, shingle_sets
from mailscreen.session import parallelism


@dataclass(frozen=True)
class FingerprintSettings:
    width: int = 5
    bins: int = 512  # a power of 2
    bits: int = 4  # 1, 2, 4 or 8 of each bin's minimum


_ATTEMPTS = 32


@lru_cache(256)
def _lenders(bins: int, block: int) -> np.ndarray:
    """(bins, _ATTEMPTS): the bins that each bin asks in attempts block * _ATTEMPTS and up."""
    attempts = np.arange(block * _ATTEMPTS, (block + 1) * _ATTEMPTS, dtype=np.uint64)
    places = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + attempts[None, :] * np.uint64(0xD1B54A32D192ED03)
    return (mix(places + np.uint64(1)) % np.uint64(bins)).astype(np.int64)


def densified(full: np.ndarray, most_blocks: int = 64) -> np.ndarray:
    """For each bin the bin its value is taken from; `full` has at least one true.

    After most_blocks * _ATTEMPTS attempts (never, but for sets of a few shingles) the next full bin
    to the right lends.
    """
    source = np.arange(len(full))
    empty = np.flatnonzero(~full)
    for block in range(most_blocks):
        if not len(empty):
            return source
        asked = _lenders(len(full), block)[empty]
        answers = full[asked]
        met = answers.any(axis=1)
        source[empty[met]] = asked[met, answers[met].argmax(axis=1)]
        empty = empty[~met]
    filled = np.flatnonzero(full)
    source[empty] = filled[np.searchsorted(filled, empty) % len(filled)]
    return source


def pack(hashes: np.ndarray, settings: FingerprintSettings) -> str:
    """The fingerprint of sorted distinct 64-bit shingle hashes."""
    if not len(hashes):
        return ""
    shift = np.uint64(64 - (settings.bins.bit_length() - 1))
    starts = np.arange(settings.bins, dtype=np.uint64) << shift
    at = np.searchsorted(hashes, starts)
    lowest = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & (lowest >> shift == np.arange(settings.bins, dtype=np.uint64))
    kept = (lowest & np.uint64((1 << settings.bits) - 1)).astype(np.uint8)[densified(full)]
    bits = np.unpackbits(kept[:, None], axis=1)[:, 8 - settings.bits :]
    return np.packbits(bits).tobytes().hex()


def unpack(fingerprints: list[str], settings: FingerprintSettings) -> np.ndarray:
    """(fingerprints, bins): the kept bits of each bin; all fingerprints have some."""
    packed = np.frombuffer(bytes.fromhex("".join(fingerprints)), dtype=np.uint8).reshape(len(fingerprints), -1)
    bits = np.unpackbits(packed, axis=1).reshape(len(fingerprints), settings.bins, settings.bits)
    return np.packbits(bits, axis=2)[:, :, 0] >> (8 - settings.bits)


def alike(left: list[str], right: list[str], settings: FingerprintSettings) -> np.ndarray:
    """Estimated similarity of each pair."""
    out = np.array([float(a == b) for a, b in zip(left, right)])
    open_ = [i for i, (a, b) in enumerate(zip(left, right)) if a and b and a != b]
    chance = 2.0**-settings.bits
    for at in range(0, len(open_), 4096):
        part = open_[at : at + 4096]
        share = (unpack([left[i] for i in part], settings) == unpack([right[i] for i in part], settings)).mean(axis=1)
        out[part] = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    return out


def fingerprint(text: Column, settings: FingerprintSettings = FingerprintSettings()) -> Column:
    """Hex digits of the packed bits; empty for a text without words."""

    @F.arrow_udf("string")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([pack(hashes, settings) for hashes in shingle_sets(texts, settings.width)], pa.string())

    return packed(F.coalesce(text, F.lit("")))


def likeness(left: Column, right: Column, settings: FingerprintSettings = FingerprintSettings()) -> Column:
    """Estimated similarity (0 to 1) of the shingle sets behind two fingerprints."""

    @F.arrow_udf("double")
    def compared(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(alike(a.fill_null("").to_pylist(), b.fill_null("").to_pylist(), settings), pa.float64())

    return compared(left, right)


def fingerprint_documents(docs: DataFrame, settings: FingerprintSettings = FingerprintSettings(), text: str = "text") -> DataFrame:
    """`docs` with n_chars (code points) and fingerprint."""
    kept = docs.drop("n_chars", "fingerprint")
    return kept.withColumn("n_chars", F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")).withColumn("fingerprint", fingerprint(F.col(text), settings))


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """`docs` with struct `next`: the `columns` of the next row by descending id; the last row's is the first.

    Rows are ordered by (id descending, null last, hash of the text).  A first pass over
    ids and hashes cuts that order into ranges; then every row moves once, to its range, with a
    copy of each range's first row behind the range before it, and a window inside the range
    does the rest.  The driver holds one key per range.  An id that very many rows share is
    split by the hash; rows equal in id and text share a range.
    """
    spark = docs.sparkSession
    sign = F.lit(-(1 << 63)).cast("bigint")

    def digits(value: Column) -> Column:
        # Signed numbers in an order that their digits keep.
        return F.lpad(F.hex(value.bitwiseXOR(sign)), 16, "0")

    id_ = F.col(doc_id).cast("bigint")
    order = F.concat(F.when(id_.isNull(), "1").otherwise("0"), digits(F.bitwise_not(F.coalesce(id_, F.lit(0)))), digits(F.xxhash64(F.coalesce(F.col(text), F.lit("")))))
    shards = shards or parallelism(spark)
    keyed = docs.withColumn("_order", order)
    ranges = keyed.select("_order").repartitionByRange(shards, "_order").groupBy(F.spark_partition_id().alias("_r")).agg(F.min("_order").alias("first")).collect()
    firsts = sorted({r["first"] for r in ranges})
    if not firsts:
        return docs.withColumn("next", F.struct(*columns))
    known = F.split(F.lit(",".join(firsts)), ",")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(firsts).bit_length()))])
    # How many firsts are not above the key, less one: binary search.
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= F.col("_order"), at + step).otherwise(at))
    placed = keyed.withColumn("_shard", found - 1)
    # A range's first row goes to the range before as well; the first one's to the last.
    is_first = F.get(known, F.col("_shard")) == F.col("_order")
    before = F.pmod(F.col("_shard") - 1, F.lit(len(firsts)))
    own, copy = (F.struct(s.alias("_to"), F.lit(ghost).alias("_ghost")) for s, ghost in ((F.col("_shard"), False), (before, True)))
    dealt = placed.select("*", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))).alias("_d")).select(*keyed.columns, "_d.*")
    # Copies come last; several equal ones do no harm.
    window = Window.partitionBy("_to").orderBy("_ghost", "_order")
    told = dealt.repartition(shards, "_to").withColumn("next", F.lead(F.struct(*columns)).over(window))
    return told.where("NOT _ghost").select(*docs.columns, "next")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third (rounded down) replaced by as many first code points of another (or all)."""
    own, other = (F.coalesce(t, F.lit("")) for t in (text, following))
    third = F.floor(F.length(own) / 3).cast("int")
    return F.concat(F.substring(own, F.lit(1), F.length(own) - third), F.substring(other, F.lit(1), third))


def compare_with_edits(docs: DataFrame, settings: FingerprintSettings = FingerprintSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) per row of `docs`.

    The next document is the one with the next smaller id; the last one's is the first.
    """
    signed = fingerprint_documents(docs.select(doc_id, text), settings, text)
    # Moved as bytes, which is half of the digits.
    paired = with_next(signed.withColumn("fingerprint", F.unhex("fingerprint")), [text, "fingerprint"], doc_id, text)
    own, following = (F.lower(F.hex(c)).alias("fingerprint") for c in ("fingerprint", "next.fingerprint"))
    changed = paired.select(doc_id, "n_chars", own, F.struct(following).alias("next"), edited(F.col(text), F.col(f"next.{text}")).alias("edited"))
    changed = changed.withColumn("edited_fingerprint", fingerprint(F.col("edited"), settings))
    return changed.select(
        doc_id,
        "n_chars",
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), settings).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next.fingerprint"), settings).alias("near_next"),
    )
