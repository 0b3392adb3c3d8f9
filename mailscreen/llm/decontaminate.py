"""Benchmark passages in documents: SimHash of item-sized windows, multi-index, exact check.

1. windows      A window is as long as the item it may hold.  A pair that passes step 4 has a
                shingle in common, at any place of either (sentences may be in another order),
                so a window is laid at every start that lets it hold a shingle of an item of
                its length.  What a window shares with an item weighs no more than all its
                shingles that are some item's of that length, and must weigh `threshold` times
                the item; windows short of that for the lightest such item cannot pass.
2. fingerprint  64-bit SimHash over the window's words.
3. multi-index  Item fingerprints are cut into 8 blocks of 8 bits.  Two fingerprints that
                differ in at most `radius` (23) bits differ in at most 2 bits of some block,
                so the index holds every block with up to 2 bits flipped (37 keys), and each
                window looks up its 8 blocks among items of its length: no fingerprint within the radius is
                missed.  Candidates are pairs within the radius: a pair that passes step 4
                differs in two words of 25 at most, which is 8 bits, give or take 3.
4. verify       Weighted Jaccard of the shingle multisets, at least `threshold`.  A shingle
                weighs 1 / (items that contain it), so text shared by many items counts less.

Shingles are five words (A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`); an item of fewer words is one
shingle.  All steps are DataFrame operations.  Item tables are broadcast only if counted
small (`join_summary`); a passage in very many documents is as many independent rows.

Edge cases: null and empty texts and items match nothing; equal items are reported each;
of several windows for one document and item the most similar, then the first, is given;
repeated rows of a document count once; null ids are ids like others; other columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen.session import computed, join_summary, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKS, BLOCK_BITS = 8, 8


@dataclass(frozen=True)
class MatchSettings:
    width: int = 5
    threshold: float = 0.75
    radius: int = 23


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles_of(words: Column, width: int) -> Column:
    """Shingle texts in order; fewer words than `width` are one shingle, none are none."""
    count = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), count - width), lambda i: F.array_join(F.slice(words, i + 1, width), " "))
    return F.when(count >= width, runs).when(count > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def run_hashes(words: Column, width: int) -> Column:
    """A 64-bit hash for each run of exactly `width` words, made from hashes of the words."""

    def rolled(h: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(F.lit(width), *[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) >= width, made).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), rolled), 0)


def simhash(words: Column) -> Column:
    """64 bits: bit i is set if more words have it in their hash than have not."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def vote(items: Column) -> Column:
        bits = F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda i: F.aggregate(items, F.lit(0), lambda a, x: a + F.when(F.getbit(x, i) == 1, 1).otherwise(-1)),
        )
        one = F.lit(1).cast("bigint")
        return F.aggregate(bits, F.struct(F.lit(0).cast("bigint").alias("f"), F.lit(0).alias("i")), lambda a, b: F.struct(
            F.when(b > 0, a["f"].bitwiseOR(F.call_function("shiftleft", one, a["i"]))).otherwise(a["f"]).alias("f"), (a["i"] + 1).alias("i")
        ))["f"]

    return F.get(F.transform(F.array(hashed), vote), 0)


def blocks_of(fingerprint: Column) -> Column:
    """(block number, block) of a fingerprint."""
    mask = F.lit((1 << BLOCK_BITS) - 1)
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftright(fingerprint, BLOCK_BITS * b).bitwiseAND(mask).alias("bits")) for b in range(BLOCKS)])


def flips(radius: int) -> list[int]:
    """Masks of up to radius // BLOCKS bits: some block differs by no more."""
    return [sum(1 << i for i in bits) for k in range(radius // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), k)]


def item_table(items: DataFrame, settings: MatchSettings) -> DataFrame:
    """(item_id, size, words, shingles, fingerprint) of items with words."""
    worded = computed(items.select("item_id", F.col("text").alias("_t")), words=words_of(F.col("_t"))).where(F.size("words") > 0)
    return worded.select(
        "item_id", F.size("words").alias("size"), "words", shingles_of(F.col("words"), settings.width).alias("shingles"), simhash(F.col("words")).alias("fingerprint")
    )


def shingle_weights(items: DataFrame) -> DataFrame:
    """(shingle, weight) of the shingles that are in more than one item; all others weigh 1."""
    each = items.select(F.explode(F.array_distinct("shingles")).alias("shingle"))
    return each.groupBy("shingle").agg((1.0 / F.count("*")).alias("weight")).where("weight < 1")


def find_passages(docs: DataFrame, items: DataFrame, settings: MatchSettings = MatchSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): documents that hold an item."""
    known = written(item_table(items, settings), "items")
    width = settings.width
    short = [r["size"] for r in known.where(F.col("size") < width).select("size").distinct().collect()]
    # Rows are told apart by id and text; an accidental equality only adds windows to verify.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"), F.xxhash64(doc_id, text).alias("_row"))
    worded = computed(rows, words=words_of(F.col("_t"))).select("_row", "words")
    known = known.withColumn("_item", F.xxhash64("item_id", "words"))
    anchors = shingles = None
    # Items of fewer words than a shingle are looked for as runs of their own length.
    for run in [width, *sorted(short)]:
        own = known.where(F.col("size") >= width if run == width else F.col("size") == run)
        own = own.select("_item", "size", run_hashes(F.col("words"), run).alias("runs"))
        runs = worded.select("_row", F.size("words").alias("length"), F.posexplode(run_hashes(F.col("words"), run)).alias("pos", "h"))
        anchors, shingles = (own, runs) if anchors is None else (anchors.union(own), shingles.union(runs))
    each = anchors.select("size", F.explode(F.array_distinct("runs")).alias("h"))
    weights = written(each.groupBy("h").agg((1.0 / F.count("*")).alias("weight"), F.collect_set("size").alias("sizes")), "shingles")
    placed = anchors.dropDuplicates(["_item"]).select("_item", "size", F.explode("runs").alias("h")).join(weights.select("h", "weight"), "h")
    lightest = placed.groupBy("_item", "size").agg(F.sum("weight").alias("total")).groupBy("size").agg(F.min("total").alias("lightest"))
    hits = join_summary(shingles, weights, ["h"]).select("_row", "length", "pos", "weight", F.explode("sizes").alias("size"))
    # Every start inside the text that has the whole shingle in the window; a shorter text is one window.
    first = F.greatest(F.lit(0), F.col("pos") + F.least(F.col("size"), F.lit(width)) - F.col("size"))
    last = F.least(F.col("pos"), F.greatest(F.lit(0), F.col("length") - F.col("size")))
    starts = hits.select("_row", "size", "weight", F.explode(F.sequence(first, last)).alias("start"))
    summed = starts.groupBy("_row", "size", "start").agg(F.sum("weight").alias("shared"))
    able = join_summary(summed, lightest, ["size"]).where(F.col("shared") >= settings.threshold * F.col("lightest") * (1 - 1e-6))
    places = written(able.groupBy("_row").agg(F.collect_set(F.struct("size", "start")).alias("windows")), "windows")
    matched = join_summary(rows, places, ["_row"])
    cut = computed(matched, words=words_of(F.col("_t"))).select("doc_id", "words", F.explode("windows").alias("w"))
    start = F.col("w.start")
    windows = cut.select("doc_id", "w.size", start.alias("start_word"), F.slice("words", start + 1, F.col("w.size")).alias("words")).distinct()
    printed = written(windows.withColumn("print", simhash(F.col("words"))), "fingerprints")

    index = known.select("item_id", "size", "fingerprint", F.explode(blocks_of(F.col("fingerprint"))).alias("b"))
    flipped = F.explode(F.array(*[F.lit(m) for m in flips(settings.radius)]))
    index = index.select("item_id", "size", "fingerprint", F.col("b.block").alias("block"), F.col("b.bits").alias("bits"), flipped.alias("flip"))
    index = index.select("item_id", "size", "fingerprint", "block", F.col("bits").bitwiseXOR(F.col("flip")).alias("bits"))
    looked = printed.select("doc_id", "size", "start_word", "words", "print", F.explode(blocks_of(F.col("print"))).alias("b")).select("*", "b.block", "b.bits")
    near = join_summary(looked, index, ["size", "block", "bits"]).withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint"))))
    found = near.where(F.col("hamming") <= settings.radius).select("doc_id", "start_word", "words", "item_id", "hamming").distinct()
    return _verified(found, known, settings)


def _verified(found: DataFrame, known: DataFrame, settings: MatchSettings) -> DataFrame:
    """Candidates whose weighted shingle similarity is high enough; the best window of each pair."""
    key = ["doc_id", "start_word", "n_words", "item_id", "hamming"]
    pairs = join_summary(found.withColumn("n_words", F.size("words")), known.select("item_id", "shingles"), ["item_id"])
    sides = F.array(F.struct(F.lit(1).alias("own"), shingles_of(F.col("words"), settings.width).alias("s")), F.struct(F.lit(0).alias("own"), F.col("shingles").alias("s")))
    each = pairs.select(*key, F.explode(sides).alias("side")).select(*key, "side.own", F.explode("side.s").alias("shingle"))
    counted = each.groupBy(*key, "shingle").agg(F.sum("own").alias("here"), F.sum(1 - F.col("own")).alias("there"))
    weighed = join_summary(counted, shingle_weights(known), ["shingle"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    shared, all_ = (F.sum(F.col("weight") * f("here", "there")) for f in (F.least, F.greatest))
    alike = weighed.groupBy(*key).agg((shared / all_).alias("similarity")).where(F.round("similarity", 9) >= settings.threshold)
    best = F.max(F.struct(F.round("similarity", 9).alias("similarity"), (-F.col("start_word")).alias("s"), "n_words", "hamming"))
    chosen = alike.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return chosen.select("doc_id", "item_id", (-F.col("b.s")).alias("start_word"), "b.n_words", "b.hamming", "b.similarity")
