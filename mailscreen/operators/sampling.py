"""Seeded splits and samples that never sort a whole class or source in one task.

Rows are ordered at random by a seeded hash of their id.  The k-th row of a group is
found from a histogram over the first hex digits of the hash: only the rows of the one
bucket it falls into are ranked.  What comes out is a cut-off hash, and applying it is a
plain filter, so the texts themselves are never shuffled.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailscreen.config import SplitFractions
from mailscreen.functions.text import sample_preview
from mailscreen.session import join_summary, plain_unions, seeded_hash, settle, written

BUCKET_DIGITS = 4


def _bucketed(df: DataFrame, group: list[str], order: Column, digits: int) -> DataFrame:
    return df.select(*group, order.alias("_h")).withColumn("_bucket", F.substring("_h", 1, digits))


def split_quotas(counts: dict[int, int], fractions: SplitFractions) -> dict[int, tuple[int, int, int]]:
    """label -> (test, validation, train) rows.

    Totals round the held-out part up; classes share a total by largest remainder,
    ties to the smaller label.
    """
    fractions.check()

    def shares(sizes: dict[int, int], draws: int) -> dict[int, int]:
        total = sum(sizes.values())
        exact = {label: size / total * draws for label, size in sizes.items()}
        given = {label: math.floor(value) for label, value in exact.items()}
        order = sorted(sizes, key=lambda label: (given[label] - exact[label], label))
        for label in order[: draws - sum(given.values())]:
            given[label] += 1
        return given

    total = sum(counts.values())
    if not total:
        return {}
    rest_total = total - math.ceil(fractions.test * total)
    rest = shares(counts, rest_total)
    train_total = rest_total - math.ceil(fractions.validation_share_of_rest * rest_total)
    train = shares(rest, train_total) if rest_total else dict.fromkeys(counts, 0)
    return {label: (counts[label] - rest[label], rest[label] - train[label], train[label]) for label in counts}


def _label_pieces(df: DataFrame, order: Column, label: str, sizes) -> Column:
    """A Column with the piece number of each row, for `sizes(counts) -> {label: [n0, n1, ...]}`.

    Labels are few (0 and 1 in a finalized corpus): the driver sees one histogram of at
    most 16**BUCKET_DIGITS buckets per label, and the cut-offs go into the plan as literals.
    """
    # Hashes are written once: the input above them may be costly.
    keyed = written(_bucketed(df, [label], order, BUCKET_DIGITS), "split-hashes")
    hist = keyed.groupBy(label, "_bucket").agg(F.count("*").alias("_n")).collect()
    counts: dict = {}
    for row in hist:
        counts[row[label]] = counts.get(row[label], 0) + row["_n"]
    pieces = sizes(counts)
    ends = {name: [sum(parts[: i + 1]) for i in range(len(parts) - 1)] for name, parts in pieces.items()}

    # (label, end) -> the bucket that end falls into and its place in there.
    edges: dict = {}
    seen = dict.fromkeys(counts, 0)
    for row in sorted(hist, key=lambda r: r["_bucket"]):
        name, before = row[label], seen[row[label]]
        seen[name] = before + row["_n"]
        for end in ends[name]:
            if before < end <= seen[name]:
                edges[name, end] = (row["_bucket"], end - before)
    found = {}
    if edges:
        in_edge = [(F.col(label) == name) & (F.col("_bucket") == bucket) for name, bucket in {(n, b) for (n, _), (b, _) in edges.items()}]
        # Rows of one hash are one entry with a count, however many share an id or have none.
        entries = keyed.filter(reduce(or_, in_edge)).groupBy(label, "_bucket", "_h").agg(F.count("*").alias("_n"))
        entries = entries.withColumn("_upto", F.sum("_n").over(Window.partitionBy(label, "_bucket").orderBy("_h")))
        at_edge = [
            (F.col(label) == name) & (F.col("_bucket") == bucket) & (F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place)
            for (name, _), (bucket, place) in edges.items()
        ]
        rows = entries.filter(reduce(or_, at_edge)).collect()
        found = {
            (name, end): next(r["_h"] for r in rows if r[label] == name and r["_bucket"] == bucket and r["_upto"] - r["_n"] < place <= r["_upto"])
            for (name, end), (bucket, place) in edges.items()
        }

    piece = F.lit(None).cast("int")
    for name, row in ends.items():
        chosen = F.lit(len(row))
        for number in range(len(row) - 1, -1, -1):
            if row[number] > 0:
                chosen = F.when(order <= found[name, row[number]], number).otherwise(chosen)
        piece = F.when(F.col(label) == name, chosen).otherwise(piece)
    return piece


def stratified_split(
    df: DataFrame,
    ids: list[str],
    seed: int = 42,
    fractions: SplitFractions = SplitFractions(),
    label: str = "label",
) -> DataFrame:
    """Add `split`: test / validation / train with exact sizes per class.

    `ids` name a row; rows that share an id share a side.
    """
    order = seeded_hash(seed, *ids)
    piece = _label_pieces(df, order, label, lambda counts: split_quotas(counts, fractions))
    return df.withColumn("split", F.element_at(F.array(*map(F.lit, ("test", "validation", "train"))), piece + 1))


def hashed_split(df: DataFrame, ids: list[str], seed: int = 42, fractions: SplitFractions = SplitFractions()) -> DataFrame:
    """Like `stratified_split` but with approximate sizes and no look at the data."""
    fractions.check()
    unit = F.conv(F.substring(seeded_hash(seed, *ids), 1, 8), 16, 10).cast("double") / float(16**8)
    return df.withColumn(
        "split",
        F.when(unit < fractions.test, "test").when(unit < fractions.test + fractions.validation, "validation").otherwise("train"),
    )


def stratified_folds(df: DataFrame, ids: list[str], folds: int, seed: int = 42, label: str = "label") -> DataFrame:
    """Add `fold` 0..folds-1, each with an equal share of every class (sizes differ by one at most)."""

    def sizes(counts):
        return {k: [n // folds + (1 if i < n % folds else 0) for i in range(folds)] for k, n in counts.items()}

    return df.withColumn("fold", _label_pieces(df, seeded_hash(seed, *ids), label, sizes))


def sample_rows(df: DataFrame, n: int, ids: list[str], seed: int = 42) -> DataFrame:
    """`n` rows without replacement (all, if there are fewer)."""
    return df.orderBy(seeded_hash(seed, *ids), *ids).limit(n)


def sample_listing(df: DataFrame, n: int, ids: list[str], seed: int = 42) -> DataFrame:
    return sample_rows(df, n, ids, seed).select(
        "email_id", "label_name", sample_preview("text").alias("text_preview"), "text_length", "source"
    )


def cap_per_group(df: DataFrame, group: str, cap: int | None, ids: list[str], seed: int = 42) -> DataFrame:
    """`cap` random rows of every group (None: all); smaller groups stay whole.

    Rows are ordered by the hash of their ids, then of all their columns, so equal or NULL
    ids do not tie.  Rows that tie all the same are equal in every column: of those at the
    cut-off, as many copies are given as the cap leaves room for.
    """
    if cap is None:
        return df
    content = F.lpad(F.hex(F.xxhash64(*df.columns)), 16, "0")
    hashed = written(df.withColumn("_h", F.concat(seeded_hash(seed, *ids), content)), "capped")
    # Equal rows are one entry with a count, however many they are.
    sizes = settle(hashed.groupBy(group, "_h").agg(F.count("*").alias("_n")).withColumn("_bucket", F.substring("_h", 1, 3)))
    buckets = settle(sizes.groupBy(group, "_bucket").agg(F.sum("_n").alias("_n")))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket"))
    edges = buckets.withColumn("_upto", upto).filter((F.lit(cap) < F.col("_upto")) & (F.lit(cap) >= F.col("_upto") - F.col("_n")))
    edges = edges.select(group, "_bucket", (F.col("_upto") - F.col("_n")).alias("_before"))
    inside = join_summary(sizes, edges, [group, "_bucket"]).withColumn(
        "_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(group, "_bucket").orderBy("_h"))
    )
    cut = inside.filter((F.lit(cap) < F.col("_upto")) & (F.lit(cap) >= F.col("_upto") - F.col("_n")))
    cut = cut.select(group, F.col("_h").alias("_cut"), (F.lit(cap) - F.col("_upto") + F.col("_n")).cast("int").alias("_room"))
    joined = join_summary(hashed, cut, [group], "left")
    below = joined.filter(F.col("_cut").isNull() | (F.col("_h") < F.col("_cut"))).select(*df.columns)
    at_cut = joined.filter((F.col("_h") == F.col("_cut")) & (F.col("_room") > 0)).dropDuplicates([group, "_h"])
    copies = at_cut.withColumn("_k", F.explode(F.sequence(F.lit(1), "_room"))).select(*df.columns)
    plain_unions(df.sparkSession)
    return below.union(copies)


def sample_with_replacement(df: DataFrame, n: int, ids: list[str], seed: int = 42) -> DataFrame:
    """Exactly `n` draws; adds `draw` (0-based).  A row may come up several times.

    Draw i takes the row at place r(i) of the hash order.  The bucket that holds a place
    is looked up in the histogram's running totals.  Inside it, places are told by running
    counts over distinct rows, so rows that share an id, or are equal, are not ranked one by one.
    """
    spark: SparkSession = df.sparkSession
    # Ids first, then the whole row: what ties after that is equal in every column.
    order = F.concat(seeded_hash(seed, *ids), F.lpad(F.hex(F.xxhash64(*df.columns)), 16, "0"))
    keyed = written(df.withColumn("_h", order).withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS)), "drawn-from")
    hist = sorted((r["_bucket"], r["n"]) for r in keyed.groupBy("_bucket").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for _, size in hist:
        starts.append(total)
        total += size
    if not total or n <= 0:
        return df.withColumn("draw", F.lit(0).cast("long")).limit(0)

    draws = spark.range(n).select(
        F.col("id").alias("draw"),
        (F.conv(F.substring(seeded_hash(seed, F.lit("draw"), F.col("id")), 1, 15), 16, 10).cast("long") % total).alias("_place"),
    )
    # Buckets in hash order are the integers 0..; a place maps to one by binary search.
    located = Bucketizer(splits=[float(s) for s in starts] + [float("inf")], inputCol="_at", outputCol="_slot").transform(
        draws.withColumn("_at", F.col("_place").cast("double"))
    ) if len(starts) > 1 else draws.withColumn("_slot", F.lit(0.0))
    # At most 16**BUCKET_DIGITS rows by construction.
    names = F.broadcast(
        spark.createDataFrame([(float(i), b, s) for i, ((b, _), s) in enumerate(zip(hist, starts))], "_slot double, _bucket string, _start long")
    )
    placed = located.join(names, "_slot").select("draw", "_bucket", (F.col("_place") - F.col("_start") + 1).alias("_rank"))
    placed = written(placed, "places")
    entries = join_summary(keyed.select("_bucket", "_h"), placed.select("_bucket").distinct(), ["_bucket"], "left_semi").groupBy("_bucket", "_h").agg(F.count("*").alias("_n"))
    running = F.sum("_n").over(Window.partitionBy("_bucket").orderBy("_h"))
    starts = entries.withColumn("_rank", running - F.col("_n") + 1).select("_bucket", "_rank", F.lit(None).cast("long").alias("draw"), "_h")
    # In order of places, each draw follows the entry that it falls into.
    plain_unions(spark)
    both = starts.unionByName(placed.withColumn("_h", F.lit(None).cast("string")))
    last = Window.partitionBy("_bucket").orderBy("_rank", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_h", F.last("_h", ignorenulls=True).over(last)).where("draw IS NOT NULL").select("draw", "_h")
    rows = join_summary(keyed, told.select("_h").distinct(), ["_h"], "left_semi").dropDuplicates(["_h"])
    return told.join(rows, "_h").select("draw", *df.columns)
