"""Shards of near-equal bytes by a histogram sort.

Rows are ordered by a key of 63 bits: 31 bits of the text's hash, then 32 bits of the id's.
Equal texts lie side by side, and a shard boundary divides a large group of copies between
documents.  Boundaries are found without sorting: probes are laid over the key space, the
exact bytes below each are counted in one grouped sum, and each boundary's interval is
refined with new probes until the bytes inside it are within `tolerance` of a shard (or a
single key is left).  Only then rows move, once, each to its range.

A shard is made of several ranges when it has many rows, so a task ranks a bounded number
of rows; offsets of ranges come from exact counts.  The driver holds `probes` counts for
each open boundary and nothing that grows with the rows but the number of ranges.

Edge cases: a null text has no bytes and size 1; rows with equal id and text have one key
and stay in one shard; null ids are hashed like a value; shards may be empty when there
are fewer rows than shards; columns named like the results are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscreen.llm.registry import bin_of, long_array
from mailscreen.session import written

KEY_END = 1 << 63


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one for the separator."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def sort_key(text: Column, doc_id: Column) -> Column:
    low = F.xxhash64(doc_id).bitwiseAND(F.lit((1 << 32) - 1))
    high = F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1))
    return F.shiftleft(high, 32).bitwiseOR(low)


def find_splitters(keys: DataFrame, parts: int, tolerance: float = 0.001, probes: int = 64) -> list[int]:
    """Keys at which `parts` ranges of near-equal size begin (all but the first).

    `keys` has columns key (0 up to 2^63) and size and is scanned once per round; a round
    makes every open interval `probes` times narrower.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = [total * i / parts for i in range(1, parts)]
    # Per target: interval [low, high) that holds the boundary, and the bytes below its ends.
    open_ = {i: (0, KEY_END, 0, total) for i in range(len(targets))}
    found = [0] * len(targets)
    while open_:
        marks = sorted({low + (high - low) * j // probes for low, high, _, _ in open_.values() for j in range(probes + 1)} - {0, KEY_END})
        counted = keys.groupBy(bin_of(F.col("key"), marks).alias("bin")).agg(F.sum("size").alias("size"))
        sizes = [0] * (len(marks) + 1)
        for row in counted.collect():
            sizes[row["bin"]] = row["size"]
        below = dict(zip(marks, accumulate(sizes))) | {0: 0, KEY_END: total}
        still = {}
        for i, (low, high, _, _) in open_.items():
            own = [low, *marks[bisect_left(marks, low + 1) : bisect_left(marks, high)], high]
            last = max(k for k, m in enumerate(own[:-1]) if below[m] <= targets[i])
            low, high = own[last], own[last + 1]
            if below[high] - below[low] <= tolerance * total / parts or high - low == 1:
                found[i] = low if targets[i] - below[low] <= below[high] - targets[i] else high
            else:
                still[i] = (low, high, below[low], below[high])
        open_ = still
    return [min(k, KEY_END - 1) for k in found]


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, rows_per_range: int = 200_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `size`, `shard` (from 0) and `slot` (place in the shard, gapless from 0)."""
    kept = docs.drop("size", "shard", "slot", "_key", "_range")
    sized = kept.withColumns({"size": text_size(F.col(text)), "_key": sort_key(F.col(text), F.col(doc_id))})
    keys = written(sized.select(F.col("_key").alias("key"), "size"), "shard-keys")
    ranges = max(1, -(-keys.count() // (shards * rows_per_range)))
    splitters = find_splitters(keys, shards * ranges, tolerance)
    counts = [0] * (shards * ranges)
    for row in keys.groupBy(bin_of(F.col("key"), splitters).alias("range")).count().collect():
        counts[row["range"]] = row["count"]
    before = [0, *accumulate(counts)]
    offsets = [before[r] - before[r // ranges * ranges] for r in range(shards * ranges)]
    first = F.get(long_array(offsets), F.col("_range").cast("int"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key", doc_id, "size"))
    placed = sized.withColumn("_range", bin_of(F.col("_key"), splitters)).withColumn("slot", first + place - 1)
    return placed.withColumn("shard", F.floor(F.col("_range") / ranges).cast("int")).drop("_key", "_range")
