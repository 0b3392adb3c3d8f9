"""Scaled statistics, the union of all features, and the step to MLlib vectors."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.functions.stats import STATISTICS, with_email_stats
from mailscreen.session import computed, sized, written

STATS_PREFIX = "email_stats__"
VECTOR_ROW = T.StructType([T.StructField("features", VectorUDT())])


def stats_max_abs(stats: DataFrame) -> DataFrame:
    """One row: the largest absolute value of each statistic."""
    return stats.agg(*[F.max(F.abs(F.col(name))).alias(name) for name in STATISTICS])


def scale_of(stats: DataFrame) -> dict[str, float]:
    """Divisors of max-abs scaling; a column of zeros is divided by 1."""
    row = stats_max_abs(stats).first()
    return {name: row[name] or 1.0 for name in STATISTICS}


def scale_stats(stats: DataFrame, scale: dict[str, float] | Row, keep: list[str]) -> DataFrame:
    return stats.select(*keep, *[(F.col(name) / F.lit(float(scale[name]))).alias(name) for name in STATISTICS])


def stats_long(scaled: DataFrame, id_column: str, zeros: bool = False) -> DataFrame:
    """(id, feature, weight) of the statistics; with `zeros` every id has all of them."""
    entries = F.array(
        *[F.struct(F.lit(STATS_PREFIX + name).alias("feature"), F.col(name).alias("weight")) for name in STATISTICS]
    )
    rows = scaled.select(id_column, F.explode(entries).alias("e")).select(id_column, "e.feature", "e.weight")
    return rows if zeros else rows.filter(F.col("weight") != 0)


def scaled_stats(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Fit and apply max-abs scaling on the same rows.

    The statistics are written in between: eleven numbers a row are read again much
    faster than they are counted.
    """
    stats = written(with_email_stats(df, text, [id_column]), "stats")
    return scale_stats(stats, scale_of(stats), [id_column])


def named_weights(weights: DataFrame, id_column: str, prefix: str) -> DataFrame:
    return weights.select(id_column, F.concat(F.lit(prefix), F.col("term")).alias("feature"), "weight")


def index_features(features: list[DataFrame]) -> DataFrame:
    """(feature, index): one running number over blocks of feature names.

    Names are sorted into ranges and numbered within each; a range's offset is the number
    of names in the ranges before it.
    """
    names = None
    for block, frame in enumerate(features):
        part = frame.select(F.lit(block).alias("block"), "feature")
        names = part if names is None else names.unionByName(part)
    # The id's upper bits are the range, its lower 33 bits the place in the range.
    placed = written(names.orderBy("block", "feature").withColumn("_at", F.monotonically_increasing_id()), "names")
    placed = placed.select("feature", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    # One row a range: their number is that of the sort's partitions.
    sizes = sorted((r["_range"], r["count"]) for r in placed.groupBy("_range").count().collect())
    offsets, before = [], 0
    for number, count in sizes:
        offsets.append((number, before))
        before += count
    table = names.sparkSession.createDataFrame(offsets, "_range long, _before long")
    numbered = placed.join(F.broadcast(table), "_range").select("feature", (F.col("_before") + F.col("_place")).cast("int").alias("index"))
    return written(numbered, "index")


def statistic_names(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(STATS_PREFIX + name,) for name in STATISTICS], "feature string")


def to_rows(blocks: list[DataFrame], id_column: str, index: DataFrame) -> DataFrame:
    """(id, indices, values) for every id of the first block, indices ascending.

    Blocks are (id, feature, weight).  Each is gathered into one row per id and the rows
    are joined; blocks that are partitioned by id already do not move.  `index` is
    broadcast if it is small enough.
    """
    entry = F.struct(F.col("index").cast("int").alias("i"), F.col("weight").alias("w"))
    index = sized(index)
    names, rows = [], None
    for number, block in enumerate(blocks):
        name = f"_e{number}"
        names.append(name)
        gathered = block.join(index, "feature").groupBy(id_column).agg(F.collect_list(entry).alias(name))
        rows = gathered if rows is None else rows.join(gathered, id_column, "left")
    nothing = F.array().cast("array<struct<i:int,w:double>>")
    rows = computed(rows, _e=F.sort_array(F.concat(*[F.coalesce(n, nothing) for n in names])))
    return rows.select(id_column, F.col("_e.i").alias("indices"), F.col("_e.w").alias("values"))


def to_vectors(blocks: list[DataFrame], id_column: str, index: DataFrame, size: int) -> DataFrame:
    """(id, features) with `features` a sparse MLlib vector, for use in MLlib pipelines.

    Spark has no expression that turns index and value arrays into a vector, but its JSON
    reader accepts the vector type, which keeps the step inside the JVM.  The library's own
    fits take the arrays of `to_rows` as they are.
    """
    rows = to_rows(blocks, id_column, index)
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), "indices", "values")
    parsed = F.from_json(F.to_json(F.struct(vector.alias("features"))), VECTOR_ROW)
    return rows.select(id_column, parsed.getField("features").alias("features"))
