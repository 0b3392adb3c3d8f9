"""From raw labelled rows to one clean, duplicate-free corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.config import HAM, SPAM
from mailscreen.functions.text import clean_text, dedupe_hash, strip
from mailscreen.session import computed, join_summary, plain_unions, written

MAIL_SCHEMA = T.StructType(
    [
        T.StructField("email_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("label_name", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("text_length", T.IntegerType()),
    ]
)
MAIL_COLUMNS = MAIL_SCHEMA.fieldNames()


def whole_number(value: Column) -> Column:
    """An integer however it is written (`1`, ` 1 `, `1.0`, 1.0); NULL for anything else."""
    number = value.cast("string").try_cast("double")
    return F.when(number == F.floor(number), number.cast("int"))


def unreadable_labels(df: DataFrame, label: str) -> DataFrame:
    """One row: how many rows have a label that `finalize` cannot read as 0 or 1."""
    known = F.coalesce(whole_number(F.col(label)).isin(HAM, SPAM), F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum((~known).cast("int")), F.lit(0)).alias("unreadable"))


def finalize(
    df: DataFrame,
    source: str | Column,
    email_id: str,
    text: str,
    label: str,
    label_name: str | None = None,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Project onto the mail columns, clean the text, drop unusable rows.

    A row stays when its cleaned text is not empty and its label is 0 or 1.  The label
    name is taken as given where a column is named, else derived from the label.
    """
    label_id = whole_number(F.col(label))
    if label_name is not None:
        name = F.lower(strip(F.coalesce(F.col(label_name).cast("string"), F.lit(""))))
    else:
        name = F.when(label_id == SPAM, "spam").when(label_id == HAM, "ham").otherwise("")
    rows = df.filter(label_id.isin(HAM, SPAM)).select(
        strip(F.coalesce(F.col(email_id).cast("string"), F.lit(""))).alias("email_id"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        label_id.alias("label"),
        name.alias("label_name"),
        F.col(text).cast("string").alias("_text"),
        *extra,
    )
    return (
        computed(rows, text=clean_text("_text"))
        .filter(F.length("text") > 0)
        .select(*MAIL_COLUMNS[:-1], F.length("text").alias("text_length"), *extra)
    )


def union_sources(sources: list[DataFrame | None]) -> DataFrame:
    """Union in the given order; `source_rank` keeps that order.  None = source missing."""
    ranked = [df.withColumn("source_rank", F.lit(rank)) for rank, df in enumerate(sources) if df is not None]
    if not ranked:
        raise ValueError("no source was given")
    plain_unions(ranked[0].sparkSession)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise RuntimeError("no mail was loaded from the configured sources")
    return df


def keep_first(df: DataFrame, order: list[str], text: str = "text", key: Column | None = None) -> DataFrame:
    """One row per distinct text: the first by `order` (any, where rows tie).

    The rows are written once with their key, so nothing above is computed twice.  First
    rows are then found on keys and order columns alone; the rows that lose are few where
    copies are few, and dropping them by row number moves no text (they are broadcast if
    counted small).  The hash stays in the result as `text_key`; it is unique there.
    """
    keyed = computed(df.drop("text_key"), text_key=key if key is not None else dedupe_hash(text))
    keyed = written(keyed.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    narrow = keyed.select("text_key", "_row", F.struct(*order, "_row").alias("_place"))
    repeated = narrow.groupBy("text_key").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    later = join_summary(narrow.select("text_key", "_row"), repeated.select("text_key", F.col("_first._row").alias("_kept")), ["text_key"])
    return join_summary(keyed, later.filter("_row <> _kept").select("_row"), ["_row"], "left_anti").drop("_row")


def select_mail(df: DataFrame, label: int | None = None, source: str | None = None) -> DataFrame:
    """Rows of one label and/or one source; no argument means no filter."""
    if label is not None:
        df = df.filter(F.col("label") == label)
    if source is not None:
        df = df.filter(F.col("source") == source)
    return df


def find_mail(df: DataFrame, email_id: str, order: list[str]) -> DataFrame:
    """The first row with this id, or no row."""
    return df.filter(F.col("email_id") == email_id).orderBy(*order).limit(1)


def length_bands(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first `n` very short (<50) and medium (200..500) texts and the `n` longest."""
    length = F.col("text_length")
    short = df.filter(length < 50).orderBy(*order).limit(n).withColumn("band", F.lit("very_short"))
    medium = df.filter(length.between(200, 500)).orderBy(*order).limit(n).withColumn("band", F.lit("medium"))
    long = longest(df, order, n).withColumn("band", F.lit("very_long"))
    return short.unionByName(medium).unionByName(long)


def longest(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(F.desc("text_length"), *order).limit(n)


def _count_label(value: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("label") == value, 1).otherwise(0)), F.lit(0)).cast("long")


def label_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), _count_label(SPAM).alias("spam"), _count_label(HAM).alias("ham"))


def stats_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(
        F.count("*").alias("total"), _count_label(SPAM).alias("spam"), _count_label(HAM).alias("ham")
    )


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("rows"))


def source_diversity(df: DataFrame) -> DataFrame:
    """How many sources there are, and whether there is more than one."""
    return (
        df.groupBy("source")
        .agg(F.lit(1).alias("one"))
        .agg(F.count("*").alias("sources"))
        .select("sources", (F.col("sources") > 1).alias("diverse"))
    )


def length_stats(df: DataFrame) -> DataFrame:
    length = F.col("text_length")
    return df.agg(
        F.count("*").alias("total"),
        _count_label(SPAM).alias("spam"),
        _count_label(HAM).alias("ham"),
        F.coalesce(F.avg((F.col("label") == SPAM).cast("double")), F.lit(0.0)).alias("spam_ratio"),
        F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.min(length), F.lit(0)).alias("min_length"),
        F.coalesce(F.max(length), F.lit(0)).alias("max_length"),
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row about a corpus that carries a `split` column; one scan.

    Sums per (source, split) first, then folds those few rows into totals and the
    `source_counts` map.
    """
    parts = df.groupBy("source", "split").agg(
        F.count("*").alias("rows"),
        _count_label(SPAM).alias("spam"),
        _count_label(HAM).alias("ham"),
        F.sum(F.col("text_length").cast("long")).alias("chars"),
    )

    def split_rows(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("split") == name, F.col("rows"))), F.lit(0))

    per_source = parts.groupBy("source").agg(
        F.sum("rows").alias("rows"),
        F.sum("spam").alias("spam"),
        F.sum("ham").alias("ham"),
        F.sum("chars").alias("chars"),
        *[split_rows(name).alias(name) for name in ("train", "validation", "test")],
    )
    return per_source.agg(
        F.sum("rows").alias("total_samples"),
        F.sum("spam").alias("spam_samples"),
        F.sum("ham").alias("ham_samples"),
        (F.sum("chars") / F.sum("rows")).alias("average_length"),
        F.sum("train").alias("train_size"),
        F.sum("validation").alias("validation_size"),
        F.sum("test").alias("test_size"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rows")))).alias("source_counts"),
    )


def class_weights(df: DataFrame) -> DataFrame:
    """total, label, weight = total / (2 * rows of the label), for labels 0 and 1 in any case."""
    totals = label_totals(df)
    both = totals.select(
        "total", F.explode(F.array(*[F.struct(F.lit(i).alias("label"), F.col(n).alias("n")) for i, n in ((HAM, "ham"), (SPAM, "spam"))])).alias("c")
    )
    return both.select(
        "total", F.col("c.label").alias("label"), (F.col("total") / (F.greatest(F.col("c.n"), F.lit(1)) * 2.0)).alias("weight")
    )
