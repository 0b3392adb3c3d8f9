"""Batches of texts for scoring: bytes, text lines, CSV, JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.functions.text import LINE_BREAK, squeeze, strip
from mailscreen.session import computed, join_summary, written

# Names of a text column and of a JSON list, in order of preference.
TEXT_COLUMNS = ("text", "email", "message", "content", "body")
JSON_LISTS = ("texts", "emails", "messages")

# What counts as readable text.
PRINTABLE_SHARE = 0.85
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1f]"
UNPRINTABLE = r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ \n\r\t]]"


def _upper_half(encoding: str) -> tuple[str, str, str]:
    """Bytes 80..FF of a single-byte code page: (bytes it maps, their characters, bytes it lacks)."""
    mapped, characters, missing = "", "", ""
    for value in range(0x80, 0x100):
        try:
            character = bytes([value]).decode(encoding)
        except UnicodeDecodeError:
            missing += chr(value)
            continue
        mapped, characters = mapped + chr(value), characters + character
    return mapped, characters, missing


def _readable(text: Column) -> Column:
    """The whole text counts, wherever in it the odd characters are."""
    printable = F.length(F.regexp_replace(text, UNPRINTABLE, ""))
    return (F.length(text) > 0) & ~text.rlike(CONTROL) & (printable >= F.length(text) * PRINTABLE_SHARE)


def with_decoded(df: DataFrame, content: str = "content") -> DataFrame:
    """Replace a binary column by `text` and `error_code` (empty_file, decode_error or NULL).

    UTF-8 first (a byte-order mark is dropped), then code page 1258, then Latin-1; the
    first reading that looks like text is taken.
    """
    mapped, characters, missing = _upper_half("cp1258")
    data = F.col(content)
    staged = df.withColumns(
        {
            "_utf8": F.try_validate_utf8(data.cast("string")),
            "_latin1": F.decode(data, "ISO-8859-1"),
        }
    )
    latin1 = F.col("_latin1")
    staged = staged.withColumn("_utf8", F.regexp_replace("_utf8", r"^\x{feff}", "")).withColumn(
        "_cp1258", F.when(~latin1.rlike(f"[{missing}]"), F.translate(latin1, mapped, characters))
    )
    text = F.coalesce(*[F.when(_readable(F.col(c)), F.col(c)) for c in ("_utf8", "_cp1258", "_latin1")])
    clean_bytes = F.when(~F.contains(latin1, F.lit("\x00")), text)
    return (
        staged.withColumn("text", clean_bytes)
        .withColumn("error_code", F.when(F.length(data) == 0, "empty_file").when(F.col("text").isNull(), "decode_error"))
        .drop("_utf8", "_latin1", "_cp1258", content)
    )


def text_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, row_number, text): one row per non-blank line of a text column, lines numbered from 1."""
    lines = F.split(F.col(text), LINE_BREAK)
    return (
        computed(df.select(*keep, F.posexplode(lines).alias("_at", "_line")), text=squeeze("_line"))
        .filter(F.col("text") != "")
        .select(*keep, (F.col("_at") + 1).cast("long").alias("row_number"), "text")
    )


def read_line_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_number, text): non-blank lines of text files of any size.

    Files are read in splits, each by one task from its start to its end.  A running id
    numbers the lines of a split where they are read; with the first id of each split and the
    line counts of the splits before it, that gives the line's number.  No text is moved.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.explode(F.split(F.regexp_replace("value", r"\r\z", ""), LINE_BREAK)).alias("_line"),
    ).withColumn("_at", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "_start", "_first", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_offset"))
    numbered = join_summary(lines, offsets, ["file", "_start"]).withColumn("row_number", F.col("_offset") + F.col("_at") - F.col("_first") + 1)
    return computed(numbered, text=squeeze("_line")).filter(F.col("text") != "").select("file", "row_number", "text")


def header_choice(cells: Column) -> Column:
    """0-based place of the text column that a row of cells names; NULL if it names none."""
    plain = F.transform(cells, lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", ""))
    found = [F.array_position(plain, name) for name in TEXT_COLUMNS]
    return F.coalesce(*[F.when(place > 0, place - 1) for place in found]).cast("int")


def read_csv_batch(
    spark: SparkSession, path: str, header: bool | None = None, delimiter: str = ",", columns: int | None = None
) -> DataFrame:
    """(file, row_number, text) from CSV files, each with a layout of its own.

    Per file, `header=None` decides by its first row: it is a header when it names a text
    column.  Rows with too few cells for the text column give their first non-empty cell;
    so does every row of a file without a header.  If a header leaves a file without any
    usable row, all its rows are read as texts, the header included.  `columns` says how
    wide the widest file is where its first line does not show it.
    """
    first_lines = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    widths = first_lines.agg(F.first("value").alias("line")).filter("at = 0").select(F.size(F.split("line", re.escape(delimiter))).alias("n"))
    width = max(columns or 1, widths.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    cells = [f"c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "_bad"]])
    raw = (
        spark.read.option("header", False).option("multiLine", True).option("escape", '"').option("sep", delimiter)
        .schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .csv(path)
        .select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_at"), *cells, "_bad")
    )
    # Python's csv reads a missing cell and an empty one differently; Spark does not, so
    # the cells of a short row are counted in its raw record.
    # A doubled quote ends one piece and starts the next, which leaves the count as it is.
    quoted = F.regexp_replace("_bad", '"[^"]*"', "q")
    found = F.when(F.col("_bad").isNull(), width).otherwise(F.size(F.split(quoted, re.escape(delimiter))))
    any_cell = F.coalesce(*[F.when(strip(c) != "", F.col(c)) for c in cells], F.lit(""))
    row = raw.select("file", "_at", F.array(*cells).alias("_cells"), found.alias("_found"), any_cell.alias("_any"))
    row = written(row, "csv-rows")

    # A file with quoted line breaks is read by one task, so ids within it run on by one.
    firsts = row.groupBy("file").agg(F.min(F.struct("_at", "_cells")).alias("f")).select("file", F.col("f._at").alias("_first"), header_choice(F.col("f._cells")).alias("_named"))
    if header is None:
        target = F.col("_named")
    else:
        target = F.coalesce("_named", F.lit(0)) if header else F.lit(None).cast("int")
    layout = firsts.select("file", "_first", target.alias("_target"))
    named = F.when(F.col("_found") > F.col("_target"), F.get("_cells", F.col("_target"))).otherwise(F.col("_any"))
    rows = computed(
        join_summary(row, layout, ["file"]).withColumn("row_number", F.col("_at") - F.col("_first") + 1),
        _named_text=F.when(F.col("_target").isNotNull() & (F.col("row_number") > 1), squeeze(F.coalesce(named, F.lit("")))),
        _any_text=squeeze("_any"),
    )
    usable = rows.groupBy("file").agg(F.max(F.coalesce(F.col("_named_text") != "", F.lit(False))).alias("_usable"))
    text = F.when(F.col("_usable"), F.coalesce("_named_text", F.lit(""))).otherwise(F.col("_any_text"))
    return join_summary(rows, usable, ["file"]).select("file", "row_number", text.alias("text")).filter(F.col("text") != "")


def json_texts(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """(keep, row_number, text) from JSON objects that hold a list of texts.

    The list is the first of the known keys that is present, numbered from 1; NULL and
    blank entries are kept for the caller to count and drop.
    """
    lists = F.from_json(F.col(payload), ", ".join(f"{k} array<string>" for k in JSON_LISTS))
    staged = df.select(*keep, F.json_object_keys(payload).alias("_keys"), lists.alias("_lists"))
    chosen = F.lit(None).cast("array<string>")
    for key in reversed(JSON_LISTS):
        chosen = F.when(F.array_contains("_keys", key), F.col("_lists").getField(key)).otherwise(chosen)
    return staged.select(*keep, F.posexplode(chosen).alias("_at", "_text")).select(
        *keep, (F.col("_at") + 1).cast("long").alias("row_number"), F.coalesce("_text", F.lit("")).alias("text")
    )


def read_json_batch(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_number, text); one JSON object per file."""
    raw = spark.read.text(path, wholetext=True)
    return json_texts(raw.select(F.col("_metadata.file_path").alias("file"), "value"), "value", ["file"])
