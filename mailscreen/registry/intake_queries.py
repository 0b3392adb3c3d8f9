"""Sources, batch intake and exports.  Files are written by Spark from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailscreen.functions.probability import scores_json, signals_json
from mailscreen.operators import batch
from mailscreen.operators.benchmark import FOLDER_PREFIX
from mailscreen.operators.scoring import batch_summary, prediction_columns, served_rows, with_warnings
from mailscreen.registry import sql
from mailscreen.registry.base import labelled, query, rule_scores, scored_mail, table
from mailscreen.registry.corpus_queries import MAIL_OUT, SPLIT, split_mail
from mailscreen.session import scratch_path
from mailscreen.sinks.tables import export_rows, write_export, write_splits
from mailscreen.sources import labelled_csv, mail_files, splits, uploads
from mailscreen.streaming.file_drop import score_stream, stream_files


def write_csv(df, path):
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**options).mode("overwrite").csv(path)


@query("source_kaggle_shape", f"WITH {sql.MAIL} SELECT email_id, 'kaggle_venky73_spam_mails' AS source, label, label_name, text, text_length FROM mail")
def source_kaggle_shape(spark, folder):
    name = F.when(F.col("toxic") == 1, " Spam").when(F.col("toxic") == 0, "HAM ").otherwise("unknown")
    rows = labelled(spark, folder, "left").select("doc_id", name.alias("label"), "text", F.col("toxic").cast("double").alias("label_num"))
    path = scratch_path(spark, "kaggle")
    # Columns in an order of their own, labels as 0.0 and 1.0.
    write_csv(rows.select("text", "label_num", F.col("doc_id").alias("Unnamed: 0"), "label"), path)
    return labelled_csv.read_kaggle(spark, path)


@query(
    "source_enron_shape",
    f"""SELECT id AS email_id, 'enron_spam_setfit' AS source, label, {sql.name_of('label')} AS label_name, text, length(text)::INT AS text_length
        FROM (SELECT d.doc_id::VARCHAR AS id, l.toxic AS label, {sql.clean("d.source || chr(10) || d.text")} AS text
              FROM documents d JOIN labels l USING (doc_id))""",
)
def source_enron_shape(spark, folder):
    rows = labelled(spark, folder).select(
        F.col("doc_id").alias("message_id"), "text", F.col("toxic").cast("double").alias("label"), F.concat(F.lit("  "), "source", F.lit(" ")).alias("subject"),
    )
    path = scratch_path(spark, "enron")
    # Without the optional columns, and in another order.
    write_csv(rows.select("subject", "label", "text", "message_id"), path)
    return labelled_csv.read_enron(spark, path)


@query(
    "source_mail_files",
    f"""SELECT page_id::VARCHAR AS email_id, 'spamassassin_easy_ham' AS source, 0 AS label, 'ham' AS label_name, text, length(text)::INT AS text_length
        FROM (SELECT page_id, {sql.clean("'Page ' || page_id || chr(10) || " + sql.strip_html('html'))} AS text FROM pages)""",
)
def source_mail_files(spark, folder):
    header = F.concat(
        F.lit("From: a@b.example\nSubject: Page "), "page_id",
        F.lit("\nMIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"),
    )
    body = F.base64(F.encode("html", "UTF-8"))
    # Messages as a folder read gives them; tests/test_sources.py reads folders themselves.
    files = table(spark, folder, "pages").select(
        F.concat(F.lit("mails/easy_ham/"), "page_id").alias("path"), F.encode(F.concat(header, body), "UTF-8").alias("content")
    )
    return mail_files.mail_corpus(mail_files.parse_messages(files), FOLDER_PREFIX + "easy_ham")


@query("scan_split", f"WITH {SPLIT} SELECT {MAIL_OUT} FROM parted WHERE split = 'test'")
def scan_split(spark, folder):
    path = scratch_path(spark, "splits")
    write_splits(split_mail(spark, folder), path)
    return splits.read_splits(spark, path, "test").drop("split")


@query("write_read_splits", f"WITH {SPLIT} SELECT split, label, count(*) AS rows, sum(text_length)::BIGINT AS chars FROM parted GROUP BY split, label")
def write_read_splits(spark, folder):
    path = scratch_path(spark, "splits")
    write_splits(split_mail(spark, folder), path)
    return splits.read_splits(spark, path).groupBy("split", "label").agg(F.count("*").alias("rows"), F.sum("text_length").alias("chars"))


_LINES = r"regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]')"


@query(
    "batch_from_lines",
    f"""SELECT doc_id, row_number, text FROM (SELECT doc_id, row_number, {sql.squeeze('line')} AS text FROM (
          SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS row_number FROM documents)) WHERE text <> ''""",
)
def batch_from_lines(spark, folder):
    return uploads.text_lines(table(spark, folder, "documents"), "text", ["doc_id"])


def write_line_files(documents, path):
    """Text files dealt by document; their number follows the session's partitions, so that none grows with the table."""
    documents.repartition("doc_id").select("text").write.mode("overwrite").text(path)


@query(
    "batch_from_line_files",
    f"""SELECT count(*) AS lines, sum(length(text))::BIGINT AS chars, count(DISTINCT text) AS texts FROM (SELECT {sql.squeeze('line')} AS text FROM (
          SELECT unnest({_LINES}) AS line FROM documents)) WHERE text <> ''""",
)
def batch_from_line_files(spark, folder):
    path = scratch_path(spark, "lines")
    write_line_files(table(spark, folder, "documents"), path)
    rows = uploads.read_line_files(spark, path)
    return rows.agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.countDistinct("text").alias("texts"))


@query("batch_from_csv", f"SELECT text FROM (SELECT {sql.squeeze('text')} AS text FROM documents) WHERE text <> ''")
def batch_from_csv(spark, folder):
    path = scratch_path(spark, "csv")
    write_csv(table(spark, folder, "documents").select("doc_id", "source", F.col("text").alias("E-Mail"), "lang"), path)
    return uploads.read_csv_batch(spark, path).select("text")


def _source():
    return F.regexp_extract("file", "source=([^/]+)", 1).alias("source")


@query(
    "batch_line_file_rows",
    f"""SELECT source, row_number, text FROM (SELECT source, {sql.squeeze('line')} AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS row_number FROM (
          SELECT source, doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS i FROM documents)) WHERE text <> ''""",
)
def batch_line_file_rows(spark, folder):
    """Every line of one file per source, with the number it has in its file."""
    path = scratch_path(spark, "line-rows")
    rows = table(spark, folder, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").mode("overwrite").text(path)
    return uploads.read_line_files(spark, f"{path}/source=*").select(_source(), "row_number", "text")


_HEADED = "source < 'src3'"


@query(
    "batch_csv_layouts",
    f"""SELECT source, row_number, CASE WHEN text <> '' OR {_HEADED} THEN text ELSE lang END AS text FROM (
          SELECT source, lang, {sql.squeeze('text')} AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id) + CASE WHEN {_HEADED} THEN 1 ELSE 0 END AS row_number
          FROM documents) WHERE text <> '' OR NOT ({_HEADED})""",
)
def batch_csv_layouts(spark, folder):
    """One file per source; some name their text column in a header, the others give their first cell that is not empty."""
    path = scratch_path(spark, "layouts")
    rows = table(spark, folder, "documents").repartition("source").sortWithinPartitions("source", "doc_id")
    quoted = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    named = rows.where(_HEADED).select("source", "doc_id", F.col("text").alias("E-Mail"), "lang")
    plain = rows.where(f"NOT ({_HEADED})").select("source", "text", "lang")
    for name, part, header in (("named", named, True), ("plain", plain, False)):
        part.write.options(header=header, **quoted).partitionBy("source").mode("overwrite").csv(f"{path}/{name}")
    return uploads.read_csv_batch(spark, f"{path}/*/source=*").select(_source(), "row_number", "text")


@query(
    "batch_from_json",
    f"""SELECT doc_id, row_number, text, 'ok' AS status FROM (SELECT doc_id, row_number, {sql.squeeze('line')} AS text FROM (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS row_number
          FROM documents)) WHERE text <> ''""",
)
def batch_from_json(spark, folder):
    lines = F.split("text", "\n")
    payload = (
        F.when(F.col("lang") == "en", F.to_json(F.struct(lines.alias("texts"))))
        .when(F.col("lang") == "de", F.to_json(F.struct(lines.alias("emails"), F.array(F.lit("x")).alias("messages"))))
        .otherwise(F.to_json(F.struct(lines.alias("messages"))))
    )
    rows = uploads.json_texts(table(spark, folder, "documents").select("doc_id", payload.alias("payload")), "payload", ["doc_id"])
    return batch.check_texts(rows).filter(F.col("status") != batch.BLANK).select("doc_id", "row_number", "text", "status")


@query(
    "decode_files",
    """SELECT doc_id, CASE WHEN source IN ('src3', 'src4') THEN NULL ELSE text END AS text,
         CASE source WHEN 'src3' THEN 'decode_error' WHEN 'src4' THEN 'empty_file' END AS error_code FROM documents""",
)
def decode_files(spark, folder):
    source, text = F.col("source"), F.col("text")
    narrow = text.rlike(r"^[\x00-\x7f\x{a1}\x{bf}\x{c0}-\x{cb}\x{cd}-\x{d1}\x{d3}-\x{dd}\x{df}-\x{eb}\x{ed}-\x{f1}\x{f3}-\x{fd}\x{ff}]*\z")
    # Only characters that both code pages agree on may be written in one byte.
    same = ~text.rlike(r"[\x{c3}\x{d0}\x{d5}\x{dd}\x{e3}\x{f0}\x{f5}\x{fd}]")
    content = (
        F.when(source == "src1", F.concat(F.to_binary(F.lit("EFBBBF"), F.lit("hex")), F.encode(text, "UTF-8")))
        .when((source == "src2") & narrow & same, F.encode(text, "ISO-8859-1"))
        .when(source == "src3", F.encode(F.concat(text, F.lit("\x00")), "UTF-8"))
        .when(source == "src4", F.to_binary(F.lit(""), F.lit("hex")))
        .otherwise(F.encode(text, "UTF-8"))
    )
    files = table(spark, folder, "documents").select("doc_id", content.alias("content"))
    return uploads.with_decoded(files).select("doc_id", "text", "error_code")


@query(
    "raw_corpus",
    f"""WITH raw AS (
          SELECT doc_id::VARCHAR AS row, 'kaggle_raw' AS source, l.toxic AS label, {sql.name_of('l.toxic')} AS label_name,
                 {sql.strip('d.text')} AS text, l.toxic IS NOT NULL AS keep FROM documents d LEFT JOIN labels l USING (doc_id)
          UNION ALL
          SELECT conv_id || '-' || turn, 'enron_raw', CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END,
                 CASE role WHEN 'user' THEN 'spam' ELSE 'ham' END, {sql.strip('text')}, role <> 'system' FROM conversations),
        capped AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || row), row) - 1 AS i FROM raw)
        SELECT source || '_' || i AS email_id, source, label, label_name, text, length(text)::INT AS text_length
        FROM capped WHERE i < 300 AND keep AND text <> ''""",
)
def raw_corpus(spark, folder):
    name = F.when(F.col("toxic") == 1, " SPAM").when(F.col("toxic") == 0, "ham").otherwise("?")
    kaggle = labelled(spark, folder, "left").select(F.col("doc_id").cast("string").alias("row"), name.alias("label"), "text")
    number = F.when(F.col("role") == "user", "1").when(F.col("role") == "assistant", " 2 ").otherwise("n/a")
    enron = table(spark, folder, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), "text", number.alias("label"))
    return labelled_csv.raw_corpus([labelled_csv.raw_kaggle(kaggle), labelled_csv.raw_enron(enron)], cap=300)


def split_lines(spark, folder):
    """Every line of every document, blank ones included."""
    return table(spark, folder, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("row_number", "text"))


_CHECKED = f"""checked AS (SELECT doc_id, source, length(text)::INT AS n,
    CASE WHEN text = '' THEN 'blank' WHEN length(text) > 2000 THEN 'text_too_large' ELSE 'ok' END AS status
  FROM (SELECT doc_id, source, {sql.squeeze('line')} AS text FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)))"""


@query("batch_blank_filter", f"WITH {_CHECKED} SELECT source, count(*) FILTER (status <> 'blank') AS kept, count(*) FILTER (status = 'blank') AS blank FROM checked GROUP BY source")
def batch_blank_filter(spark, folder):
    checked = batch.check_texts(split_lines(spark, folder), max_length=2000)
    blank = (F.col("status") == "blank").cast("long")
    return checked.groupBy("source").agg(F.sum(1 - blank).alias("kept"), F.sum(blank).alias("blank"))


@query(
    "batch_quarantine",
    f"""SELECT doc_id, length(text)::INT AS text_length, CASE WHEN length(text) > 5000 THEN 'text_too_large' WHEN text = '' THEN 'blank' ELSE 'ok' END AS status
        FROM (SELECT doc_id, {sql.squeeze('text')} AS text FROM documents) WHERE text <> ''""",
)
def batch_quarantine(spark, folder):
    checked = batch.check_texts(table(spark, folder, "documents").select("doc_id", "text"), max_length=5000)
    good = batch.validate(checked).withColumn("status", F.lit("ok"))
    return good.unionByName(batch.rejected(checked)).select("doc_id", F.length("text").alias("text_length"), "status")


@query(
    "batch_status",
    f"""WITH {_CHECKED}, c AS (SELECT count(*) AS rows, count(*) FILTER (status = 'ok') AS accepted,
          count(*) FILTER (status = 'blank') AS blank, count(*) FILTER (status = 'text_too_large') AS too_large FROM checked)
        SELECT *, CASE WHEN too_large > 0 THEN 'text_too_large' WHEN accepted = 0 THEN 'empty_batch' WHEN accepted > 5000 THEN 'batch_too_large' ELSE 'ok' END AS code FROM c""",
)
def batch_status(spark, folder):
    return batch.batch_status(batch.check_texts(split_lines(spark, folder), max_length=2000), max_rows=5000)


def served(spark, folder):
    rows = prediction_columns(scored_mail(spark, folder, digits=None), "rule")
    return served_rows(rows, ["doc_id"], model_source="rules")


@query(
    "score_batch",
    f"""WITH {sql.SCORED_UNROUNDED} SELECT doc_id, text, CASE WHEN length(text) > 140 THEN substring(text, 1, 139) || '...' ELSE text END AS text_preview,
          CASE WHEN prediction = 1 THEN 'spam' ELSE 'ham' END AS label, prediction AS label_id, round_even(confidence, 4) AS confidence,
          round_even(p * 2 - 1, 4) AS decision_score, round_even(p, 4) AS spam_probability, round_even(1 - p, 4) AS ham_probability, 'rule' AS model_name, 'rules' AS model_source,
          to_json({{'spam': round_even(p, 4), 'ham': round_even(1 - p, 4)}}) AS scores, '[]' AS top_signals FROM scored""",
)
def score_batch(spark, folder):
    return served(spark, folder).withColumns({"scores": scores_json(F.col("scores")), "top_signals": signals_json(F.col("top_signals"))})


@query(
    "batch_summary",
    f"WITH {sql.SCORED} SELECT count(*) AS total, count(*) FILTER (prediction = 1) AS spam, count(*) FILTER (prediction = 0) AS ham, 'documents' AS source FROM scored",
)
def summary_of_batch(spark, folder):
    return batch_summary(served(spark, folder), "documents")


@query(
    "batch_warnings",
    f"""WITH lines AS (SELECT {sql.squeeze('line')} AS text FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
        scored AS (SELECT CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction FROM (SELECT {sql.rule_probability('text')} AS p FROM lines WHERE text <> ''))
        SELECT count(*) AS total, count(*) FILTER (prediction = 1) AS spam, count(*) FILTER (prediction = 0) AS ham, 'lines' AS source,
          (SELECT CASE WHEN count(*) > 0 THEN count(*) || ' blank rows were left out.' ELSE '' END FROM lines WHERE text = '') AS warnings FROM scored""",
)
def batch_warnings(spark, folder):
    lines = table(spark, folder, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    checked = batch.check_texts(lines)
    scored = prediction_columns(rule_scores(batch.accepted(checked)))
    return with_warnings(batch_summary(scored, "lines", "predicted_label"), checked).withColumn("warnings", F.array_join("warnings", "; "))


@query(
    "batch_export",
    f"""WITH {sql.SCORED_UNROUNDED} SELECT doc_id::VARCHAR AS row, text, CASE WHEN length(text) > 140 THEN substring(text, 1, 139) || '...' ELSE text END AS preview,
          CASE WHEN prediction = 1 THEN 'spam' ELSE 'ham' END AS label, round_even(confidence, 4) AS confidence,
          round_even(p, 4) AS spam_probability, round_even(1 - p, 4) AS ham_probability, '[]' AS top_signals FROM scored""",
)
def batch_export(spark, folder):
    path = scratch_path(spark, "export")
    write_export(served(spark, folder), path, row="doc_id")
    columns = export_rows(served(spark, folder), "doc_id").columns
    rows = labelled_csv.read_quoted_csv(spark, path, tuple(columns))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("confidence", "spam_probability", "ham_probability")})


@query(
    "stream_score",
    f"""SELECT doc_id, status, p AS spam_probability FROM (
          SELECT doc_id, 'ok' AS status, {sql.rule_probability('text')} AS p
          FROM (SELECT doc_id, {sql.squeeze('text')} AS text FROM documents) WHERE text <> '')""",
)
def stream_score(spark, folder):
    drop, out, checkpoint = (scratch_path(spark, p) for p in ("drop", "scored", "progress"))
    documents = table(spark, folder, "documents").select("doc_id", "text")
    documents.repartition(8, "doc_id").write.mode("overwrite").json(drop)
    running = score_stream(stream_files(spark, drop, documents.schema, max_files=3), rule_scores, out, checkpoint)
    running.awaitTermination()
    return spark.read.parquet(out).select("doc_id", "status", "spam_probability")
