"""Corpus building, splitting and sampling over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailscreen.operators import corpus as ops
from mailscreen.operators import sampling
from mailscreen.operators.benchmark import heldout_ham
from mailscreen.plans.prepare import prepare_corpus
from mailscreen.registry import sql
from mailscreen.registry.base import HAM_SOURCES, labelled, mail, query, table

MAIL_OUT = "email_id, source, label, label_name, text, text_length"


@query("finalize_rows", f"WITH {sql.MAIL} SELECT {MAIL_OUT} FROM mail")
def finalize_rows(spark, folder):
    rows = labelled(spark, folder, "left")
    return ops.finalize(rows, F.col("source"), "doc_id", "text", "toxic")


def three_sources(spark, folder):
    """Labelled documents, conversation turns (ham) and pages (ham), with a numeric row order."""
    documents = mail(spark, folder).withColumnRenamed("doc_id", "row_order")
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.lit(0).alias("zero"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_order")
    )
    pages = table(spark, folder, "pages").select("page_id", "html", F.lit(0).alias("zero"), F.col("page_id").alias("row_order"))
    return [
        documents,
        ops.finalize(turns, "conversations", "id", "text", "zero", extra=("row_order",)),
        ops.finalize(pages, "pages", "page_id", "html", "zero", extra=("row_order",)),
    ]


UNION = f"""{sql.MAIL},
joined AS (
  SELECT {MAIL_OUT}, 0 AS source_rank, doc_id AS row_order FROM mail
  UNION ALL
  SELECT id, 'conversations', 0, 'ham', text, length(text)::INT, 1, row_order FROM (
    SELECT conv_id || '-' || turn AS id, {sql.clean('text')} AS text, conv_id * 1000 + turn AS row_order FROM conversations) WHERE length(text) > 0
  UNION ALL
  SELECT page_id::VARCHAR, 'pages', 0, 'ham', text, length(text)::INT, 2, page_id FROM (
    SELECT page_id, {sql.clean('html')} AS text FROM pages) WHERE length(text) > 0
)"""

FIRST = f"""{UNION},
keyed AS (SELECT *, sha256(lower({sql.clean('text')})) AS text_key FROM joined),
corpus AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY text_key ORDER BY source_rank, row_order, email_id) = 1)"""


@query("corpus_union", f"WITH {UNION} SELECT {MAIL_OUT}, source_rank FROM joined")
def corpus_union(spark, folder):
    return ops.union_sources(three_sources(spark, folder)).drop("row_order")


@query(
    "dedupe_first",
    f"""SELECT doc_id, source, lang FROM (SELECT *, sha256(lower({sql.clean('text')})) AS k FROM documents)
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1""",
)
def dedupe_first(spark, folder):
    rows = table(spark, folder, "documents")
    return ops.keep_first(rows, ["doc_id"], key=ops.dedupe_hash("text")).select("doc_id", "source", "lang")


@query(
    "prepare_dataset",
    f"""WITH {FIRST}, {sql.split_ctes('corpus', 'text_key')}
        SELECT email_id, source, label, text_length, split FROM parted""",
)
def prepare_dataset(spark, folder):
    corpus = prepare_corpus(three_sources(spark, folder), order=["source_rank", "row_order", "email_id"])
    return corpus.rows.select("email_id", "source", "label", "text_length", "split")


SPLIT = f"{sql.MAIL}, {sql.split_ctes('mail', 'doc_id')}"


def split_mail(spark, folder):
    return sampling.stratified_split(mail(spark, folder), ["doc_id"])


@query("stratified_split", f"WITH {SPLIT} SELECT doc_id, label, split FROM parted")
def stratified_split(spark, folder):
    return split_mail(spark, folder).select("doc_id", "label", "split")


@query("refit_set", f"WITH {SPLIT} SELECT doc_id, label, text_length FROM parted WHERE split IN ('train', 'validation')")
def refit_set(spark, folder):
    return split_mail(spark, folder).filter(F.col("split").isin("train", "validation")).select("doc_id", "label", "text_length")


@query("heldout_ham", f"WITH {SPLIT} SELECT doc_id, source, text_length FROM parted WHERE split = 'test' AND label = 0 AND source IN ('src1', 'src2', 'src3')")
def heldout(spark, folder):
    test = split_mail(spark, folder).filter(F.col("split") == "test")
    return heldout_ham(test, HAM_SOURCES).select("doc_id", "source", "text_length")


@query(
    "dataset_summary",
    f"""WITH {SPLIT} SELECT count(*) AS total_samples, sum(label)::BIGINT AS spam_samples, (count(*) FILTER (label = 0)) AS ham_samples,
          round(avg(text_length), 6) AS average_length, count(*) FILTER (split = 'train') AS train_size,
          count(*) FILTER (split = 'validation') AS validation_size, count(*) FILTER (split = 'test') AS test_size,
          (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM parted GROUP BY source)) AS source_counts
        FROM parted""",
)
def dataset_summary(spark, folder):
    summary = ops.dataset_summary(split_mail(spark, folder))
    entries = F.array_sort(F.map_entries("source_counts"))
    pairs = F.transform(entries, lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return summary.withColumns(
        {"average_length": F.round("average_length", 6), "source_counts": F.array_join(pairs, ",")}
    )


@query("source_counts", f"WITH {sql.MAIL} SELECT source, count(*) AS rows FROM mail GROUP BY source")
def source_counts(spark, folder):
    return ops.source_counts(mail(spark, folder))


@query(
    "stats_by_source",
    f"""WITH {sql.MAIL} SELECT source, count(*) AS total, count(*) FILTER (label = 1) AS spam, count(*) FILTER (label = 0) AS ham
        FROM mail GROUP BY source""",
)
def stats_by_source(spark, folder):
    return ops.stats_by_source(mail(spark, folder))


@query(
    "label_totals",
    f"WITH {sql.MAIL} SELECT count(*) AS total, count(*) FILTER (label = 1) AS spam, count(*) FILTER (label = 0) AS ham FROM mail",
)
def label_totals(spark, folder):
    return ops.label_totals(mail(spark, folder))


@query("source_diversity", f"WITH {sql.MAIL} SELECT count(DISTINCT source) AS sources, count(DISTINCT source) > 1 AS diverse FROM mail")
def source_diversity(spark, folder):
    return ops.source_diversity(mail(spark, folder))


@query(
    "length_stats",
    f"""WITH {sql.MAIL} SELECT count(*) AS total, count(*) FILTER (label = 1) AS spam, count(*) FILTER (label = 0) AS ham,
          round(avg(label), 6) AS spam_ratio, round(avg(text_length), 6) AS avg_length, min(text_length) AS min_length, max(text_length) AS max_length
        FROM mail""",
)
def length_stats(spark, folder):
    stats = ops.length_stats(mail(spark, folder))
    return stats.withColumns({c: F.round(c, 6) for c in ("spam_ratio", "avg_length")})


@query(
    "class_weights",
    f"""WITH {sql.MAIL} SELECT label, round((SELECT count(*) FROM mail) / (2.0::DOUBLE * n), 6) AS weight
        FROM (SELECT label, count(*) AS n FROM mail GROUP BY label)""",
)
def class_weights(spark, folder):
    return ops.class_weights(mail(spark, folder)).select("label", F.round("weight", 6).alias("weight"))


@query("filter_label_source", f"WITH {sql.MAIL} SELECT {MAIL_OUT} FROM mail WHERE label = 1 AND source <> 'src7' OR source = 'src5'")
def filter_label_source(spark, folder):
    rows = mail(spark, folder).drop("doc_id")
    spam = ops.select_mail(rows, label=1).filter((F.col("source") != "src7") & (F.col("source") != "src5"))
    return spam.unionByName(ops.select_mail(rows, source="src5"))


@query(
    "lookup_id",
    """SELECT conv_id::VARCHAR AS email_id, turn, text FROM conversations
       WHERE conv_id = (SELECT max(conv_id) FROM conversations) ORDER BY turn LIMIT 1""",
)
def lookup_id(spark, folder):
    turns = table(spark, folder, "conversations").select(F.col("conv_id").cast("string").alias("email_id"), "turn", "text")
    wanted = table(spark, folder, "conversations").agg(F.max("conv_id")).first()[0]
    return ops.find_mail(turns, str(wanted), ["turn"])


@query(
    "length_bands",
    f"""WITH {sql.MAIL}
        SELECT * FROM (SELECT 'very_short' AS band, doc_id, text_length FROM mail WHERE text_length < 50 ORDER BY doc_id LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'medium', doc_id, text_length FROM mail WHERE text_length BETWEEN 200 AND 500 ORDER BY doc_id LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'very_long', doc_id, text_length FROM mail ORDER BY text_length DESC, doc_id LIMIT 5)""",
)
def length_bands(spark, folder):
    rows = mail(spark, folder).select("doc_id", "text_length")
    return ops.length_bands(rows, ["doc_id"]).select("band", "doc_id", "text_length")


@query("longest_texts", f"WITH {sql.MAIL} SELECT doc_id, text_length, text FROM mail ORDER BY text_length DESC, doc_id LIMIT 5")
def longest_texts(spark, folder):
    return ops.longest(mail(spark, folder), ["doc_id"]).select("doc_id", "text_length", "text")


@query("labels_join", f"WITH {sql.MAIL} SELECT doc_id, label, sha256(text) AS text_hash FROM mail")
def labels_join(spark, folder):
    return mail(spark, folder).select("doc_id", "label", F.sha2("text", 256).alias("text_hash"))


_PREVIEW = "CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS text_preview"


@query(
    "sample_display",
    f"""WITH {sql.MAIL} SELECT email_id, label_name, {_PREVIEW}, text_length, source FROM mail
        ORDER BY md5('42|' || doc_id), doc_id LIMIT 20""",
)
def sample_display(spark, folder):
    return sampling.sample_listing(mail(spark, folder), 20, ["doc_id"])


@query("sample_one", f"WITH {sql.MAIL} SELECT {MAIL_OUT} FROM mail WHERE label = 1 AND source = 'src7' ORDER BY md5('7|' || doc_id) LIMIT 1")
def sample_one(spark, folder):
    return sampling.sample_rows(ops.select_mail(mail(spark, folder), 1, "src7"), 1, ["doc_id"], seed=7).drop("doc_id")


@query(
    "sample_per_source",
    """SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id)) <= 25""",
)
def sample_per_source(spark, folder):
    return sampling.cap_per_group(table(spark, folder, "documents"), "source", 25, ["doc_id"]).select("doc_id", "source")


@query(
    "sample_with_replacement",
    """WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS place FROM documents),
        n AS (SELECT count(*) AS n FROM documents),
        draws AS (SELECT i AS draw, ('0x' || substr(md5('42|draw|' || i), 1, 15))::BIGINT % n AS place FROM n, range(0, (SELECT n FROM n)) t(i))
        SELECT draw, doc_id FROM draws JOIN placed USING (place)""",
)
def sample_with_replacement(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id")
    return sampling.sample_with_replacement(rows, rows.count(), ["doc_id"]).select("draw", "doc_id")
