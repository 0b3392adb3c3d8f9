"""Cleaning, statistics and probability functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailscreen.functions import probability as prob
from mailscreen.functions import text as tx
from mailscreen.functions.stats import with_email_stats
from mailscreen.registry import sql
from mailscreen.registry.base import mail, query, rule_scores, scored_mail, table


@query("strip_html", f"SELECT page_id, {sql.strip_html('html')} AS text FROM pages")
def strip_html(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.strip_html("html").alias("text"))


@query("mask_urls", f"SELECT page_id, {sql.mask_urls('html')} AS text FROM pages")
def mask_urls(spark, folder):
    return table(spark, folder, "pages").select("page_id", tx.mask_urls("html").alias("text"))


@query("mask_emails", f"SELECT doc_id, {sql.mask_addresses('text')} AS text FROM documents")
def mask_emails(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.mask_addresses("text").alias("text"))


@query("normalize_ws", f"SELECT doc_id, {sql.normalize('text')} AS text FROM documents")
def normalize_ws(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.normalize_whitespace("text").alias("text"))


@query(
    "clean_text",
    f"""SELECT 'doc-' || doc_id AS id, {sql.clean('text')} AS text FROM documents
        UNION ALL SELECT 'page-' || page_id, {sql.clean('html')} FROM pages
        UNION ALL SELECT 'turn-' || conv_id || '-' || turn, {sql.clean('text')} FROM conversations""",
)
def clean_text(spark, folder):
    documents = table(spark, folder, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "text")
    pages = table(spark, folder, "pages").select(F.concat(F.lit("page-"), "page_id").alias("id"), F.col("html").alias("text"))
    turns = table(spark, folder, "conversations").select(F.concat(F.lit("turn-"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return documents.union(pages).union(turns).select("id", tx.clean_text("text").alias("text"))


@query("dedupe_key", f"SELECT doc_id, sha256(lower({sql.clean('text')})) AS text_key FROM documents")
def dedupe_key(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.dedupe_hash("text").alias("text_key"))


_PAGE_STATS = ", ".join(f"{value} AS {name}" for name, value in sql.stats("html").items())


@query("email_stats", f"SELECT page_id, {_PAGE_STATS} FROM (SELECT page_id, html, {sql.clean('html')} AS c FROM pages)")
def email_stats(spark, folder):
    return with_email_stats(table(spark, folder, "pages"), "html", ["page_id"])


@query(
    "text_preview",
    r"""SELECT doc_id,
          CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS sample_preview,
          CASE WHEN length(text) > 140 THEN substring(text, 1, 139) || '...' ELSE text END AS served_preview,
          replace(substring(text, 1, 180), chr(10), ' ') AS report_preview,
          length(text)::INT AS text_length
        FROM documents""",
)
def text_preview(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        tx.sample_preview("text").alias("sample_preview"),
        tx.served_preview("text").alias("served_preview"),
        tx.report_preview("text").alias("report_preview"),
        F.length("text").alias("text_length"),
    )


@query(
    "stable_softmax",
    """WITH l AS (SELECT doc_id,
            CASE source WHEN 'src0' THEN 'nan'::DOUBLE WHEN 'src1' THEN 'inf'::DOUBLE ELSE n_chars / 100.0::DOUBLE END AS h,
            CASE source WHEN 'src2' THEN '-inf'::DOUBLE WHEN 'src3' THEN 'inf'::DOUBLE ELSE doc_id / 50.0::DOUBLE END AS s
          FROM documents),
        f AS (SELECT doc_id,
            CASE WHEN isnan(h) THEN 0 WHEN isinf(h) THEN sign(h) * 10000 ELSE h END AS h,
            CASE WHEN isnan(s) THEN 0 WHEN isinf(s) THEN sign(s) * 10000 ELSE s END AS s FROM l),
        e AS (SELECT doc_id, exp(greatest(h - greatest(h, s), -745)) AS h, exp(greatest(s - greatest(h, s), -745)) AS s FROM f)
        SELECT doc_id, round(h / (h + s), 6) AS ham, round(s / (h + s), 6) AS spam FROM e""",
)
def stable_softmax(spark, folder):
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    source = F.col("source")
    ham = F.when(source == "src0", nan).when(source == "src1", inf).otherwise(F.col("n_chars") / 100.0)
    spam = F.when(source == "src2", -inf).when(source == "src3", inf).otherwise(F.col("doc_id") / 50.0)
    both = table(spark, folder, "documents").select("doc_id", prob.stable_softmax(ham, spam).alias("p"))
    return both.select("doc_id", F.round("p.ham", 6).alias("ham"), F.round("p.spam", 6).alias("spam"))


@query(
    "decision_score",
    f"""WITH {sql.MAIL} SELECT doc_id, round({sql.rule_probability('text', None)} * 2 - 1, 6) AS centred_score,
          round({sql.rule_logit('text')}, 6) AS logit_score FROM mail""",
)
def decision_score(spark, folder):
    p = F.col("spam_probability")
    rows = rule_scores(mail(spark, folder), digits=None, logit="z")
    logit = prob.logit_difference(F.lit(0.0), F.col("z"))
    return rows.select("doc_id", F.round(prob.centred_score(p), 6).alias("centred_score"), F.round(logit, 6).alias("logit_score"))


@query(
    "prediction_fields",
    f"""WITH {sql.SCORED} SELECT doc_id, CASE WHEN prediction = 1 THEN 'spam' ELSE 'ham' END AS predicted_label,
          round(p, 6) AS spam_probability, round(1 - p, 6) AS ham_probability, round(confidence, 6) AS confidence FROM scored""",
)
def prediction_fields(spark, folder):
    p = F.col("spam_probability")
    return scored_mail(spark, folder).select(
        "doc_id",
        prob.label_name(F.col("prediction")).alias("predicted_label"),
        F.round(p, 6).alias("spam_probability"),
        F.round(prob.ham_probability(p), 6).alias("ham_probability"),
        F.round(prob.confidence(p), 6).alias("confidence"),
    )
