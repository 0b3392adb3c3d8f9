import pytest
from pyspark.sql import functions as F

from mailscreen.operators import corpus as ops
from mailscreen.plans.prepare import prepare_corpus
from mailscreen.sinks.tables import write_split_csv
from mailscreen.sources.splits import read_split_csv


def test_first_of_equal_texts_stays(texts):
    df = texts(["Free offer!", "free  OFFER !", "Meeting"], label=[1, 1, 0])
    kept = {r["id"] for r in ops.keep_first(df, ["id"]).collect()}
    assert kept == {0, 2}


def test_one_row_per_text_even_with_equal_order_keys(texts):
    df = texts(["same"] * 200 + ["other"]).withColumn("rank", F.lit(1)).repartition(7)
    assert ops.keep_first(df, ["rank"]).count() == 2


def test_finalize_drops_blank_and_unlabelled(spark):
    rows = [("1", "<b></b>", "1"), ("2", "hi", "0"), (" 3 ", "yo", "2"), ("4", "ok", None), (None, "a", "1"), ("6", "x", "spam")]
    df = spark.createDataFrame(rows, "k string, t string, l string")
    got = {(r["email_id"], r["label_name"], r["text_length"]) for r in ops.finalize(df, "s", "k", "t", "l").collect()}
    assert got == {("2", "ham", 2), ("", "spam", 1)}


def test_union_skips_missing_and_needs_rows(spark, texts):
    a, b = texts(["x"]), texts(["y"])
    got = ops.union_sources([a, None, b])
    assert sorted(r["source_rank"] for r in got.collect()) == [0, 2]
    with pytest.raises(ValueError):
        ops.union_sources([None])
    with pytest.raises(RuntimeError):
        ops.require_rows(a.limit(0))


def test_lookup_and_filters(spark):
    df = spark.createDataFrame([("a", "s1", 1, 5), ("a", "s2", 0, 2), ("b", "s1", 0, 1)], "email_id string, source string, label int, n int")
    assert ops.find_mail(df, "a", ["n"]).first()["source"] == "s2"
    assert ops.find_mail(df, "none", ["n"]).count() == 0
    assert ops.select_mail(df, label=0, source="s1").first()["email_id"] == "b"
    assert ops.select_mail(df).count() == 3


def test_empty_tables_give_zero_rows_of_numbers(spark):
    empty = spark.createDataFrame([], "label int, text_length int, source string")
    assert ops.label_totals(empty).first().asDict() == {"total": 0, "spam": 0, "ham": 0}
    assert ops.length_stats(empty).first()["max_length"] == 0
    assert {r["label"]: r["weight"] for r in ops.class_weights(empty).collect()} == {0: 0.0, 1: 0.0}


def test_prepare_is_disjoint_complete_and_repeatable(spark, tmp_path):
    rows = [(str(i), f"{'spam' if i % 2 else 'ham'} message {i}", i % 2) for i in range(40)] + [("99", "SPAM  message 1", 1)]
    df = spark.createDataFrame(rows, "k string, t string, l int")
    source = ops.finalize(df, "s", "k", "t", "l")
    one = prepare_corpus([source])
    two = prepare_corpus([source.repartition(8)])
    split = {r["email_id"]: r["split"] for r in one.rows.collect()}
    assert split == {r["email_id"]: r["split"] for r in two.rows.collect()}
    assert len(split) == 40 and "99" not in split
    summary = one.summary.first()
    assert (summary["test_size"], summary["validation_size"], summary["train_size"]) == (6, 6, 28)
    assert summary["source_counts"] == {"s": 40}
    write_split_csv(one.rows, str(tmp_path / "csv"))
    assert read_split_csv(spark, str(tmp_path / "csv" / "test")).count() == 6
