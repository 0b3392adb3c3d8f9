import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailscreen.functions import probability as prob
from mailscreen.operators import scoring
from mailscreen.sinks.tables import write_export
from mailscreen.sources.uploads import read_csv_batch


def test_softmax_stays_finite(spark):
    inf = float("inf")
    rows = [(10000.0, -10000.0), (float("nan"), inf), (-inf, -inf), (0.0, 1.0), (-1e300, 1e300)]
    got = spark.createDataFrame(rows, "h double, s double").select(prob.stable_softmax(F.col("h"), F.col("s")).alias("p")).select("p.*").collect()
    assert all(math.isfinite(r["ham"]) and r["ham"] + r["spam"] == pytest.approx(1.0) for r in got)
    assert got[0]["ham"] == 1.0 and got[1]["spam"] == 1.0 and got[2]["ham"] == 0.5
    assert got[3]["spam"] == pytest.approx(1 / (1 + math.exp(-1)))


def test_display_values(spark):
    row = spark.range(1).select(
        prob.display_number(F.lit(0.00005)).alias("even"), prob.display_number(F.lit(float("nan"))).alias("nan"),
        prob.display_feature(F.lit("word_tfidf__free money")).alias("name"), prob.plugin_model_name(F.lit("microsoft/DeBERTa-v3-base")).alias("slug"),
        prob.plugin_model_name(F.lit("x/--")).alias("none"),
    ).first()
    assert row["even"] == 0.0 and row["nan"] is None and row["name"] == "free money"
    assert row["slug"] == "contextual_deberta_v3_base" and row["none"] == "contextual_transformer"


def test_one_half_is_ham(spark):
    got = scoring.prediction_columns(spark.createDataFrame([(0.5,), (0.51,)], "spam_probability double"), "m").collect()
    assert [r["predicted_label"] for r in got] == ["ham", "spam"]
    assert got[1]["decision_score"] == pytest.approx(0.02) and got[0]["confidence"] == 0.5 and got[0]["top_signals"] == []


def test_signals_are_cut_before_the_wrong_way_is_dropped(spark):
    parts = [(1, "word_tfidf__a", 3.0), (1, "word_tfidf__b", -1.0), (1, "c", 0.5), (2, "a", 1.0), (2, "b", -0.1234567), (2, "d", 0.0)]
    weights = spark.createDataFrame([(i, f, abs(w) or 1.0) for i, f, w in parts], "id long, feature string, weight double")
    coefficients = spark.createDataFrame([("word_tfidf__a", 1.0), ("word_tfidf__b", -1.0), ("c", 1.0), ("a", 1.0), ("b", -1.0), ("d", 0.0)], "feature string, coefficient double")
    predictions = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "id long, prediction int")
    signals = scoring.top_signals(scoring.contributions(weights, coefficients, "id"), predictions, "id", n=2)
    got = {r["id"]: [tuple(s) for s in r["top_signals"]] for r in scoring.signal_lists(signals, "id").collect()}
    assert got == {1: [("a", 3.0, "spam"), ("c", 0.5, "spam")], 2: [("b", 0.123457, "ham")]}


def test_plugin_model(texts):
    def make():
        def predict(batch):
            assert len(batch) <= 2
            return np.array([[0.0, float(len(t))] for t in batch])

        return predict

    scored = scoring.score_with_plugin(texts(["", "ab", None, "abcd", "x"]), make, batch_size=2).orderBy("id").collect()
    assert [r["decision_score"] for r in scored] == [0.0, 2.0, 0.0, 4.0, 1.0]
    assert scored[3]["spam_probability"] == pytest.approx(1 / (1 + math.exp(-4)))


def test_export_survives_quotes_and_line_breaks(spark, texts, tmp_path):
    df = texts(['say "hi",\nthen go', " padded "]).withColumn("spam_probability", F.lit(0.12344))
    served = scoring.served_rows(scoring.prediction_columns(df, "m"), ["id"])
    path = str(tmp_path / "export")
    write_export(served, path, row="id")
    line = spark.read.text(path).first()["value"]
    assert line == '"row","text","preview","label","confidence","spam_probability","ham_probability","top_signals"'
    assert {r["text"] for r in read_csv_batch(spark, path).collect()} >= {'say "hi", then go'}
    assert scoring.batch_summary(served, "file.csv").first().asDict() == {"total": 2, "spam": 0, "ham": 2, "source": "file.csv"}


def test_warnings_name_blank_rows(texts):
    from mailscreen.operators.batch import check_texts

    summary = scoring.batch_summary(texts(["x"]).withColumn("label", F.lit("ham")), "f")
    assert scoring.with_warnings(summary, check_texts(texts(["a", " ", None]))).first()["warnings"] == ["2 blank rows were left out."]
    assert scoring.with_warnings(summary, check_texts(texts(["a"]))).first()["warnings"] == []


def test_windows_of_tokens():
    from mailscreen.operators.scoring import token_windows

    assert token_windows("a  b c", 3) == ["a  b c"] and token_windows("", 2) == [""] and token_windows("a b", None) == ["a b"]
    words = [f"w{i}" for i in range(11)]
    for length, overlap in ((4, 1), (4, 0), (3, 2), (10, 9)):
        windows = [w.split() for w in token_windows(" ".join(words), length, overlap)]
        assert all(len(w) <= length for w in windows) and windows[0] == words[:length] and windows[-1][-1] == words[-1]
        assert all(a[-overlap:] == b[:overlap] for a, b in zip(windows, windows[1:]) if overlap and len(b) >= overlap)
        assert [w for n, part in enumerate(windows) for w in (part if n == 0 else part[overlap:])] == words


def test_pooled_windows(spark):
    import numpy as np
    import pytest

    from mailscreen.operators.scoring import score_with_plugin

    def model():
        def predict(batch):
            assert len(batch) <= 3 and all(len(t.split()) <= 4 for t in batch)
            return np.array([[len(t.split()), 3.0 * t.count("x")] for t in batch], dtype=float).reshape(-1, 2)

        return predict

    texts = ["x a", "a b c d x x", "", None, "a b c d e f g x", "x x x x a a a a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("_ham", F.lit("clash"))
    got = {pool: {r["id"]: r["decision_score"] for r in score_with_plugin(df, model, batch_size=3, max_length=4, pool=pool).collect()} for pool in ("mean", "max", "first")}
    assert got["first"] == {0: 1.0, 1: -4.0, 2: 0.0, 3: 0.0, 4: -4.0, 5: 8.0}
    assert got["max"] == {0: 1.0, 1: 4.0, 2: 0.0, 3: 0.0, 4: -1.0, 5: 8.0}
    assert got["mean"] == pytest.approx({0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: -2.5, 5: 1.0})
    for wrong in ({"pool": "median"}, {"max_length": 4, "overlap": 4}):
        with pytest.raises(ValueError):
            score_with_plugin(df, model, **wrong)


def test_small_numbers_are_written_without_an_exponent(spark, texts, tmp_path):
    df = texts(["a", "b", "c"], spam_probability=[0.0009, 1.0, 0.25])
    served = scoring.served_rows(scoring.prediction_columns(df, "m"), ["id"])
    got = {r["id"]: r["s"] for r in served.select("id", prob.scores_json(F.col("scores")).alias("s")).collect()}
    assert got == {0: '{"spam":0.0009,"ham":0.9991}', 1: '{"spam":1.0,"ham":0.0}', 2: '{"spam":0.25,"ham":0.75}'}
    signals = F.array(F.struct(F.lit('say "x"').alias("feature"), F.lit(0.000012).alias("contribution"), F.lit("spam").alias("direction")))
    assert spark.range(1).select(prob.signals_json(signals)).first()[0] == '[{"feature":"say \\"x\\"","contribution":0.000012,"direction":"spam"}]'
    write_export(served, str(tmp_path / "export"), row="id")
    assert "E-" not in "".join(r["value"] for r in spark.read.text(str(tmp_path / "export")).collect())


def test_windows_are_held_by_portions(spark, monkeypatch):
    assert [(p.start, p.stop) for p in scoring.portions(np.array([3, 3, 3, 20, 0, 1]), 6)] == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(scoring.portions(np.array([], dtype=int))) == []

    def make():
        def predict(batch):
            return np.array([[float(len(batch)), len(t)] for t in batch])

        return predict

    df = spark.createDataFrame([(i, "a " * 9) for i in range(5)] + [(5, None)], "id long, text string").coalesce(1)
    assert {r["_ham"] for r in scoring.score_with_plugin(df, make).select((F.col("decision_score") * 0).alias("_ham")).collect()} == {0.0}
    assert scoring.score_with_plugin(df, make, max_length=2, overlap=1).count() == 6
