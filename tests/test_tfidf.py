import math
import re
from collections import Counter

import pytest

from mailscreen.operators import features as feat
from mailscreen.operators import tfidf as tf
from mailscreen.registry.sql import STOP_WORDS

DOCS = [
    "The meeting notes: Meeting moved to Monday, please confirm the meeting.",
    "Free prize! Click now, free money for you and you",
    "a b c", "", "prize prize prize meeting", "Click here now now now to win the prize é ñandú 😀😀😀 x",
    "long-word antidisestablishmentarianism", "free FREE Free",
]


def word_terms(text, stop):
    tokens = [t for t in re.findall(r"\b\w\w+\b", text) if t not in stop]
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def char_terms(text):
    out = []
    for word in text.split():
        padded = f" {word} "
        for n in (3, 4, 5):
            out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return out


def expected(terms, cap, max_df):
    n = len(terms)
    counts = [Counter(t) for t in terms]
    df, cf = Counter(), Counter()
    for c in counts:
        df.update(c.keys())
        cf.update(c)
    kept = sorted((t for t in df if df[t] >= 2 and df[t] <= max_df * n), key=lambda t: (-cf[t], t))[:cap]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for i, c in enumerate(counts):
        w = {t: (1 + math.log(k)) * idf[t] for t, k in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, t): v / norm for t, v in w.items()})
    return out


@pytest.mark.parametrize("cap", [3, 7, 1000])
@pytest.mark.parametrize("kind", ["word", "char"])
def test_weights_by_brute_force(texts, kind, cap):
    from tests.test_text import by_hand

    clean = [by_hand(d) for d in DOCS]
    if kind == "word":
        settings, terms = tf.word_settings(cap), [word_terms(d, set(tf.default_stop_words())) for d in clean]
    else:
        settings, terms = tf.char_settings(cap), [char_terms(d) for d in clean]
    want = expected(terms, cap, settings.max_df)
    got = {(r["id"], r["term"]): r["weight"] for r in tf.tfidf(texts(DOCS), "id", "text", settings).collect()}
    assert got == pytest.approx(want, abs=1e-12)


def test_stop_list_of_the_sql_side(spark):
    assert set(STOP_WORDS) == {w for w in tf.default_stop_words() if "'" not in w and len(w) > 1}


def test_long_rows_need_one_shuffle_of_the_text(texts):
    """Counting and normalising stay in the partitioning by document."""
    counts = tf.term_counts(texts(DOCS), "id", "text", tf.word_settings())
    vocabulary = tf.fit_vocabulary(counts, len(DOCS), tf.word_settings())
    plan = tf.weigh(counts, "id", vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_most_frequent_breaks_ties_by_term(spark):
    rows = [(f"t{i:03d}", 1 + i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "term string, cf long").repartition(4)
    got = [r["term"] for r in tf.most_frequent(df, 130).collect()]
    want = [t for t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:130]]
    assert sorted(got) == sorted(want)


def test_scaling_leaves_zero_columns(texts):
    rows = feat.scaled_stats(texts(["abc", "ABCDEF!"]), "id", "text").orderBy("id").collect()
    assert rows[1]["char_count"] == 1.0 and rows[0]["url_count"] == 0.0 and rows[0]["exclamation_count"] == 0.0


def test_vectors_keep_every_row(spark):
    weights = spark.createDataFrame([(1, "a", 0.5), (1, "c", -2.0), (2, "b", 0.1234567890123456)], "id long, feature string, weight double")
    index = feat.index_features([spark.createDataFrame([("c",), ("a",)], "feature string"), spark.createDataFrame([("b",), ("zz",)], "feature string")])
    got = {r["id"]: r["features"] for r in feat.to_vectors([weights.filter("feature <> 'b'").unionByName(spark.createDataFrame([(2, "zz", 1.0)], weights.schema)), weights.filter("feature = 'b'")], "id", index, 4).collect()}
    assert list(got[1].indices) == [0, 1] and list(got[1].values) == [0.5, -2.0]
    assert got[2].toArray().tolist() == [0.0, 0.0, 0.1234567890123456, 1.0]


def test_windows_of_whole_chunks_are_those_of_the_words(texts):
    """Windows cut from code points, for all texts at once, are those cut word by word, and so are their totals."""
    import numpy as np
    import pyarrow as pa

    clean = ["a b  c", "", "é ñandú 😀😀😀 x", "long-word " * 40 + "x", " edge ", "same same"]
    cut = tf.char_windows(clean)
    got = Counter((int(r), t) for r, t in zip(cut.row, cut.terms(np.arange(len(cut.row)))))
    want = Counter((i, t) for i, text in enumerate(clean) for t in char_terms(text))
    assert got == want
    names = sorted({t for _, t in want})
    hashes = dict(zip(names, tf.hash_of(pa.array(names)).tolist()))
    assert len(set(hashes.values())) == len(names)
    assert all(hashes[t] == h for t, h in zip(cut.terms(np.arange(len(cut.row))), cut.hashes.tolist()))
    assert [(first, len(some)) for first, some in tf.chunks(pa.array(clean), 12)] == [(0, 2), (2, 1), (3, 1), (4, 1), (5, 1)]
    totals = {r["term"]: (r["df"], r["cf"]) for r in tf.char_frequencies(texts(clean).withColumnRenamed("text", "_clean").repartition(3)).collect()}
    df, cf = Counter(t for _, t in want), Counter()
    for (_, term), n in want.items():
        cf[term] += n
    assert totals == {t: (df[t], cf[t]) for t in cf}


def test_words_are_counted_and_weighed_row_by_row(texts, spark):
    """No text and no term of a text is shuffled or joined, and chunks cut through a batch give the same terms."""
    import numpy as np
    import pyarrow as pa

    stop = tf.default_stop_words()
    given = texts(DOCS)
    clean = tf.cleaned(given, "id", "text")
    settings = tf.word_settings()
    want = {r["term"]: (r["df"], r["cf"]) for r in tf.document_frequencies(tf.clean_term_counts(clean, "id", settings)).collect()}
    counted = tf.frequencies(clean, "id", settings)
    assert {r["term"]: (r["df"], r["cf"]) for r in counted.collect()} == want
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    vocabulary = tf.fit_vocabulary(counted, len(DOCS), settings)
    weighed = tf.weights_of(clean, "id", vocabulary, settings, stop)
    plan = weighed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan
    joined = {(r["id"], r["term"]): r["weight"] for r in tf.weigh(tf.clean_term_counts(clean, "id", settings), "id", vocabulary).collect()}
    assert {(r["id"], r["term"]): r["weight"] for r in weighed.collect()} == pytest.approx(joined, abs=1e-12)

    lists = pa.array([["free", "the", "prize"], [], ["prize"], ["free", "prize", "free", "prize"], ["😀a", "ñ"]], pa.list_(pa.string())).slice(1)
    for most in (1, 3, 100):
        got = Counter()
        for first, some in tf.token_chunks(lists, most):
            cut = tf.words_of(some, ["the"])
            names = cut.terms(np.arange(len(cut.row))).to_pylist()
            assert tf.word_hash(pa.array(names, pa.string())).tolist() == cut.hashes.tolist()
            got.update(zip((cut.row + first).tolist(), names))
        assert got == Counter({(1, "prize"): 1, (2, "free"): 2, (2, "prize"): 2, (2, "free prize"): 2, (2, "prize free"): 1, (3, "😀a"): 1, (3, "ñ"): 1, (3, "😀a ñ"): 1})


def test_rows_that_share_an_id_are_one_document(spark):
    rows = spark.createDataFrame([(1, "free prize"), (1, "prize money"), (2, "prize free"), (None, "money"), (None, "free")], "id long, text string")
    settings = tf.TermSettings("word", None, 1, 1.0)
    clean = tf.cleaned(rows, "id", "text")
    got = {r["term"]: (r["df"], r["cf"]) for r in tf.frequencies(clean, "id", settings).collect()}
    assert got["prize"] == (2, 3) and got["free"] == (3, 3) and got["free prize"] == (1, 1)
    weights = tf.tfidf(rows, "id", "text", settings)
    assert weights.where("id = 1 AND term = 'prize'").count() == 1


def test_one_sort_counts_texts_and_occurrences():
    import numpy as np
    import pyarrow as pa

    words = [["spam", "ham", "spam", "spam", "ham"], [], ["ham"], ["eggs", "spam", "ham"], ["spam", "spam"]]
    for cut in (tf.words_of(pa.array(words), ["eggs"]), tf.char_windows(["spam ham", "", "ham", "spam spam", "s"]), tf.words_of(pa.array([[]], pa.list_(pa.string())), [])):
        names = list(cut.terms(np.arange(len(cut.hashes)))) if len(cut.hashes) else []
        names = [n.as_py() if hasattr(n, "as_py") else n for n in names]
        first, df, cf = tf.counted(cut)
        got = {names[f]: (d, c) for f, d, c in zip(first.tolist(), df.tolist(), cf.tolist())}
        want = {n: (len({r for r, m in zip(cut.row.tolist(), names) if m == n}), names.count(n)) for n in names}
        assert got == want and all(names.index(names[f]) == f for f in first.tolist())


def test_lookups_do_not_depend_on_the_order_of_the_terms():
    import numpy as np

    table = tf.TermTable.of(np.array([9, -4, 30, 7]), np.array([1.0, 2.0, 3.0, 4.0]), np.array([5, 6, 7, 8]))
    row, flat = np.array([0, 0, 0, 0, 1, 1, 2]), np.array([30, -4, 30, 8, 99, 7, -5])
    got = table.weighed(row, flat, 3)
    raw = {6: 2.0, 7: (1 + np.log(2)) * 3.0}
    size = np.sqrt(sum(v * v for v in raw.values()))
    assert got[0].tolist() == [0, 0, 1] and got[1].tolist() == [6, 7, 8] and np.allclose(got[2], [raw[6] / size, raw[7] / size, 1.0])
