import random
import re

import pytest
from pyspark.sql import functions as F

from mailscreen.functions import text as tx
from mailscreen.functions.stats import STATISTICS, with_email_stats
from mailscreen.functions.transformers import EmailStats, TextCleaner

EDGES = [
    "", " ", "a < b > c", "<http://x>", "foo@bar .com", "x@y.z+w@v.u!", "+a@b.c", "a@b.c.", "a@b.-c", "é.ü@ñandú.es , ok",
    "<SCRIPT a>var x = '<b>';</ScRiPt >tail</script>.", "<style>p{}</style><p>Hi</p> !", "<script>never closed <b>x</b>",
    "WWW.Example.com/x?y=1 https://a.b/c,d HTTP://q", "a\x00b", "tab\tnew\nline wide\xa0end ?", "1 , 2 ; 3 : 4 ! 5 . 6",
    "free FREE freedom _free_ Free! winner's unſubscribe", "$5 USD eur VND usdollar", "ＡＢＣ ١٢٣ 😀 𝔘𝔫𝔦", "</a><a href='x'><1>", "a\x85b\x1cc",
    "--a@b--.c-d--", "a.b+c@d-e.f.g--h", "@", "a@", "@b.c", "x@y", "a@b@c.d", "no at all",
]


def by_hand(text):
    """The cleaning rules with Python's re."""
    text = text.replace("\x00", " ")
    for pattern, flags, to in [
        (r"<(script|style).*?>.*?</\1>", re.I | re.S, " "), (r"<[^>]+>", 0, " "), (r"https?://\S+|www\.\S+", re.I, " URLTOKEN "),
        (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", 0, " EMAILTOKEN "), (r"\s+", 0, " "),
    ]:
        text = re.sub(pattern, to, text, flags=flags)
    return re.sub(r"\s+([!?.,;:])", r"\1", text.strip())


def random_texts(n):
    rng = random.Random(3)
    pieces = ["<", ">", "</script>", "<script>", "@", ".", " ", "\n", "a", "B", "é", "+", "-", "_", "9", "!", ",", "www.", "http://", "free", "\xa0"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_clean_text_follows_python(texts):
    values = EDGES + random_texts(3000)
    got = {r["id"]: r["c"] for r in texts(values).select("id", tx.clean_text("text").alias("c")).collect()}
    wrong = [(v, got[i], by_hand(v)) for i, v in enumerate(values) if got[i] != by_hand(v)]
    assert not wrong, wrong[:3]


def test_published_examples(texts):
    html = "<html><body>Hello <b>team</b>! Visit https://example.com now.</body></html>"
    rows = texts([html, "FREE Offer!!!", "free offer!!!"]).select(tx.clean_text("text").alias("c"), tx.dedupe_key("text").alias("k")).collect()
    assert "<b>" not in rows[0]["c"] and "URLTOKEN" in rows[0]["c"] and "Hello team!" in rows[0]["c"]
    assert rows[1]["k"] == rows[2]["k"]


def test_null_text_is_empty(spark):
    row = spark.sql("SELECT CAST(NULL AS string) AS text").select(tx.clean_text("text").alias("c")).first()
    assert row["c"] == ""


def stats_by_hand(raw):
    clean = by_hand(raw)
    words = re.findall(r"\b\w+\b", clean)
    n = max(len(raw), 1)
    return [
        len(clean), len(words), sum(map(len, words)) / len(words) if words else 0.0, len(re.findall("[A-Z]", raw)) / n,
        len(re.findall(r"\d", raw)) / n, raw.count("!"), raw.count("?"), len(re.findall(r"https?://\S+|www\.\S+", raw, re.I)),
        len(re.findall("[$€£]|usd|eur|vnd", raw, re.I)), len(re.findall("</?[A-Za-z][^>]*>", raw)),
        len(re.findall(r"\b(?:free|winner|offer|credit|urgent|money|bonus|click|remove|unsubscribe)\b", raw, re.I)),
    ]


def test_statistics_follow_python(texts):
    values = EDGES + random_texts(1500)
    rows = with_email_stats(texts(values), "text", ["id"]).collect()
    for row in rows:
        want = stats_by_hand(values[row["id"]])
        assert [row[s] for s in STATISTICS] == pytest.approx(want, abs=1e-12), values[row["id"]]


def test_words_are_counted_without_arrays_of_them(texts):
    """Also in a given text that is not squeezed: all blanks, other white space, marks beside blanks."""
    values = EDGES + random_texts(500) + ["  two  words ", "a - b", "- a -", " ( a ) ", "\t\ta\n b", "   ", "-", "é-漢 😀x", "wWw.x http://y httpS://z wwwx ww.w"]
    made = with_email_stats(texts(values), "text", ["id"], ("word_count", "avg_word_length", "url_count"), clean="text")
    assert "regexp_extract_all(_clean" not in made._jdf.queryExecution().optimizedPlan().toString()
    for row in made.collect():
        words = re.findall(r"\w+", values[row["id"]])
        assert row["word_count"] == len(words), values[row["id"]]
        assert row["avg_word_length"] == pytest.approx(sum(map(len, words)) / max(len(words), 1), abs=1e-12)
        assert row["url_count"] == len(re.findall(r"https?://\S+|www\.\S+", values[row["id"]], re.I))


def test_statistics_example(texts):
    row = with_email_stats(texts(["WIN money now!!! Click here for free credit."]), "text", ["id"]).first()
    assert row["exclamation_count"] == 3 and row["suspicious_keyword_hits"] >= 4 and row["uppercase_ratio"] > 0


def test_a_part_of_the_statistics_agrees_with_all(texts):
    df = texts(EDGES)
    few = with_email_stats(df, "text", ["id"], ("digit_ratio", "word_count")).orderBy("id").collect()
    every = with_email_stats(df, "text", ["id"]).select("id", "digit_ratio", "word_count").orderBy("id").collect()
    assert few == every


def test_cleaning_runs_once_per_row(texts):
    """A filter on the cleaned text must not repeat the cleaning below itself."""
    from mailscreen.operators.corpus import finalize

    df = texts(["a", "b"], label=[0, 1])
    plan = finalize(df, "s", "id", "text", "label")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("URLTOKEN") == 1


def test_previews(texts):
    row = texts(["x" * 50 + "\n" + "y" * 200]).select(
        tx.sample_preview("text").alias("a"), tx.served_preview("text").alias("b"), tx.report_preview("text").alias("c")
    ).first()
    assert len(row["a"]) == 103 and len(row["b"]) == 142 and len(row["c"]) == 180 and "\n" not in row["c"]


def test_transformers(texts):
    df = texts(["Hi <b>you</b> !", "x"])
    assert TextCleaner().transform(df).select("clean").collect()[0]["clean"] == "Hi you!"
    assert TextCleaner(preprocess=lambda c: F.upper(F.col(c))).transform(df).first()["clean"] == "HI <B>YOU</B> !"
    assert EmailStats().transform(df).first()["email_stats"][0] == 7.0
