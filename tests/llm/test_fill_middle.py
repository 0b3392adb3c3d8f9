"""Fill-in-the-middle against a per-row version."""

import hashlib
import random
import re
import subprocess
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from mailscreen.llm.fill_middle import FimSettings, arranged, fill_in_middle, restored, units

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text, settings):
    text = text or ""
    digest = hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    cut = UNIT.findall(text)
    n = len(cut)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(cut[:low]), "".join(cut[low:high]), "".join(cut[high:])
    p, s, m = settings.markers
    if not text or any(x in text for x in settings.markers) or h[2] % 100 >= settings.rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < settings.spm_share:
        return doc_id, n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return doc_id, n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def texts():
    rng = random.Random(3)
    pieces = ["a", "word", "é", "漢字", "😀", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", "<", "P>", "<S", ">", "\x00"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return [*made, None, "", "   ", "one", " one", "one ", "has <P> in it", "<M>", "x" * 300_000, "w " * 100_000, "same", "same"]


def test_every_form_agrees_with_the_version_by_hand(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id here"), (7, "repeated id"), (7, "repeated id"), (-5, "below zero")]
    for settings in (FimSettings(), FimSettings(seed=1, rate=100, spm_share=50, slice_bytes=64), FimSettings(rate=0), FimSettings(rate=100, prefix="[a", suffix="b|", middle="c]")):
        made = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), settings)
        made = made.withColumn("again", restored(F.col("output"), F.col("form"), settings)).collect()
        got = sorted((tuple(r)[:6] for r in made), key=repr)
        assert got == sorted((by_hand(i, t, settings) for i, t in rows), key=repr)
        assert sorted(r["again"] for r in made) == sorted(t or "" for _, t in rows)


def test_markers_that_arise_at_a_seam_do_not_mislead(spark):
    rows = [(i, t) for i in range(60) for t in ("a< <S <P b> >", "< <P <S <M >", "<P P> <S S> <M M>"[:12])]
    settings = FimSettings(rate=100)
    made = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), settings).withColumn("again", restored(F.col("output"), F.col("form")))
    assert sorted(r["again"] for r in made.collect()) == sorted(t for _, t in rows)


def test_clashing_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a b c", "x", 3)], "doc_id int, text string, output string, n int")
    assert fill_in_middle(rows).collect() == fill_in_middle(rows.select("doc_id", "text")).collect()
    assert fill_in_middle(rows.limit(0)).count() == 0
    renamed = rows.selectExpr("doc_id AS key", "text AS body")
    assert fill_in_middle(renamed, doc_id="key", text="body").columns == fill_in_middle(rows).columns


def test_units_of_an_array():
    assert units(pa.array(["a  b ", "", " "])).to_pylist() == [[b"a", b"  b", b" "], [b""], [b" "]]


PEAK = """
import pyarrow as pa
from mailscreen.llm.fill_middle import FimSettings, arranged

rows = 5_000
ids = pa.array(range(rows))
batch = pa.RecordBatch.from_arrays([ids, pa.array(["some words of a text\\n" * 150] * rows), *[ids] * 4], names=list("abcdef"))
assert sum(made.num_rows for made in arranged(iter([batch]), FimSettings())) == rows
print(pa.default_memory_pool().max_memory() - batch.nbytes)
"""


def test_a_batch_of_many_texts_takes_little_memory_besides_its_own():
    # In a process of its own: the pool's peak is never set back.
    assert int(subprocess.run([sys.executable, "-c", PEAK], capture_output=True, check=True, text=True).stdout) < 32 << 20
