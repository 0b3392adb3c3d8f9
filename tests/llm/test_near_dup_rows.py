"""Near duplicates where ids repeat or are missing; the pipeline's verdict per row; sums of language clusters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from mailscreen.llm import langid, near_dup
from mailscreen.session import written

DOCS = "doc_id long, text string"


def text_of(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def with_one_more(text):
    return text + " more"


A, B, C = text_of(1), text_of(2), text_of(3)
ROWS = [(1, A), (None, A), (None, B), (None, with_one_more(B)), (2, C), (2, text_of(4)), (3, with_one_more(C)), (9, text_of(4)), (None, None), (5, ""), (5, ""), (6, A), (6, A)]


def test_texts_under_one_id_are_judged_apart(spark):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"], r["stands"]) for r in near_dup.near_duplicates(spark.createDataFrame(ROWS, DOCS)).collect()]
    assert len(got) == len(ROWS)
    tops = sorted(((i, c) for i, n, c, *_ in got if n), key=repr)
    # 2 has two texts: one like 3, one like 9.
    assert tops == sorted([(1, 1), (None, 1), (6, 1), (6, 1), (None, None), (None, None), (2, 2), (2, 2), (3, 2), (9, 2)], key=repr)
    assert {i for i, n, _, kept, _ in got if n and kept} == {1, 2} and {i for i, n, *_, stands in got if n and stands} == {1, 2, None}


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in ROWS], DOCS + ", lang string, source string, n_chars long").withColumn("stands", F.lit("clash"))
    kept = sorted(((r["doc_id"], r["text"]) for r in pipeline.near_dedup(spark, docs, "").collect()), key=repr)
    groups = [[(1, A)], [(2, C)], [(2, text_of(4))], [(None, None)], [(5, "")]]
    one_of_b = [r for r in kept if r in ((None, B), (None, with_one_more(B)))]
    assert len(one_of_b) == 1 and [r for r in kept if r not in one_of_b] == sorted([g[0] for g in groups], key=repr)


def test_sketches_differ_in_as_many_bits_as_the_estimate_allows(spark):
    for samples, least in ((256, 0.65), (128, 0.8), (512, 0.5)):
        most = near_dup.most_differing(samples, least)

        def estimate(differ):
            return 1 + 1024 / (4 * samples) * np.log(1 - 2 * differ / 1024)

        assert estimate(most) >= least > estimate(most + 1)


@pytest.mark.parametrize("threshold", [50, 75, 100])
def test_overlap_is_the_quotient_of_set_sizes(spark, threshold):
    rng = random.Random(threshold)
    pairs = [(sorted(rng.sample(range(30), rng.randint(1, 25))), sorted(rng.sample(range(30), rng.randint(1, 25)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    got = [r[0] for r in df.select(near_dup.overlaps(threshold, F.col("a"), F.col("b"), F.size("a"), F.size("b"))).collect()]
    assert got == [100 * len(set(a) & set(b)) >= threshold * len(set(a) | set(b)) for a, b in pairs]


def test_a_round_of_clusters_is_the_dense_one(spark):
    rng = np.random.default_rng(3)
    dims, weights = 64, np.linspace(0.5, 2.0, 64).astype(np.float32)
    rows, dense = [], {"aa": [], "bb": []}
    for i in range(300):
        counts = rng.poisson(0.5, dims)
        counts[0] += 1
        lang = "aa" if i % 3 else "bb"
        places = np.flatnonzero(counts)
        rows.append((lang, i, bytearray(places.astype(np.int32).tobytes()), bytearray(counts[places].astype(np.int64).tobytes())))
        v = np.sqrt(counts) * weights
        dense[lang].append(v / np.linalg.norm(v))
    stored = written(spark.createDataFrame(rows, "lang string, h long, places binary, counts binary").repartition(5), "cluster-test")
    centres = {lang: np.stack(own[:3]).astype(np.float32) for lang, own in dense.items()}
    moved = langid._moved(stored, centres, weights)
    for lang, own in dense.items():
        own = np.stack(own)
        nearest = np.argmax(own @ centres[lang].T, axis=1)
        want = np.stack([own[nearest == k].sum(axis=0) for k in range(3)])
        assert np.allclose(moved[lang], want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-5)
    least = langid._least_cosines(stored, moved, weights, 0.05)
    for lang, own in dense.items():
        best = np.sort((np.stack(own) @ moved[lang].T).max(axis=1))
        assert least[lang] == pytest.approx(best[int(0.05 * len(best))], abs=1e-5)
