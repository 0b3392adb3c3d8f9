"""Fingerprints against exact similarity, and the order of documents against a sorted list."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailscreen.llm.fingerprints import FingerprintSettings, alike, compare_with_edits, densified, fingerprint_documents, likeness, pack, unpack, with_next
from mailscreen.llm.words import shingle_sets


def exact(a, b):
    sets = [set(h.tolist()) for h in shingle_sets(pa.array([a, b]))]
    union = sets[0] | sets[1]
    return len(sets[0] & sets[1]) / len(union) if union else float(a == b)


def words(rng, n):
    return " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))


@pytest.mark.parametrize("settings", [FingerprintSettings(), FingerprintSettings(bins=1024, bits=1), FingerprintSettings(bins=256, bits=8), FingerprintSettings(bits=2)])
def test_similarity_is_estimated_without_bias(settings):
    rng = random.Random(1)
    errors = []
    for _ in range(300):
        base = words(rng, rng.choice([150, 400, 1500])).split()
        other = base[: int(len(base) * rng.random())] + words(rng, rng.randint(1, 300)).split()
        a, b = " ".join(base), " ".join(other)
        prints = [pack(h, settings) for h in shingle_sets(pa.array([a, b]), settings.width)]
        errors.append(alike(prints[:1], prints[1:], settings)[0] - exact(a, b))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.05 and np.max(np.abs(errors)) < 0.2


def test_low_bits_of_the_least_hash_in_each_bin_are_kept():
    settings = FingerprintSettings(bins=8, bits=4)
    hashes = np.array(sorted([(1 << 61) * b + v for b, v in ((0, 21), (0, 37), (3, 7), (7, 9), (7, 2))]), dtype=np.uint64)
    kept = unpack([pack(hashes, settings)], settings)[0]
    assert (kept[0], kept[3], kept[7]) == (21 & 15, 7, 2)
    source = densified(np.array([True, False, False, True, False, False, False, True]))
    assert kept.tolist() == [{0: 5, 3: 7, 7: 2}[b] for b in source.tolist()]
    assert densified(np.arange(512) == 5, most_blocks=1).tolist() == [5] * 512


def edge_rows():
    rng = random.Random(2)
    long = words(rng, 60_000)
    return [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "One  two"), (6, words(rng, 300)), (6, words(rng, 300)), (7, "same text here for all of them"), (7, "same text here for all of them"),
            (None, "no id at all in here"), (None, None), (9, long), (10, long + " é😀漢"), (-3, "é😀漢 " * 50), (11, words(rng, 200))]


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_the_next_document_is_the_one_with_the_next_smaller_id(spark, shards):
    rng = random.Random(4)
    ids = rng.sample(range(-(1 << 40), 1 << 40), 200) + [(1 << 63) - 1, -(1 << 63), 0]
    rows = [(i, f"text {i}") for i in ids]
    got = {r["doc_id"]: r["next"]["text"] for r in with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], shards=shards).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: f"text {b}" for a, b in zip(order, [*order[1:], order[0]])}


@pytest.mark.parametrize("shards", [1, 40])
def test_ties_and_null_ids_are_visited_once(spark, shards):
    rows = spark.createDataFrame([(i, t or "", "x") for i, t in edge_rows()], "doc_id long, text string, next string").drop("next")
    pairs = [(r["doc_id"], r["text"], r["next"]["doc_id"], r["next"]["text"]) for r in with_next(rows, ["doc_id", "text"], shards=shards).collect()]
    assert sorted(map(repr, [p[:2] for p in pairs])) == sorted(map(repr, [p[2:] for p in pairs]))
    order = [6, 6, 5]
    assert sorted(p[2] for p in pairs if p[0] in (7, 6)) == sorted([7, 6, *order[1:]]) and {p[2] for p in pairs if p[0] == -3} == {None}
    assert {p[2] for p in pairs if p[0] is None} == {None, 11}


def test_edited_texts_and_likeness(spark):
    import hashlib

    rng = random.Random(6)
    texts = {i: t for i, t in edge_rows() if i is not None}
    texts |= {100 + i: words(rng, rng.randint(1, 800)) for i in range(60)}
    given = spark.createDataFrame([(i, t, "clash", 5) for i, t in texts.items()], "doc_id long, text string, fingerprint string, n_chars int")
    got = {r["doc_id"]: r for r in compare_with_edits(given).collect()}
    order = sorted(texts, reverse=True)
    for i, following in zip(order, [*order[1:], order[0]]):
        own, other = texts[i] or "", texts[following] or ""
        third = len(own) // 3
        changed = own[: len(own) - third] + other[:third]
        row = got[i]
        assert row["n_chars"] == len(own) and hashlib.sha256(row["edited"].encode()).digest() == hashlib.sha256(changed.encode()).digest()
        few = len(own.split()) < 100
        assert abs(row["near_edited"] - exact(own, changed)) < (1.01 if few else 0.17)
        assert abs(row["near_next"] - exact(own, other)) < (1.01 if few else 0.17)
        assert (row["near_edited"] == 1.0) or own != changed
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[1]["fingerprint"] == got[2]["fingerprint"] == got[3]["fingerprint"] == ""
    assert len(got[6]["fingerprint"]) == 512


def test_equal_texts_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "")], "doc_id long, text string")
    pairs = fingerprint_documents(rows).alias("a").join(fingerprint_documents(rows).alias("b"), F.col("a.text") == F.col("b.text"))
    assert {r[0] for r in pairs.select(likeness(F.col("a.fingerprint"), F.col("b.fingerprint"))).collect()} == {1.0}
    assert compare_with_edits(rows.limit(0)).count() == 0
