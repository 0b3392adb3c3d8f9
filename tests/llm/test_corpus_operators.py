"""Sharding, packing, language identification, licences, near duplicates, decontamination."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailscreen.llm import decontaminate, langid, licence, near_dup, packing, sharding
from mailscreen.llm.graph import components

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ------------------------------------------------------------------ sharding


def test_shards(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400) + str(i)) for i in range(2000)] + [(i, "the same text") for i in range(2000, 3000)] + [(None, None), (7, "é" * 50)]
    df = spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit("clash"))
    got = sharding.shard_documents(df, 16, rows_per_range=50).collect()
    assert len(got) == len(rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in got)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 402
    few = sharding.shard_documents(df.limit(3), 16).collect()
    assert len(few) == 3 and sharding.shard_documents(df.limit(0), 16).count() == 0


def test_splitters_against_sorting(spark):
    rng = random.Random(4)
    keys = sorted((rng.randrange(1 << 63), rng.randint(1, 50)) for _ in range(3000))
    df = spark.createDataFrame(keys, "key long, size long")
    total = sum(s for _, s in keys)
    for splitter, i in zip(sharding.find_splitters(df, 8, tolerance=0.0), range(1, 8)):
        below = sum(s for k, s in keys if k < splitter)
        assert abs(below - total * i / 8) <= 50


# ------------------------------------------------------------------ packing


def test_word_tokenizer_equals_the_tokenizer():
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = vocabularies.path(packing.VOCABULARY)
    plain, quick = tokenizers.Tokenizer.from_file(path), packing.WordTokenizer(path)
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x250)] + list("'''''''sstremvld  abAB19\n..") * 20
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["it's we'll 'SS !'s I'm<|endoftext|>", "", "Σας ΑΣ", "日本 a", "é İx"]
    assert [x.tolist() for x in quick.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("histogram", [{}, {2048: 3}, {1: 5}, {1024: 7, 3: 1}, {683: 1000, 682: 500, 700: 77, 648: 80, 2048: 2}, {k: k % 7 for k in range(1, 2049)}])
def test_plan_places_every_piece(histogram):
    plan, bound = packing.plan_packing(histogram, rounds=30)
    held = Counter()
    for config, times in plan:
        assert sum(config) <= 2048 and times > 0
        for n in config:
            held[n] += times
    assert held == Counter({n: c for n, c in histogram.items() if c})
    best_fit = sum(packing.best_fit({n: c for n, c in histogram.items() if c and n < 2048}, 2048).values()) + histogram.get(2048, 0)
    assert bound <= sum(t for _, t in plan) <= best_fit


def test_linear_program_beats_best_fit():
    # Longest first pairs 1000 with 1000; only exact thirds and halves fill the sequences.
    histogram = {1200: 300, 848: 300, 700: 600, 648: 300}
    plan, bound = packing.plan_packing(histogram)
    assert sum(t for _, t in plan) <= sum(packing.best_fit(histogram, 2048).values()) and bound >= 600


def test_packing(spark):
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    plain = tokenizers.Tokenizer.from_file(vocabularies.path(packing.VOCABULARY))
    rng = random.Random(6)
    rows = [(i, " ".join(words_of(rng, rng.randint(0, 300)))) for i in range(60)] + [(60, "long text " * 3000), (61, None), (62, ""), (None, "x"), (5, "again")]
    df = spark.createDataFrame(rows, DOCS).withColumn("length", F.lit("clash"))
    got = packing.pack_documents(df).collect()
    want = Counter()
    for key, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for n, s in enumerate(range(0, len(ids), 2048)):
            want[key, n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert packing.pack_documents(df.limit(0)).count() == 0


# ------------------------------------------------------------------ languages and licences


def _languages(rng):
    parts = {"aa": ["th", "er", "on", "an", "ing"], "bb": ["sch", "ung", "ä", "ie", "ver"], "cc": ["ción", "que", "ñ", "os", "la"]}
    return [(name, " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80)))) for name, own in parts.items() for _ in range(60)]


def test_languages(spark):
    rng = random.Random(7)
    rows = [(i, t, lang) for i, (lang, t) in enumerate(_languages(rng))]
    df = spark.createDataFrame(rows + [(900, "x y", None), (901, None, "aa")], "doc_id long, text string, lang string")
    held = langid.held_out(F.col("doc_id"))
    model = langid.train_languages(df.where(~held), langid.LangSettings(dimensions=1 << 10, max_training=200))
    odd = spark.createDataFrame([(1000, None, None), (1001, "12 #", None), (1002, "жжж ффф яяя", None), (1003, "ing" * 300_000, None)], df.schema)
    got = {r["doc_id"]: r for r in langid.identify(df.where(held).union(odd).withColumn("score", F.lit("clash")), model).collect()}
    labels = {i: lang for i, _, lang in rows}
    told = [r["lang_pred"] == labels[i] for i, r in got.items() if i < 900]
    assert told and sum(told) / len(told) > 0.98 and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001)] == ["und", "und"] and got[1002]["rejected"] and got[1003]["lang_pred"] == "aa"
    empty = langid.train_languages(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, empty).collect()} == {"und"} and langid.identify(df.limit(0), model).count() == 0


def test_rare_language_is_learnt(spark):
    rng = random.Random(14)
    texts = _languages(rng)
    rows = [(i, t, lang) for i, (lang, t) in enumerate([r for r in texts if r[0] == "cc"][:2] + [r for r in texts if r[0] != "cc"] * 10)]
    model = langid.train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.LangSettings(dimensions=1 << 10, max_training=20))
    assert set(model.languages) == {"aa", "bb", "cc"}
    assert all(model.classify(t)[0] == lang for lang, t in texts)


def test_licences(spark):
    rng = random.Random(8)
    noise = [(i, "\n".join(" ".join(words_of(rng, 12)) for _ in range(4))) for i in range(80)]
    marked = [(100 + i, f"{' '.join(words_of(rng, 9))}\n{notice}") for i, notice in enumerate(["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "All rights reserved.", "Licensed under CC BY-NC 4.0."])]
    df = spark.createDataFrame(noise + marked + [(200, None), (201, ""), (202, "under the license of words")], DOCS)
    model = licence.train_licences(df, licence.LicenceSettings(variants=15))
    got = {(r["doc_id"], r["line"]): r for r in licence.scan_licences(df, model).collect()}
    families = {k: r["family"] for k, r in got.items() if r["family"] != licence.UNKNOWN}
    assert families == {(100, 1): "MIT", (101, 1): "Apache-2.0", (102, 1): "Proprietary", (103, 1): "CC-BY-NC"}
    texts = dict(marked)
    assert all(texts[i][r["start"] : r["end"]] == texts[i].split("\n")[1] for (i, _), r in got.items() if i in texts)
    assert licence.scan_licences(df.limit(0), model).count() == 0


# ------------------------------------------------------------------ near duplicates


def shingle_set(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for base in range(6):
        words = words_of(rng, 120)
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(10**6))
            rows.append(" ".join(copy))
    rows += ["A b c d e f", "a B c d e f", "one two", "ONE two", "two one", None, "", " \n", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("clash"))
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(df).collect()}
    want, sizes = brute_components(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == sizes[i] and r["kept"] == (want[i] == i) for i, r in got.items())


def test_near_duplicates_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "only here, without an id"), (None, None)], DOCS)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, False), (None, None, False)], key=str)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(10)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    parent = {i: i for p in pairs for i in p}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: top(i) for i in linked}


# ------------------------------------------------------------------ decontamination


def brute_passages(docs, items, width=5):
    def shingles(words):
        return Counter(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else Counter()

    known = {i: WORD.findall((t or "").translate(LOWER)) for i, t in items}
    known = {i: w for i, w in known.items() if w}
    df = Counter(s for w in known.values() for s in set(shingles(w)))
    found = {}
    for doc, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        for item, own in known.items():
            theirs = shingles(own)
            for start in range(max(1, len(words) - len(own) + 1)):
                mine = shingles(words[start : start + len(own)])
                if not mine & theirs:
                    continue
                share, whole = (sum(n / max(1, df[s]) for s, n in c.items()) for c in (mine & theirs, mine | theirs))
                if share / whole >= 0.75:
                    found[doc, item] = max(found.get((doc, item), 0), round(share / whole, 9))
    return found


def test_passages_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, " ".join(words_of(rng, rng.randint(25, 60), 300))) for i in range(12)] + [(20, None), (21, ""), (22, "three little words"), (23, items_text := " ".join(words_of(rng, 30, 300))), (24, items_text)]
    docs = []
    for i in range(60):
        words = words_of(rng, rng.randint(0, 200), 300)
        if i % 3 == 0:
            passage = items[rng.randrange(12)][1].split()
            if i % 2:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((i, " ".join(words)))
    docs += [(100, items_text.upper()), (101, "x three little words y"), (102, None), (103, ""), (104, items[0][1]), (104, items[0][1]), (None, items[1][1])]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_passages(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == pytest.approx(brute_passages(docs, items))
    assert (101, 22) in got and (100, 23) in got and (100, 24) in got and (None, 1) in got
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_passages(df, none).count() == 0 and decontaminate.find_passages(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_reordered_passages_are_found(spark):
    rng = random.Random(13)
    items = [(n, " ".join(words_of(rng, n))) for n in (36, 44, 50)] + [(60, " ".join(words_of(rng, 44))), (61, "four words of it")]
    docs = []
    for i, text in items[:4]:
        own, around = text.split(), words_of(rng, 120)
        half = len(own) // 2
        docs.append((i, " ".join(around[:60] + own[half:] + own[:half] + around[60:])))
        docs.append((i + 100, " ".join(own[half:] + own[:half])))
    docs += [(300, items[1][1].rsplit(" ", 4)[0]), (301, "so four words of it here")]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == pytest.approx(brute_passages(docs, items))
    assert all((i + k, i) in got for i in (36, 44, 50, 60) for k in (0, 100)) and (301, 61) in got


def test_fingerprints_within_the_radius_are_found():
    masks = set(decontaminate.flips(23))
    rng = random.Random(12)
    for _ in range(500):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 23)))
        blocks = [difference >> (8 * b) & 0xFF for b in range(8)]
        assert any(b in masks for b in blocks)
