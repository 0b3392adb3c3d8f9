import hashlib
import math
import random
from collections import Counter

import pytest

from mailscreen.config import SplitFractions
from mailscreen.operators import sampling as ops


def md5(seed, value):
    return hashlib.md5(f"{seed}|{value}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, 1 if rng.random() < 0.3 else 0, rng.choice(["big"] * 8 + ["mid", "tiny"])) for i in range(3000)]
    return data, spark.createDataFrame(data, "id long, label int, source string").repartition(5).cache()


def test_quotas_match_the_published_split():
    quotas = ops.split_quotas({0: 23134, 1: 16010}, SplitFractions())
    sums = [sum(q[i] for q in quotas.values()) for i in range(3)]
    assert sums == [5872, 5872, 27400]
    assert (quotas[0][0], quotas[1][0]) == (3470, 2402)
    assert (quotas[0][1], quotas[1][1]) == (3470, 2402)


@pytest.mark.parametrize("counts", [{0: 20, 1: 20}, {0: 1, 1: 1}, {0: 7}, {0: 0, 1: 3}, {0: 1000, 1: 1}])
def test_quotas_add_up(counts):
    quotas = ops.split_quotas(counts, SplitFractions())
    total = sum(counts.values())
    assert {k: sum(v) for k, v in quotas.items()} == counts
    assert sum(q[0] for q in quotas.values()) == math.ceil(0.15 * total)
    assert all(min(q) >= 0 for q in quotas.values())


def test_fractions_must_add_up():
    with pytest.raises(ValueError):
        SplitFractions(0.5, 0.2, 0.2).check()


def test_split_is_a_ranking_by_hash(rows):
    data, df = rows
    got = {r["id"]: r["split"] for r in ops.stratified_split(df, ["id"]).collect()}
    counts = Counter(label for _, label, _ in data)
    quotas = ops.split_quotas(counts, SplitFractions())
    for label in counts:
        order = sorted((i for i, l, _ in data if l == label), key=lambda i: md5(42, i))
        test, validation, _ = quotas[label]
        for place, i in enumerate(order):
            want = "test" if place < test else "validation" if place < test + validation else "train"
            assert got[i] == want


def test_split_does_not_depend_on_partitions(spark, rows):
    _, df = rows
    one = {r["id"]: r["split"] for r in ops.stratified_split(df.coalesce(1), ["id"]).collect()}
    eight = {r["id"]: r["split"] for r in ops.stratified_split(df.repartition(8), ["id"]).collect()}
    other = {r["id"]: r["split"] for r in ops.stratified_split(df, ["id"], seed=7).collect()}
    assert one == eight != other


def test_tiny_and_empty_splits(spark):
    two = spark.createDataFrame([(1, 0), (2, 1)], "id long, label int")
    assert ops.stratified_split(two, ["id"]).filter("split IS NULL").count() == 0
    assert ops.stratified_split(two.limit(0), ["id"]).count() == 0


def test_hashed_split_sizes(rows):
    _, df = rows
    counts = Counter(r["split"] for r in ops.hashed_split(df, ["id"]).collect())
    assert abs(counts["train"] / 3000 - 0.7) < 0.05


def test_folds_share_every_class(rows):
    data, df = rows
    folds = Counter((r["label"], r["fold"]) for r in ops.stratified_folds(df, ["id"], 3).collect())
    for label in (0, 1):
        sizes = [folds[label, f] for f in range(3)]
        assert sum(sizes) == sum(1 for _, l, _ in data if l == label) and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("cap", [1, 50, 400, 5000])
def test_cap_per_group_is_a_ranking_by_hash(rows, cap):
    data, df = rows
    got = {r["id"] for r in ops.cap_per_group(df, "source", cap, ["id"]).collect()}
    want = set()
    for source in ("big", "mid", "tiny"):
        want |= set(sorted((i for i, _, s in data if s == source), key=lambda i: md5(42, i))[:cap])
    assert got == want


def test_cap_without_broadcast(rows, monkeypatch):
    from mailscreen import session

    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    _, df = rows
    assert ops.cap_per_group(df, "source", 50, ["id"]).count() == 150


def test_cap_is_exact_for_equal_and_null_ids(spark):
    data = [(None, "a")] * 50 + [(None, f"b{i}") for i in range(5)] + [(7, "c")] * 3
    df = spark.createDataFrame([(i, t, "s") for i, t in data], "id long, text string, source string")
    for cap in (1, 2, 40, 57, 58, 100):
        assert ops.cap_per_group(df, "source", cap, ["id"]).count() == min(cap, 58)
    assert ops.cap_per_group(df, "source", None, ["id"]).count() == 58


def test_sample_rows(rows):
    data, df = rows
    got = [r["id"] for r in ops.sample_rows(df, 10, ["id"]).collect()]
    assert got == sorted((i for i, _, _ in data), key=lambda i: md5(42, i))[:10]
    assert ops.sample_rows(df.limit(3), 10, ["id"]).count() == 3


@pytest.mark.parametrize("n", [1, 10, 5000])
def test_draws_with_replacement(rows, n):
    data, df = rows
    order = sorted((i for i, _, _ in data), key=lambda i: md5(42, i))
    got = {r["draw"]: r["id"] for r in ops.sample_with_replacement(df, n, ["id"]).collect()}
    want = {d: order[int(md5(42, f"draw|{d}")[:15], 16) % len(order)] for d in range(n)}
    assert got == want


def test_draws_from_few_rows(spark):
    df = spark.createDataFrame([(7,)], "id long")
    assert [r["id"] for r in ops.sample_with_replacement(df, 4, ["id"]).collect()] == [7] * 4
    assert ops.sample_with_replacement(df.limit(0), 4, ["id"]).count() == 0


def test_rows_without_an_id_are_counted_not_ranked(spark):
    rows = [(None, i % 2, f"t{i % 5}") for i in range(200)] + [(i, i % 2, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, text string")
    split = ops.stratified_split(df, ["id"])
    sides = {(r["label"], r["id"]): r["split"] for r in split.collect()}
    assert split.count() == 240 and len(split.where("id IS NULL").select("label", "split").distinct().collect()) == 2
    assert set(sides.values()) <= {"train", "validation", "test"}

    drawn = ops.sample_with_replacement(df, 500, ["id"], seed=3)
    got = [(r["draw"], r["id"], r["label"], r["text"]) for r in drawn.collect()]
    assert sorted(g[0] for g in got) == list(range(500)) and set(g[1:] for g in got) <= set(rows)
    # Equal rows stand for as many places as there are copies of them.
    assert 0.6 < sum(g[1] is None for g in got) / 500 < 0.97
    again = ops.sample_with_replacement(df.repartition(7), 500, ["id"], seed=3)
    assert sorted(map(repr, ((r["draw"], r["id"], r["label"], r["text"]) for r in again.collect()))) == sorted(map(repr, got))
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
