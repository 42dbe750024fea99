import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import chartfold as cf



@pytest.fixture(scope="module")
def sales(spark):
    rng = random.Random(4)
    rows = [("big", 1)] * 400 + [(f"k{rng.randint(0, 99):02}", 1) for _ in range(600)] + [(None, 1)] * 3
    counts = {}
    for k, _ in rows:
        counts[k] = counts.get(k, 0) + 1
    ranked = sorted(counts.items(), key=lambda kv: (-kv[1], (kv[0] is not None, kv[0] or "")))
    return spark.createDataFrame(rows, "k string, v int").repartition(5), ranked


def test_cumulative_equals_brute_force(sales):
    df, ranked = sales
    got = {r.k: (r.n, r.cumulative, r.cumulative_share) for r in cf.cumulative(df, "k", chunks=7).collect()}
    run, want = 0, {}
    for k, n in ranked:
        run += n
        want[k] = (n, run, run / 1003)
    assert got == want


def test_cumulative_of_zeros_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v int")
    got = sorted(tuple(r) for r in cf.cumulative(df, "k", cf.total("t", F.col("v"))).collect())
    assert got == [("a", 0, 0, None), ("b", 0, 0, None)]
    assert cf.cumulative(df.limit(0), "k").collect() == []


@pytest.mark.parametrize("k", [1, 5, 500])
def test_topk_equals_brute_force(sales, k):
    df, ranked = sales
    got = {(r.k, r.is_other): (r.n, r.share) for r in cf.topk_share(df, "k", k).collect()}
    want = {(key, False): (n, n / 1003) for key, n in ranked[:k]}
    rest = sum(n for _, n in ranked[k:])
    if rest:
        want[None, True] = (rest, rest / 1003)
    assert got == want
    assert sum(s for _, s in got.values()) == pytest.approx(1)


def test_topk_of_exact_total(spark):
    df = spark.createDataFrame([("a", 150), ("b", 125), ("c", 25)], "k string, cents int")
    got = cf.topk_share(df, "k", 1, cf.exact_total("t", F.col("cents"), 2)).collect()
    assert {(r.k, r.t) for r in got} == {("a", Decimal("1.50")), (None, Decimal("1.50"))}


def test_shares_need_a_sum(sales):
    with pytest.raises(ValueError, match="max"):
        cf.topk_share(sales[0], "k", 3, cf.greatest("m", F.col("v")))
    with pytest.raises(ValueError):
        cf.topk_share(sales[0], "k", 0)


def test_funnel_ignores_order_and_repeats(spark):
    rows = [(1, "view"), (1, "click"), (1, "buy"), (2, "buy"), (2, "view"), (3, "click"), (4, "view"), (4, "view"),
            (4, "other"), (None, "view"), (5, None)]
    df = spark.createDataFrame(rows, "u int, t string")
    got = [tuple(r) for r in cf.funnel(df, "u", "t", ["view", "click", "buy"]).collect()]
    assert sorted(got) == [(1, "view", 3), (2, "click", 1), (3, "buy", 1)]
    assert [r.users for r in cf.funnel(df.limit(0), "u", "t", ["view", "buy"]).collect()] == [0, 0]


def test_funnel_needs_different_steps(spark):
    for steps in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            cf.funnel(spark.range(1), "id", "id", steps)


def test_funnel_of_many_steps(spark):
    steps = [str(i) for i in range(130)]
    rows = [(u, s) for u, reach in ((1, 130), (2, 62), (3, 63), (4, 125)) for s in steps[:reach]] + [(5, "129")]
    df = spark.createDataFrame(rows, "u int, t string")
    users = {r.step: r.users for r in cf.funnel(df, "u", "t", steps).collect()}
    assert users == {i: sum(reach >= i for reach in (130, 62, 63, 125)) for i in range(1, 131)}


def test_sample_of_negative_null_and_text_keys(spark):
    df = spark.createDataFrame([(-1,), (-3,), (0,), (2,), (None,)], "k int")
    assert sorted(r.k for r in cf.keyed_sample(df, "k", 3, 2).collect()) == [-1, 2]
    assert sorted(r.k for r in cf.keyed_sample(df, "k", 3, 0).collect()) == [-3, 0]
    text = df.select(F.concat(F.lit("key"), F.col("k").cast("string")).alias("k"))
    parts = [cf.keyed_sample(text, "k", 2, rem) for rem in (0, 1)]
    assert sorted(r.k for p in parts for r in p.collect()) == ["key-1", "key-3", "key0", "key2"]


def test_sample_arguments(spark):
    for mod, rem in ((0, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            cf.keyed_sample(spark.range(3), "id", mod, rem)
