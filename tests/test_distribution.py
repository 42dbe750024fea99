import random

import numpy as np
import pytest

import chartfold as cf


@pytest.fixture(scope="module")
def skewed(spark):
    """A group with most rows, values that repeat, and every kind of gap."""
    rng = random.Random(11)
    rows = [("hot", float(rng.choice([1, 1, 1, 2, 3, 5, 8, 500]) + rng.randint(0, 60))) for _ in range(900)]
    rows += [(f"g{i}", rng.gauss(0, 100)) for i in range(12) for _ in range(i + 1)]
    rows += [(None, 4.0), (None, 6.0), ("hot", None), ("hot", float("nan")), ("void", None)]
    clean = {}
    for g, v in rows:
        if v is not None and v == v:
            clean.setdefault(g, []).append(v)
    return spark.createDataFrame(rows, "g string, v double").repartition(6), clean


@pytest.mark.parametrize("chunks", [1, 3, 16])
def test_ecdf_equals_brute_force(skewed, chunks):
    df, clean = skewed
    got = {(r.g, r.v): (r.n, r.cume_dist) for r in cf.ecdf(df, "v", "g", chunks=chunks).collect()}
    want = {
        (g, v): (vs.count(v), sum(u <= v for u in vs) / len(vs)) for g, vs in clean.items() for v in set(vs)
    }
    assert got == want


def test_ecdf_without_groups_ends_at_one(skewed):
    df, clean = skewed
    got = sorted((r.v, r.cume_dist) for r in cf.ecdf(df, "v").collect())
    shares = [s for _, s in got]
    assert shares == sorted(shares) and shares[-1] == 1.0
    assert len(got) == len({v for vs in clean.values() for v in vs})


def box(values):
    q1, median, q3 = np.percentile(values, [25, 50, 75])
    inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    return [len(values), min(values), min(inside), q1, median, q3, max(inside), max(values), len(values) - len(inside)]


@pytest.mark.parametrize("chunks", [1, 3, 16])
@pytest.mark.parametrize("by", [None, "g"])
def test_box_equals_brute_force(skewed, chunks, by):
    df, clean = skewed
    groups = clean if by else {None: [v for vs in clean.values() for v in vs]}
    got = cf.box_summary(df, "v", by, chunks=chunks).collect()
    assert len(got) == len(groups)
    for r in got:
        assert list(r)[1 if by else 0:] == pytest.approx(box(groups[r.g if by else None])), r


def test_box_of_equal_values_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 2), ("a", 2), ("b", 7)], "g string, v int")
    got = sorted(tuple(r) for r in cf.box_summary(df, "v", "g").collect())
    assert got == [("a", 2, 2, 2, 2.0, 2.0, 2.0, 2, 2, 0), ("b", 1, 7, 7, 7.0, 7.0, 7.0, 7, 7, 0)]
    assert cf.box_summary(df.limit(0), "v", "g").collect() == []


def test_box_whisker_length(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 30)], "v double")
    assert cf.box_summary(df, "v").first().outliers == 1
    assert cf.box_summary(df, "v", whisker=20).first().outliers == 0
