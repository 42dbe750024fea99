import math
import random

import pytest
from pyspark.sql import functions as F

import chartfold as cf


def bins(df):
    return [(r.bin, r.n) for r in sorted(df.collect())]


def test_edges_and_maximum(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 2.0, 2.0, 4.0, 9.999, 10.0, None, float("nan"))], "v double")
    got = cf.histogram(df, "v", 5)
    assert bins(got) == [(0, 1), (1, 2), (2, 1), (3, 0), (4, 2)]
    edges = [(r.bin_lo, r.bin_hi) for r in sorted(got.collect())]
    assert edges == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]


def test_given_bounds_leave_out_the_rest(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 5, 9, 10, 11)], "v int")
    assert bins(cf.histogram(df, "v", 2, 0, 10)) == [(0, 1), (1, 3)]
    assert bins(cf.histogram(df, "v", 2, lo=0)) == [(0, 2), (1, 3)]
    assert bins(cf.histogram(df.limit(0), "v", 2, 0, 10)) == [(0, 0), (1, 0)]


def test_constant_and_single_and_empty(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "v double")
    got = sorted(cf.histogram(df, "v", 4).collect())
    assert [(r.bin_lo, r.n) for r in got] == [(2.5, 0), (2.75, 0), (3.0, 4), (3.25, 0)]
    assert cf.histogram(df.limit(0), "v", 4).collect() == []
    assert cf.histogram(df.filter("v is null"), "v", 4).collect() == []


def test_bad_arguments(spark):
    df = spark.range(3)
    for args in ({"bins": 0}, {"bins": 3, "lo": 5, "hi": 1}):
        with pytest.raises(ValueError):
            cf.histogram(df, "id", **args)
    with pytest.raises(ValueError):
        cf.density2d(df, "id", 0, "id", 1)


def test_histogram_counts_add_up(spark, sf):
    total = cf.histogram(cf.load(spark, sf, "events"), "value", 33).agg(F.sum("n")).first()[0]
    assert total == 10_000


def test_heatmap_leaves_out_rows_without_a_place(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), (None, 1), ("b", 2)], "x string, y int")
    assert sorted(tuple(r) for r in cf.heatmap(df, "x", "y").collect()) == [("a", 1, 2), ("b", 2, 1)]


def test_heatmap_wide(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), (None, 1), ("b", 3)], "x string, y int")
    got = cf.heatmap_wide(df, "x", "y", [1, 2])
    assert got.columns == ["x", "1", "2"]
    assert sorted(tuple(r) for r in got.collect()) == [("a", 2, 0), ("b", 0, 0)]


def test_density_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 3), rng.gauss(0, 20)) for _ in range(500)] + [(None, 1.0), (float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    want = {}
    for x, y in rows[:500]:
        key = (math.floor(x / 0.5), math.floor(y / 10))
        want[key] = want.get(key, 0) + 1
    got = cf.density2d(df, "x", 0.5, "y", 10).collect()
    assert {(r.x_bin, r.y_bin): r.n for r in got} == want
    assert all(r.x_lo == r.x_bin * 0.5 and r.y_lo == r.y_bin * 10 for r in got)


@pytest.mark.parametrize("lo,hi,count", [(0.1, 1.1, 4), (0.0, 0.3, 3), (-1.7, 2.9, 23), (1e-9, 3e-9, 7), (0.7, 123.4, 49), (1e6, 1e6 + 0.1, 11)])
def test_every_edge_falls_into_its_own_bin(spark, lo, hi, count):
    empty = spark.createDataFrame([], "v double")
    edges = [(r.bin, r.bin_lo) for r in cf.histogram(empty, "v", count, lo, hi).collect()]
    df = spark.createDataFrame([(lo_,) for _, lo_ in edges], "v double")
    assert bins(cf.histogram(df, "v", count, lo, hi)) == [(b, 1) for b in range(count)]


def test_infinities_are_counted_beside_the_axis(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (inf, -inf, inf, 0.0, 1.0, 4.0)], "v double")
    got = sorted(cf.histogram(df, "v", 2).collect())
    assert [tuple(r) for r in got] == [(-1, -inf, 0.0, 1), (0, 0.0, 2.0, 2), (1, 2.0, 4.0, 1), (2, 4.0, inf, 2)]
    only = spark.createDataFrame([(inf,), (inf,)], "v double")
    assert [(r.bin, r.bin_hi, r.n) for r in cf.histogram(only, "v", 3).collect()] == [(3, inf, 2)]


def test_density_edges_and_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([(0.3, 0.6), (inf, 0.05), (-inf, 1e300)], "x double, y double")
    got = {(r.x_bin, r.y_bin): (r.x_lo, r.y_lo, r.n) for r in cf.density2d(df, "x", 0.1, "y", 0.1).collect()}
    # as floats, 3 * 0.1 and 6 * 0.1 lie above 0.3 and 0.6
    assert got[2, 5] == (2 * 0.1, 5 * 0.1, 1)
    assert got[None, 0] == (inf, 0.0, 1)
    assert got[None, None] == (-inf, inf, 1)


@pytest.mark.parametrize("w", [0.1, 0.7, 1e-3, 3.3])
def test_density_cells_hold_their_lower_edge(spark, w):
    df = spark.createDataFrame([(i * w, float(i)) for i in range(-200, 200)], "x double, i double")
    got = cf.density2d(df, "x", w, "i", 1).collect()
    assert all(r.x_bin == r.y_bin and r.n == 1 for r in got) and len(got) == 400
