import random

import numpy as np
import pytest

import chartfold as cf


@pytest.fixture(scope="module")
def measures(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a = rng.gauss(50, 9)
        rows.append((a, a * 3 + rng.gauss(0, 5), None if i % 7 == 0 else rng.random(), 4.0))
    return spark.createDataFrame(rows, "a double, b double, c double, flat double"), rows


def test_corr_is_symmetric_and_pairwise(measures):
    df, rows = measures
    got = {(r.x, r.y): r["corr"] for r in cf.corr_matrix(df, ["a", "b", "c", "flat"]).collect()}
    assert len(got) == 16
    for i, x in enumerate("abc"):
        for j, y in enumerate("abc"):
            both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
            assert got[x, y] == pytest.approx(np.corrcoef(both.T)[0, 1])
            assert got[x, y] == got[y, x]
    assert all(v is None for k, v in got.items() if "flat" in k)


def test_corr_of_nothing_and_of_one_row(measures):
    df, _ = measures
    for few in (df.limit(0), df.limit(1)):
        assert {r["corr"] for r in cf.corr_matrix(few, ["a", "b"]).collect()} == {None}


def test_trend_equals_polyfit(measures):
    df, rows = measures
    got = cf.trend_line(df, "a", "b").first()
    slope, intercept = np.polyfit([r[0] for r in rows], [r[1] for r in rows], 1)
    assert (got.slope, got.intercept, got.n) == (pytest.approx(slope), pytest.approx(intercept), 300)
    assert (got.x_min, got.x_max) == (min(r[0] for r in rows), max(r[0] for r in rows))


def test_trend_of_constant_x_and_missing_values(measures, spark):
    df, rows = measures
    flat = cf.trend_line(df, "flat", "a").first()
    assert (flat.slope, flat.intercept, flat.n) == (None, None, 300)
    assert cf.trend_line(df, "a", "c").first().n == sum(r[2] is not None for r in rows)
    grouped = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 3.0), ("h", 1.0, None)], "k string, x double, y double")
    got = {r.k: (r.slope, r.x_max, r.n) for r in cf.trend_line(grouped, "x", "y", "k").collect()}
    assert got == {"g": (2.0, 2.0, 2), "h": (None, None, 0)}
