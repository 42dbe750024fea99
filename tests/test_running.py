"""The distributed running total against plain Python."""

import random
from datetime import date
from itertools import groupby

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chartfold import running_total


def expected(rows, key, group, value):
    """{key: (running, total)} of ``rows``, which are sorted by group and order."""
    out = {}
    for _, members in groupby(rows, key=group):
        members = list(members)
        run, whole = 0, sum(value(r) or 0 for r in members)
        for r in members:
            run += value(r) or 0
            out[key(r)] = (run, whole)
    return out


def nulls_first(x):
    return (x is not None, x if x is not None else 0)


@pytest.mark.parametrize("chunks", [1, 2, 3, 8, 37])
def test_one_group_holds_most_rows(spark, chunks):
    rng = random.Random(chunks)
    rows = [("hot", v, rng.randint(-5, 50)) for v in rng.sample(range(10_000), 600)]
    rows += [(f"g{i}", v, 1) for i in range(150) for v in rng.sample(range(100), 3)]
    df = spark.createDataFrame(rows, "g string, v int, m bigint").repartition(7)
    got = running_total(df, [("v", True)], "m", ["g"], out="r", total="t", chunks=chunks).collect()
    want = expected(sorted(rows), lambda r: r[:2], lambda r: r[0], lambda r: r[2])
    assert {(r.g, r.v): (r.r, r.t) for r in got} == want
    assert len(got) == len(rows)


def test_descending_then_key_with_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(f"k{i:04}", rng.choice([1, 1, 1, 2, 7, None])) for i in range(800)] + [(None, 2)]
    df = spark.createDataFrame(rows, "k string, m bigint")
    got = running_total(df, [("m", False), ("k", True)], "m", out="r", total="t", chunks=16).collect()
    rows.sort(key=lambda r: (r[1] is None, -(r[1] or 0), (r[0] is not None, r[0] or "")))
    want = expected(rows, lambda r: r[0], lambda r: 0, lambda r: r[1])
    assert {r.k: (r.r, r.t) for r in got} == want


def test_null_group_null_order_and_nan(spark):
    nan = float("nan")
    rows = [(None, None, 1), (None, 2.0, 2), ("a", nan, 4), ("a", -1.0, 8), ("a", None, 16), ("b", 0.0, 32)]
    df = spark.createDataFrame(rows, "g string, v double, m bigint")
    got = running_total(df, [("v", True)], "m", ["g"], out="r", chunks=5)
    assert {(r.g, r.m): r.r for r in got.collect()} == {
        (None, 1): 1, (None, 2): 3, ("a", 16): 16, ("a", 8): 24, ("a", 4): 28, ("b", 32): 32,
    }


@pytest.mark.parametrize("kind", ["double", "decimal(10,2)", "int"])
def test_descending_numbers_of_any_kind(spark, kind):
    rng = random.Random(9)
    rows = [(i, float(rng.randint(-9, 9))) for i in range(200)] + [(200, None)]
    if kind == "double":
        rows += [(201, float("nan")), (202, float("inf")), (203, float("-inf"))]
    df = spark.createDataFrame(rows, "k int, v double").withColumns({"v": F.col("v").cast(kind), "one": F.lit(1)})
    got = running_total(df, [("v", False), ("k", True)], "one", out="r", chunks=16)
    plain = running_total(df, [("v", False), ("k", True)], "one", out="r", chunks=1)
    assert {r.k: r.r for r in got.collect()} == {r.k: r.r for r in plain.collect()}


def test_descending_text(spark):
    df = spark.createDataFrame([("a", 1), ("c", 4), ("b", 2)], "k string, one int")
    got = running_total(df, [("k", False)], "one", out="r", chunks=3)
    assert {r.k: r.r for r in got.collect()} == {"c": 4, "b": 6, "a": 7}


def test_several_measures_at_once(spark):
    df = spark.range(500).select("id", F.lit(1).alias("one"), (F.col("id") * 2).alias("two"))
    got = running_total(df, [("id", True)], ["one", "two"], out=["n", "s"], total=["m", "t"], chunks=5)
    assert {tuple(r)[:1] + tuple(r)[3:] for r in got.collect()} == {
        (i, i + 1, i * (i + 1), 500, 249_500) for i in range(500)
    }


def test_a_measure_that_changes_between_evaluations(spark):
    """Rows are placed and summed once, so none is lost or doubled where a float total wavers."""
    df = spark.range(2000).select("id", (F.rand() + F.col("id") % 7).alias("m"))
    got = running_total(df, [("m", False), ("id", True)], "m", out="r", total="t", chunks=8).collect()
    assert sorted(r.id for r in got) == list(range(2000))
    got.sort(key=lambda r: (-r.m, r.id))
    run = 0.0
    for r in got:
        run += r.m
        assert r.r == pytest.approx(run) and r.t == pytest.approx(got[-1].r)


def test_empty(spark):
    df = spark.createDataFrame([], "v int, m bigint")
    assert running_total(df, [("v", True)], "m", total="t").collect() == []


def test_result_does_not_depend_on_chunks(spark):
    days = spark.range(3000).select(
        F.date_add(F.lit(date(2020, 1, 1)), F.col("id").cast("int")).alias("d"), (F.col("id") % 17).alias("m")
    )
    one = running_total(days, [("d", True)], "m", chunks=1)
    many = running_total(days, [("d", True)], "m", chunks=61)
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    cells=st.dictionaries(
        st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-20, 20))),
        st.one_of(st.none(), st.integers(-100, 100)), min_size=1, max_size=60,
    ),
    chunks=st.integers(1, 9),
)
def test_any_small_table(spark, cells, chunks):
    rows = [(g, v, m) for (g, v), m in cells.items()]
    df = spark.createDataFrame(rows, "g string, v int, m bigint")
    got = running_total(df, [("v", True)], "m", ["g"], out="r", total="t", chunks=chunks).collect()
    rows.sort(key=lambda r: ((r[0] is not None, r[0] or ""), nulls_first(r[1])))
    want = expected(rows, lambda r: r[:2], lambda r: r[0], lambda r: r[2])
    assert {(r.g, r.v): (r.r, r.t) for r in got} == want
