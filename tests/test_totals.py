from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import chartfold as cf

def all_kinds():
    v = F.col("v")
    return [cf.count("rows"), cf.count("values", v), cf.total("total", v),
            cf.least("low", v), cf.greatest("high", v), cf.mean("mean", v)]


@pytest.fixture(scope="module")
def tables(spark):
    fact = spark.createDataFrame(
        [(1, 10), (1, 20), (2, None), (2, 5), (3, 7), (None, 1), (9, 100)], "k int, v int"
    )
    side = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None)], "k int, label string")
    return fact, side


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_joining_first(tables):
    fact, side = tables
    got = cf.grouped_totals(fact, "label", all_kinds(), [cf.Lookup(side, "k", "k")])
    plain = fact.join(side, "k").groupBy("label").agg(
        F.count(F.lit(1)), F.count("v"), F.sum("v"), F.min("v"), F.max("v"), F.avg("v")
    )
    assert rows(got) == rows(plain)


def test_left_lookup_keeps_unmatched(tables):
    fact, side = tables
    got = cf.grouped_totals(fact, "label", [cf.count()], [cf.Lookup(side, "k", "k", "left")])
    assert rows(got) == rows(fact.join(side, "k", "left").groupBy("label").count())


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([("x", None)], "g string, v int")
    assert rows(cf.grouped_totals(df, "g", all_kinds())) == [("x", 1, 0, None, None, None, None)]
    assert rows(cf.grouped_totals(df.limit(0), "g", all_kinds())) == []


def test_exact_total_is_exact(spark):
    # 0.1 cent amounts whose double sum drifts, of both signs and above 2 ** 20 units
    df = spark.range(20_000).select(
        (F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 2 == 0, F.lit(123_456_789_012)).otherwise(F.lit(-98_765_432_109)).alias("units"),
    )
    got = cf.grouped_totals(df, "g", [cf.exact_total("t", F.col("units"), 3)])
    want = df.groupBy("g").agg((F.sum(F.col("units").cast("decimal(30,0)"))).alias("t"))
    want = {r.g: Decimal(r.t).scaleb(-3) for r in want.collect()}
    assert {r.g: r.t for r in got.collect()} == want


def test_exact_total_of_nothing_is_null(spark):
    df = spark.createDataFrame([("x", None)], "g string, v bigint")
    assert rows(cf.grouped_totals(df, "g", [cf.exact_total("t", F.col("v"), 2)])) == [("x", None)]


def test_unknown_group_column(tables):
    with pytest.raises(ValueError, match="nowhere"):
        cf.grouped_totals(tables[0], "nowhere")


def test_hierarchy_null_label_is_not_subtotal(spark):
    df = spark.createDataFrame([("r", None, 1), ("r", "n", 2), (None, "n", 4)], "a string, b string, v int")
    got = cf.hierarchy(df, ["a", "b"], [cf.total("t", F.col("v")), cf.mean("m", F.col("v"))])
    assert rows(got) == sorted([
        (None, None, 0, 7, 7 / 3), ("r", None, 1, 3, 1.5), (None, None, 1, 4, 4.0),
        ("r", None, 2, 1, 1.0), ("r", "n", 2, 2, 2.0), (None, "n", 2, 4, 4.0),
    ], key=repr)


def test_hierarchy_grand_total_is_sum_of_leaves(spark, sf):
    got = cf.hierarchy(cf.load(spark, sf, "part"), ["p_brand", "p_type", "p_size"])
    sums = {r.depth: r.n for r in got.groupBy("depth").agg(F.sum("n").alias("n")).collect()}
    assert sums == dict.fromkeys(range(4), 2000)
