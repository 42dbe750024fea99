import random
from datetime import date, datetime, timedelta
from statistics import fmean

import pytest
from pyspark.sql import functions as F

import chartfold as cf
from chartfold.functions.timebuckets import UNITS, as_instant, as_wall_clock, floor_to, following


@pytest.fixture(scope="module")
def times(spark):
    """Wall-clock times around year ends, leap days and a DST gap."""
    rng = random.Random(3)
    base = [datetime(2024, 3, 10, 2, 30), datetime(2024, 2, 29, 23, 59, 59, 999999), datetime(2023, 12, 31, 23),
            datetime(2024, 1, 1), datetime(1969, 12, 31, 23, 59, 59, 500000), datetime(2024, 11, 3, 1, 30)]
    stamps = base + [datetime(2023, 1, 1) + timedelta(seconds=rng.random() * 4e7) for _ in range(200)]
    rows = [(t.isoformat(sep=" "), i) for i, t in enumerate(stamps)] + [(None, -1)]
    df = spark.createDataFrame(rows, "s string, v int").select(F.col("s").cast("timestamp_ntz").alias("ts"), "v")
    return df, stamps


@pytest.fixture
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def plain(value):
    return value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"], indirect=True)
@pytest.mark.parametrize("unit", UNITS)
def test_buckets_follow_the_wall_clock(times, unit, zone):
    df, stamps = times
    got = {plain(r.bucket): r.n for r in cf.bucket_series(df, "ts", unit).collect()}
    want = {}
    for t in stamps:
        want[floor_to(t, unit)] = want.get(floor_to(t, unit), 0) + 1
    assert got == want


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"], indirect=True)
def test_wall_clock_round_trip(times, zone):
    df, stamps = times
    back = df.filter("v >= 0").select("v", as_wall_clock(as_instant(F.col("ts"))).alias("t"))
    assert {r.v: r.t for r in back.collect()} == dict(enumerate(stamps))


@pytest.mark.parametrize("unit", UNITS)
def test_following_is_next_floor(unit):
    t = floor_to("2023-12-29 23:59:59", unit)
    assert floor_to(following(t, unit), unit) == following(t, unit) > t
    assert floor_to(following(t, unit) - timedelta(microseconds=1), unit) == t


def test_unknown_unit(times):
    with pytest.raises(ValueError, match="fortnight"):
        cf.bucket_series(times[0], "ts", "fortnight")


@pytest.mark.parametrize("unit", ["hour", "day", "week", "month", "quarter", "year"])
@pytest.mark.parametrize("by", [None, "g"])
def test_dense_has_every_bucket_once(times, unit, by):
    df, stamps = times
    df = df.withColumn("g", F.col("v") % 3)
    start, end = "2022-12-15 10:00", "2024-06-20"
    got = cf.dense_series(df, "ts", unit, by, start, end).collect()
    axis = [floor_to(start, unit)]
    while axis[-1] < floor_to(end, unit):
        axis.append(following(axis[-1], unit))
    want = {(g, b): 0 for g in ((0, 1, 2) if by else (None,)) for b in axis}
    for i, t in enumerate(stamps):
        key = (i % 3 if by else None, floor_to(t, unit))
        if key in want:
            want[key] += 1
    assert {((r.g if by else None), plain(r.bucket)): r.n for r in got} == want
    assert len(got) == len(want)


def test_dense_measures_and_bounds_from_data(spark):
    rows = [("a", "2024-01-01", 5), ("a", "2024-01-04", 1), ("b", "2024-01-03", None), (None, "2024-01-03", 2)]
    df = spark.createDataFrame(rows, "g string, d string, v int").withColumn("d", F.col("d").cast("date"))
    measures = [cf.count(), cf.total("t", F.col("v")), cf.greatest("top", F.col("v")), cf.mean("m", F.col("v"))]
    got = cf.dense_series(df, "d", "day", "g", measures=measures).collect()
    assert len(got) == 12
    cells = {(r.g, r.bucket.day): (r.n, r.t, r.top, r.m) for r in got}
    assert cells["a", 1] == (1, 5, 5, 5.0)
    assert cells["a", 2] == (0, 0, None, None)
    assert cells["b", 3] == (1, 0, None, None)
    assert cells[None, 3] == (1, 2, 2, 2.0)
    assert cells[None, 4] == (0, 0, None, None)


def test_dense_empty_input(spark):
    df = spark.createDataFrame([], "g string, d date")
    assert cf.dense_series(df, "d", "day").collect() == []
    assert cf.dense_series(df, "d", "day", "g", "2024-01-01", "2024-01-03").collect() == []
    fixed = cf.dense_series(df, "d", "day", (), "2024-01-01", "2024-01-03").collect()
    assert sorted((r.bucket.day, r.n) for r in fixed) == [(1, 0), (2, 0), (3, 0)]


def test_dense_start_after_end(spark):
    df = spark.createDataFrame([], "d date")
    with pytest.raises(ValueError, match="after"):
        cf.dense_series(df, "d", "day", (), "2024-02-01", "2024-01-03")


@pytest.mark.parametrize("n,block,chunks", [(1, 4, 3), (3, 4, 2), (7, 4, 5), (50, 8, 4), (5, 1 << 16, 1), (500, 4, 3)])
@pytest.mark.parametrize("by", [None, "g"])
@pytest.mark.parametrize("kind", ["double", "int", "decimal(8,1)"])
def test_moving_avg_equals_brute_force(spark, n, block, chunks, by, kind):
    rng = random.Random(n)
    rows = [("hot", date(2020, 1, 1) + timedelta(days=i), rng.choice([None, 1.0, 4.0, 10.0])) for i in range(120)]
    if by:
        rows += [(g, date(2020, 1, 1) + timedelta(days=3 * i), float(i)) for g in ("b", None) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, d date, v double").repartition(5).withColumn("v", F.col("v").cast(kind))
    got = cf.moving_avg(df, "d", "v", n, by or (), block=block, chunks=chunks).collect()
    assert len(got) == len(rows)
    for r in got:
        last = [v for g, d, v in rows if g == r.g and d <= r.d][-n:]
        last = [v for v in last if v is not None]
        assert r.moving_avg == (pytest.approx(fmean(last)) if last else None), r


def test_moving_avg_needs_positive_n(spark):
    with pytest.raises(ValueError):
        cf.moving_avg(spark.range(3), "id", "id", 0)


def test_ohlc_ties_do_not_depend_on_row_order(spark):
    rows = [("2024-01-01 10:00", 3.0), ("2024-01-01 10:00", 2.0), ("2024-01-01 12:00", 9.0),
            ("2024-01-01 15:00", 4.0), ("2024-01-01 15:00", 5.0), ("2024-01-02 00:00", 1.0),
            (None, 7.0), ("2024-01-01 09:00", None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "s string, v double").select(F.col("s").cast("timestamp_ntz").alias("t"), "v")
        got = sorted(tuple(r) for r in cf.ohlc(df, "t", "v", "day").collect())
        assert got == [(date(2024, 1, 1), 2.0, 9.0, 2.0, 5.0, 5), (date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1)]


def test_ohlc_distinct_times(spark, sf):
    events = cf.load(spark, sf, "events")
    slow = cf.ohlc(events, "ts", "value", "hour", "event_type")
    fast = cf.ohlc(events, "ts", "value", "hour", "event_type", distinct_times=True)
    assert slow.exceptAll(fast).count() == 0 and slow.count() == fast.count()
