"""Time series: bucketed, gap-free, smoothed, and open-high-low-close."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartfold.functions.keys import names, row_hash
from chartfold.functions.measures import Measure, count, finals, partials
from chartfold.functions.timebuckets import (
    SUB_DAY,
    bucket_start,
    floor_to,
    following,
    literal,
    step,
)
from chartfold.plans.running import running_total

Moment = str | date | datetime


def _bucketed(df, ts, unit, measures, by, out):
    return (
        df.filter(F.col(ts).isNotNull())
        .withColumn(out, bucket_start(df, ts, unit))
        .groupBy(*by, out)
        .agg(*partials(measures))
        .select(*by, out, *finals(measures))
    )


def bucket_series(
    df: DataFrame,
    ts: str,
    unit: str,
    measures: Sequence[Measure] = (count(),),
    by: str | Sequence[str] = (),
    out: str = "bucket",
) -> DataFrame:
    """Totals per calendar bucket: a line.  Rows without a time are left out."""
    return _bucketed(df, ts, unit, measures, names(by), out)


def _between(df: DataFrame, ts: str, unit: str, start: Moment | None, end: Moment | None) -> DataFrame:
    """Rows of the buckets from ``start`` to ``end``, by filters the scan can take."""
    kind = df.schema[ts].dataType
    if start is not None:
        df = df.filter(F.col(ts) >= literal(floor_to(start, unit), kind))
    if end is not None:
        df = df.filter(F.col(ts) < literal(following(floor_to(end, unit), unit), kind))
    return df


def _block(bucket: Column, unit: str) -> Column:
    """The stretch of the calendar that one task fills: a day of fine buckets, a year of others."""
    return F.to_date(bucket) if unit in SUB_DAY else F.trunc(bucket, "year")


def _block_firsts(first: Column, last: Column, unit: str, kind: T.DataType) -> Column:
    """Array of the first bucket from ``first`` to ``last`` in every block between them."""
    if unit in SUB_DAY:
        starts = F.sequence(F.to_date(first), F.to_date(last), step("day"))
        return F.transform(starts, lambda d: F.greatest(first, d.cast(kind)))
    starts = F.sequence(F.trunc(first, "year"), F.trunc(last, "year"), step("year"))
    if unit == "week":  # the first Monday of the year
        bucket = lambda d: F.next_day(F.date_sub(d, 1), "MON")
    else:
        bucket = lambda d: d
    return F.filter(F.transform(starts, lambda d: F.greatest(first, bucket(d))), lambda b: b <= last)


def dense_series(
    df: DataFrame,
    ts: str,
    unit: str,
    by: str | Sequence[str] = (),
    start: Moment | None = None,
    end: Moment | None = None,
    measures: Sequence[Measure] = (count(),),
    out: str = "bucket",
) -> DataFrame:
    """``bucket_series`` with a row for every bucket from ``start`` to ``end``.

    Empty buckets get 0 for counts and sums, null for the other kinds.  Without
    ``start`` or ``end`` the first or last bucket seen is used.  Groups are
    those that have rows in the range.

    The gaps are filled after the shuffle, between neighbours of one group in
    one block of the calendar (a day, or a year for coarser buckets), so the
    filler rows are never shuffled themselves and a long series is filled by
    many tasks.  Every block starts with a marker, which is one row per block.
    """
    by = names(by)
    if start is not None and end is not None and floor_to(start, unit) > floor_to(end, unit):
        raise ValueError(f"start {start} is after end {end}")
    series = _bucketed(_between(df, ts, unit, start, end), ts, unit, measures, by, out)
    kind = series.schema[out].dataType
    bounds = None
    if start is None or end is None:
        bounds = series.agg(F.struct(
            F.min(out).alias("first"), F.max(out).alias("last"), F.max(row_hash(series)).alias("h")
        )).scalar()
    first = bounds.getField("first") if start is None else literal(floor_to(start, unit), kind)
    last = bounds.getField("last") if end is None else literal(floor_to(end, unit), kind)

    if by:  # reads all columns of the series, as the bounds do, and so shares its shuffle
        groups = series.groupBy(*by).agg(F.max(row_hash(series)).alias("__h")).filter(F.col("__h").isNotNull())
    else:
        groups = df.sparkSession.range(1).select()
    axis = groups.select(*by, first.alias("__first"), last.alias("__last")).filter(F.col("__first").isNotNull())
    firsts = _block_firsts(F.col("__first"), F.col("__last"), unit, kind)
    markers = axis.select(*by, F.explode(firsts).alias(out))
    rows = series.withColumn("__real", F.lit(True)).unionByName(markers, allowMissingColumns=True)
    rows = rows.withColumn("__block", _block(F.col(out), unit))
    if unit in SUB_DAY:
        # a few rows here may become very many: a number that is given keeps them in many tasks
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(tasks, *by, "__block")

    # the marker comes first of two rows of one bucket, and then fills nothing
    order = W.partitionBy(*by, "__block").orderBy(out, F.col("__real").asc_nulls_first())
    if unit in SUB_DAY:
        stop = F.col("__block").cast(kind) + step("day")
    else:
        stop = (F.col("__block") + step("year")).cast("date")
    seen = rows.withColumn("__next", F.lead(out).over(order)).select(
        "*", F.coalesce("__next", F.least(stop, (last + step(unit)).cast(kind))).alias("__stop")
    )
    # a week that begins in one year may end in the next: only starts count
    upto = F.greatest(F.col(out), (F.col("__stop") - F.expr("INTERVAL '1' MICROSECOND")).cast(kind)
                      if unit in SUB_DAY else F.date_sub(F.col("__stop"), 1))
    filled = (
        seen.filter(F.col("__next").isNull() | (F.col("__next") > F.col(out)))
        .withColumn("__at", F.explode(F.sequence(F.col(out), upto, step(unit))))
    )
    here = F.col("__real") & (F.col("__at") == F.col(out))

    def measure(m: Measure) -> Column:
        if not m.fills_with_zero:
            return F.when(here, F.col(m.name)).alias(m.name)
        zero = F.lit(0).cast(series.schema[m.name].dataType)
        return F.coalesce(F.when(here, F.col(m.name)), zero).alias(m.name)

    return filled.select(*by, F.col("__at").cast(kind).alias(out), *map(measure, measures))


def moving_avg(
    series: DataFrame,
    order: str,
    value: str,
    n: int,
    by: str | Sequence[str] = (),
    out: str = "moving_avg",
    block: int = 1 << 16,
    chunks: int | None = None,
) -> DataFrame:
    """Mean of the last ``n`` rows up to each row, nulls left out: a smoothed line.

    ``series`` holds one row per (``by``, ``order``), as the other series
    operators return it.  A row's place in its group comes from a distributed
    running count.  Groups are cut into blocks of places, and the last ``n - 1``
    rows of a block are copied to the next one.  For whole numbers and decimals
    a mean is the running sum within the block less that of ``n`` rows before,
    so the work does not depend on ``n``; floating sums would lose digits that
    way, so for them each row's frame is summed up.
    """
    if n < 1:
        raise ValueError(f"n must be at least 1, got {n}")
    by, columns, kind = names(by), series.columns, series.schema[value].dataType
    size = max(n, block)
    placed = running_total(series.withColumn("__one", F.lit(1)), [(order, True)], "__one", by, "__place", chunks=chunks)
    index = F.col("__place") - 1
    is_tail = index % size >= size - (n - 1)
    blocks = placed.withColumn("__block", F.floor(index / size)).withColumn(
        "__copy", F.explode(F.when(is_tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ).withColumn("__block", F.col("__block") + F.col("__copy"))
    ordered = W.partitionBy("__block", *by).orderBy("__place")
    if not isinstance(kind, (T.IntegralType, T.DecimalType)):
        mean = F.avg(value).over(ordered.rowsBetween(-(n - 1), 0))
        return blocks.withColumn(out, mean).filter(F.col("__copy") == 0).select(*columns, out)
    upto = ordered.rowsBetween(W.unboundedPreceding, 0)
    exact = F.col(value).cast(f"decimal(38,{getattr(kind, 'scale', 0)})")
    sums = blocks.withColumns({
        "__count": F.count(value).over(upto),
        "__total": F.coalesce(F.sum(exact).over(upto), F.lit(0).cast(f"decimal(38,{getattr(kind, 'scale', 0)})")),
    })
    earlier = sums.withColumns({
        "__count0": F.coalesce(F.lag("__count", n).over(ordered), F.lit(0)),
        "__total0": F.coalesce(F.lag("__total", n).over(ordered), F.lit(0)),
    })
    held = F.col("__count") - F.col("__count0")
    mean = (F.col("__total") - F.col("__total0")).cast("double") / F.nullif(held, F.lit(0)).cast("double")
    return earlier.filter(F.col("__copy") == 0).select(*columns, mean.alias(out))


def ohlc(
    df: DataFrame,
    ts: str,
    value: str,
    unit: str,
    by: str | Sequence[str] = (),
    out: str = "bucket",
    distinct_times: bool = False,
) -> DataFrame:
    """Open, high, low and close of ``value`` per bucket: a candlestick.

    Among rows of the same instant the open is the least value and the close
    the greatest, so that the result does not depend on the order of rows.
    Comparing (time, value) pairs makes Spark sort each task's rows by bucket:
    a hash aggregation holds only fixed-width numbers in place, and SQL has no
    order-keeping map of doubles to such numbers that could join them with a
    time.  With ``distinct_times`` the caller states that no instant repeats
    within a bucket; times alone are then compared, in a hash aggregation.
    """
    by = names(by)
    rows = (
        df.filter(F.col(ts).isNotNull() & F.col(value).isNotNull())
        .withColumn(out, bucket_start(df, ts, unit))
    )
    if distinct_times:
        first, last = F.min_by(value, ts), F.max_by(value, ts)
    else:
        at = F.struct(F.col(ts).alias("at"), F.col(value).alias("value"))
        first, last = F.min(at).getField("value"), F.max(at).getField("value")
    return rows.groupBy(*by, out).agg(
        first.alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        last.alias("close"),
        F.count(F.lit(1)).alias("n"),
    )
