"""Calendar buckets, written so that no result depends on the session time zone
when the time column is ``TIMESTAMP_NTZ``.

Day and coarser buckets are ``DATE`` values; finer ones keep the type of the
time column.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUB_DAY = ("second", "minute", "hour")
CALENDAR = ("day", "week", "month", "quarter", "year")
UNITS = SUB_DAY + CALENDAR

_STEP = {
    "second": "INTERVAL '1' SECOND",
    "minute": "INTERVAL '1' MINUTE",
    "hour": "INTERVAL '1' HOUR",
    "day": "INTERVAL '1' DAY",
    "week": "INTERVAL '7' DAY",
    "month": "INTERVAL '1' MONTH",
    "quarter": "INTERVAL '3' MONTH",
    "year": "INTERVAL '1' YEAR",
}


def check_unit(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}, expected one of {UNITS}")
    return unit


def step(unit: str) -> Column:
    """The length of one bucket, as an interval."""
    return F.expr(_STEP[check_unit(unit)])


def bucket_start(df: DataFrame, ts: str, unit: str) -> Column:
    """First instant of the bucket that ``df[ts]`` falls into."""
    check_unit(unit)
    kind = df.schema[ts].dataType
    if unit == "day":
        return F.to_date(F.col(ts))
    if unit in CALENDAR:
        return F.trunc(F.to_date(F.col(ts)), unit)
    if isinstance(kind, T.TimestampNTZType):
        # window() is plain arithmetic on the wall clock; date_trunc() would
        # go through the session zone and move times inside a DST gap
        return F.window(F.col(ts), f"1 {unit}").getField("start")
    return F.date_trunc(unit, F.col(ts))


def as_instant(ts: Column) -> Column:
    """A wall-clock (NTZ) time read as UTC, whatever the session zone is."""
    return F.make_timestamp(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts),
        F.date_part(F.lit("SECOND"), ts), F.lit("UTC"),
    )


def as_wall_clock(instant: Column) -> Column:
    """Inverse of :func:`as_instant`."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def floor_to(moment: str | date | datetime, unit: str) -> datetime:
    """``bucket_start`` for a value known when the plan is written."""
    check_unit(unit)
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    elif not isinstance(moment, datetime):
        moment = datetime(moment.year, moment.month, moment.day)
    cut = {"second": 6, "minute": 5, "hour": 4}.get(unit, 3)
    moment = datetime(*moment.timetuple()[:cut])
    if unit == "week":
        return moment - timedelta(days=moment.weekday())
    if unit == "month":
        return moment.replace(day=1)
    if unit == "quarter":
        return moment.replace(month=(moment.month - 1) // 3 * 3 + 1, day=1)
    if unit == "year":
        return moment.replace(month=1, day=1)
    return moment


def following(bucket: datetime, unit: str) -> datetime:
    """Start of the bucket after ``bucket``, which must be a bucket start."""
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    if months is None:
        return bucket + timedelta(seconds={
            "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800,
        }[check_unit(unit)])
    index = bucket.year * 12 + bucket.month - 1 + months
    return bucket.replace(year=index // 12, month=index % 12 + 1)


def literal(moment: datetime, kind: T.DataType) -> Column:
    """``moment`` as a literal of the column's own type.

    A Python ``datetime`` literal would be a zoned timestamp: comparing it with
    an NTZ column casts the column, and the filter no longer reaches the scan.
    """
    return F.lit(moment.isoformat(sep=" ")).cast(kind)
