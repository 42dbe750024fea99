"""Windowed series over a stream of events, and the sinks that keep them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chartfold.functions.keys import names
from chartfold.functions.measures import Measure, count, finals, partials
from chartfold.functions.timebuckets import as_instant, as_wall_clock

EDGES = ("window_start", "window_end")


def live_series(
    stream: DataFrame,
    ts: str,
    window: str | None,
    by: str | Sequence[str] = (),
    watermark: str = "1 hour",
    slide: str | None = None,
    session_gap: str | None = None,
    measures: Sequence[Measure] = (count(),),
) -> DataFrame:
    """Totals per time window: a live line.

    Give ``window`` (with ``slide`` for overlapping ones) or ``session_gap``.
    State older than the watermark is dropped, so it is bounded by the windows
    that are still open.  On a bounded table the result is the same, without
    the waiting.
    """
    if (window is None) == (session_gap is None) or (slide and not window):
        raise ValueError("give either window (and slide, if they overlap) or session_gap")
    by = names(by)
    wall = isinstance(stream.schema[ts].dataType, T.TimestampNTZType)
    # a watermark needs an instant; NTZ times are read as UTC and given back so
    timed = stream.withColumn("__at", as_instant(F.col(ts)) if wall else F.col(ts))
    if session_gap:
        slot = F.session_window("__at", session_gap)
    else:
        slot = F.window("__at", window, slide)
    staged = timed.withWatermark("__at", watermark).groupBy(slot.alias("__slot"), *by).agg(*partials(measures))
    edges = [F.col("__slot").getField(side) for side in ("start", "end")]
    if wall:
        edges = [as_wall_clock(e) for e in edges]
    return staged.select(*[e.alias(n) for e, n in zip(edges, EDGES)], *by, *finals(measures))


def append_series(
    series: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    every: str = "1 minute",
) -> StreamingQuery:
    """Write every window once, when the watermark has closed it.

    The file sink's log makes this exactly-once over restarts.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (
        series.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _put(rows: DataFrame, path: str, batch: int) -> None:
    """Writes ``rows`` as the partition ``batch`` below ``path``, in place of one that is there."""
    numbered = rows.withColumn("batch", F.lit(batch).cast("bigint"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def upsert_series(
    series: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    every: str = "1 minute",
) -> StreamingQuery:
    """Write every changed window in every batch, open ones included.

    Batch ``N`` is the partition ``batch=N`` of a plain Parquet table, written by
    Spark's dynamic partition overwrite: a batch that is tried again replaces
    its own partition and no other.  A reader sees a batch whole or not at all;
    while one is replaced, it may see the windows as they were a batch before,
    or find a file gone that it had listed, and has to read again.

    Read the current state with :func:`latest_series`, a Spark job over the
    versions; write what it returns elsewhere to be rid of old ones.  Session
    windows cannot be written this way, as Spark has no update mode for them.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (
        series.writeStream.outputMode("update")
        .foreachBatch(lambda changed, batch: _put(changed, path, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def drain_series(series: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all windows of a stream that ends, closed or still open.

    Works for session windows too.  State is kept for every window, so this is
    for bounded input, such as a backfill; every batch writes the whole series
    in place of the one before.  Read it with :func:`latest_series` when the
    stream has ended.
    """
    return (
        series.writeStream.outputMode("complete")
        .foreachBatch(lambda whole, batch: _put(whole, path, 0))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_series(
    spark: SparkSession, path: str, schema: T.StructType, by: str | Sequence[str] = ()
) -> DataFrame:
    """Newest version of every window that was written to ``path``; no rows where none was.

    ``by`` are the keys of the series beside its window.
    """
    kept = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        versions = spark.read.schema(kept).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    keys = [*EDGES, *names(by)]
    measures = [c for c in schema.fieldNames() if c not in keys]
    newest = [F.max_by(m, "batch").alias(m) for m in measures]
    return versions.groupBy(*keys).agg(*newest).select(*schema.fieldNames())
