"""Folders for stream state and written results, where all machines see them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
WAREHOUSE = "spark.sql.warehouse.dir"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # what goes to a Python worker at once; a number of rows says little about their size


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one in ``spark.checkpoint.dir``.

    Where that is not set, the folder lies below the session's warehouse, which
    all machines of a cluster share too.  A machine's own temporary folder is
    never used.
    """
    base = spark.conf.get(SETTING, None) or f"{spark.conf.get(WAREHOUSE).rstrip('/')}/_scratch"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that are run within it send their rows to Python workers by :data:`BATCH_BYTES`."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df``, computed once, written to the shared folder and read from there.

    Everything that reads it sees the same rows, also after executors are lost,
    and its lineage ends here.  The file is as temporary as a checkpoint: whoever
    owns the shared folder clears it.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_blocks(df: DataFrame, purpose: str) -> DataFrame:
    """:func:`stored` for rows that Python workers make and that hold megabytes each.

    Workers get their rows in small batches, and every row is a row group: a reader
    lays out up to 4096 rows of a row group at a time, with all of their arrays.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    with small_batches(spark):
        df.write.option("parquet.block.row.count.limit", 1).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
