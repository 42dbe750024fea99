"""Running totals over a global order, without ever sorting in one task.

A window without ``partitionBy`` moves its whole input into one task, and a
window partitioned by a hot group moves that group into one.  Here Spark deals
the rows out by range once; the partition that a row lands in is its chunk.  The
chunks are written to the shared folder, so that all readers agree on them.
Each chunk is summed up on its own, and the totals of the chunks before it are
added.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartfold.functions.keys import SortKey, all_of, names, same, sort_columns
from chartfold.sources.scratch import stored


@dataclass(frozen=True)
class Chunked:
    """Rows of groups in an order, cut into chunks; see :func:`in_chunks`.

    ``pieces`` has one row for each group in each chunk: ``__c`` (the chunk), the
    group as ``__by_*``, per measure ``__sum_*`` (its sum in the piece),
    ``__before_*`` (in the group's earlier pieces) and ``__all_*`` (in the whole
    group), ``__split`` (whether the group has other pieces), and ``__min`` and
    ``__max`` of the first column of the order.
    """

    rows: DataFrame
    columns: Sequence[str]
    order: Sequence[SortKey]
    by: Sequence[str]
    measures: Sequence[str]
    pieces: DataFrame

    @property
    def spans(self) -> DataFrame:
        """Pieces of groups that cross a chunk boundary.

        A boundary splits one group at most, so these are at most two rows per
        chunk, whatever the size of the data.
        """
        return self.pieces.filter("__split")

    def on_piece(self) -> Column:
        """Joins rows with their piece."""
        return all_of([
            F.col("__chunk") == F.col("__c"), *[same(F.col(c), F.col(f"__by_{c}")) for c in self.by]
        ])

    def upto(self, measure: str, before: Column) -> Column:
        """The running sum of ``measure`` within a piece, and what lies before it."""
        kind = self.rows.select(F.sum(measure).alias("s")).schema["s"].dataType
        zero = F.lit(0).cast(kind)
        piece = W.partitionBy("__chunk", *self.by).orderBy(*sort_columns(self.order))
        here = F.sum(measure).over(piece.rowsBetween(W.unboundedPreceding, 0))
        return (F.coalesce(before, zero) + F.coalesce(here, zero)).cast(kind)

    def running(self, out: str | Sequence[str], total: str | Sequence[str] = ()) -> DataFrame:
        """Running sums ``out`` and sums over the group ``total``, one per measure."""
        known = self.rows.join(F.broadcast(self.spans), self.on_piece(), "left")
        added = [
            self.upto(m, F.col(f"__before_{m}")).alias(o) for m, o in zip(self.measures, names(out), strict=True)
        ]
        whole = W.partitionBy("__chunk", *self.by)
        for m, t in zip(self.measures, names(total)):
            kind = self.rows.select(F.sum(m).alias("s")).schema["s"].dataType
            added.append(F.coalesce(f"__all_{m}", F.sum(m).over(whole), F.lit(0).cast(kind)).alias(t))
        return known.select(*self.columns, *added)


def in_chunks(
    df: DataFrame,
    order: Sequence[SortKey],
    measures: str | Sequence[str],
    by: str | Sequence[str] = (),
    chunks: int | None = None,
) -> Chunked:
    """Cuts ``df`` into chunks of contiguous (``by``, ``order``).  Runs a job.

    ``df`` must hold one row per (``by``, ``order``): reduce it first.  Then no
    two rows tie, so every chunk can be cut to size whatever the data are.
    Adaptive execution joins small chunks up to its advised partition size, so
    their number follows the data and not the settings.  ``chunks``, if given, is
    the most there may be.
    """
    by, measures, columns = names(by), names(measures), df.columns
    keys = [*sort_columns([(c, True) for c in by]), *sort_columns(order)]
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number given to repartitionByRange is kept; without one it adapts
    dealt = df.repartitionByRange(chunks, *keys) if chunks and chunks < most else df.repartitionByRange(*keys)
    rows = stored(dealt.withColumn("__chunk", F.spark_partition_id()), "chunks")

    first = order[0][0]
    sums = rows.groupBy("__chunk", *by).agg(
        *[F.sum(m).alias(f"__sum_{m}") for m in measures], F.min(first).alias("__min"), F.max(first).alias("__max")
    )
    group = W.partitionBy(*by)
    earlier = group.orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    pieces = sums.select(
        F.col("__chunk").alias("__c"),
        *[F.col(c).alias(f"__by_{c}") for c in by],
        *[F.col(f"__sum_{m}") for m in measures],
        *[F.sum(f"__sum_{m}").over(earlier).alias(f"__before_{m}") for m in measures],
        *[F.sum(f"__sum_{m}").over(group).alias(f"__all_{m}") for m in measures],
        (F.count(F.lit(1)).over(group) > 1).alias("__split"),
        "__min", "__max",
    )
    return Chunked(rows, columns, order, by, measures, pieces)


def running_total(
    df: DataFrame,
    order: Sequence[SortKey],
    measure: str | Sequence[str],
    by: str | Sequence[str] = (),
    out: str | Sequence[str] = "running",
    total: str | Sequence[str] = (),
    chunks: int | None = None,
) -> DataFrame:
    """``df`` with the sum of each measure up to each row, and over its group.

    ``df`` must hold one row per (``by``, ``order``); see :func:`in_chunks`.
    """
    return in_chunks(df, order, measure, by, chunks).running(out, total)
