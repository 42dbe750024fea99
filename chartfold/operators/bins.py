"""Binned counts: histogram, heatmaps and 2-D density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartfold.functions.keys import present


def _finite(df: DataFrame, name: str) -> Column:
    if not isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.lit(True)
    return F.abs(F.col(name)) < F.lit(float("inf"))


def _guess(value: Column, low: Column, width: Column) -> Column:
    """The bin of ``value``, but for one that the quotient may miss by where it rounds."""
    return F.floor((value - low) / width)


def _placed(value: Column, bin: Column, low: Column, width: Column) -> Column:
    """The bin at or beside the guess ``bin``, a column, whose own edges, as they are put out, hold ``value``."""
    edge = lambda b: low + b * width
    return F.when(value < edge(bin), bin - 1).when(value >= edge(bin + 1), bin + 1).otherwise(bin)


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    lo: float | None = None,
    hi: float | None = None,
) -> DataFrame:
    """Counts in ``bins`` equal bins from ``lo`` to ``hi``, empty bins included.

    A bin holds its lower edge; the last one holds its upper edge too.  Without
    bounds, one extra pass over the value column finds them.  With bounds,
    values outside are left out, by a filter that the scan can take.  If all
    values are equal the bins reach half a unit to both sides.  Where no bound
    is given, infinite values have no place on the axis: those below it are
    counted in an additional bin ``-1``, those above it in bin ``bins``.
    """
    if bins < 1:
        raise ValueError(f"bins must be at least 1, got {bins}")
    if lo is not None and hi is not None and lo > hi:
        raise ValueError(f"lo {lo} is above hi {hi}")
    rows = present(df, value)
    if lo is not None:
        rows = rows.filter(F.col(value) >= F.lit(lo))
    if hi is not None:
        rows = rows.filter(F.col(value) <= F.lit(hi))
    finite, v = _finite(df, value), F.col(value)
    first = F.min(F.when(finite, v)).cast("double") if lo is None else F.lit(float(lo))
    last = F.max(F.when(finite, v)).cast("double") if hi is None else F.lit(float(hi))
    pad = F.when(first == last, F.lit(0.5)).otherwise(F.lit(0.0))
    low, width = first - pad, (last - first + 2 * pad) / bins
    if lo is None or hi is None:
        # one subquery that does all the arithmetic, as every mention is planned
        axis = rows.agg(F.struct(low.alias("low"), width.alias("width"))).scalar()
        low, width = axis.getField("low"), axis.getField("width")

    guessed = rows.select(value, F.when(finite, _guess(v, low, width)).alias("__guess"))
    place = F.greatest(F.lit(0), F.least(_placed(v, F.col("__guess"), low, width), F.lit(bins - 1)))
    place = F.when(finite, place).when(v < 0, F.lit(-1)).otherwise(F.lit(bins)).cast("int")
    counts = guessed.groupBy(place.alias("__bin")).agg(F.count(F.lit(1)).alias("__n"))
    frame = df.sparkSession.range(-1, bins + 1).select(
        F.col("id").cast("int").alias("bin"), low.alias("__lo"), width.alias("__w")
    )
    on_axis = (F.col("bin") >= 0) & (F.col("bin") < bins)
    infinity = F.lit(float("inf"))
    return (
        frame.join(counts, F.col("bin") == F.col("__bin"), "left")
        .filter(F.when(on_axis, F.col("__lo").isNotNull()).otherwise(F.col("__n").isNotNull()))
        .select(
            "bin",
            F.when(F.col("bin") < 0, -infinity).otherwise(F.col("__lo") + F.col("bin") * F.col("__w")).alias("bin_lo"),
            F.when(F.col("bin") >= bins, infinity)
            .otherwise(F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("bin_hi"),
            F.coalesce("__n", F.lit(0)).cast("bigint").alias("n"),
        )
    )


def heatmap(df: DataFrame, x: str, y: str) -> DataFrame:
    """Row counts per cell, one row per cell.  Rows without a place are left out."""
    return present(df, x, y).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))


def heatmap_wide(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Row counts per cell, one column for each of ``values``.

    The values must be given: finding them would be another job, and the schema
    would change with the data.
    """
    cells = present(df, row).groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return cells.na.fill(0, subset=[c for c in cells.columns if c != row])


def density2d(df: DataFrame, x: str, wx: float, y: str, wy: float) -> DataFrame:
    """Row counts on a grid of ``wx`` by ``wy`` cells; empty cells are left out.

    A cell holds its lower edges.  Values more than ``2 ** 53`` cells away from
    0, infinite ones among them, have no cell: their ``bin`` is null and their
    lower edge infinite.
    """
    if wx <= 0 or wy <= 0:
        raise ValueError(f"cell sizes must be positive, got {wx} and {wy}")
    axes = (("x", x, F.lit(float(wx))), ("y", y, F.lit(float(wy))))
    values = present(df, x, y).select(*[F.col(c).cast("double").alias(axis) for axis, c, _ in axes])
    guesses, keys, edges = {}, [], []
    for axis, _, width in axes:
        near = F.abs(F.col(axis) / width) < F.lit(2.0**53)
        guesses[f"__{axis}"] = F.when(near, _guess(F.col(axis), F.lit(0.0), width))
        cell = _placed(F.col(axis), F.col(f"__{axis}"), F.lit(0.0), width)
        keys.append(F.when(F.col(f"__{axis}").isNotNull(), cell).alias(f"{axis}_bin"))
        # all that lies beyond the grid on one side is one group
        keys.append(F.when(F.col(f"__{axis}").isNull(), F.signum(axis)).alias(f"{axis}_beyond"))
        edge = F.col(f"{axis}_bin") * width
        edges.append(F.coalesce(edge, F.col(f"{axis}_beyond") * F.lit(float("inf"))).alias(f"{axis}_lo"))
    cells = values.withColumns(guesses).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return cells.select("x_bin", "y_bin", *edges, "n")
