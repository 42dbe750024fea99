"""Distribution of a measure: empirical CDF and box summary, both exact."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartfold.functions.keys import all_of, names, present, same
from chartfold.plans.running import in_chunks, running_total
from chartfold.sources.scratch import stored

QUARTILES = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))


def _value_counts(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return present(df, value).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def ecdf(df: DataFrame, value: str, by: str | Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """Share of each group's rows at or below every distinct value.

    One row per step of the curve, with the number ``n`` of rows on that value.
    """
    by = names(by)
    steps = running_total(
        _value_counts(df, value, by), [(value, True)], "n", by, out="__below", total="__rows", chunks=chunks
    )
    share = F.col("__below").cast("double") / F.col("__rows").cast("double")
    return steps.select(*by, value, "n", share.alias("cume_dist"))


def box_summary(
    df: DataFrame,
    value: str,
    by: str | Sequence[str] = (),
    whisker: float = 1.5,
    chunks: int | None = None,
) -> DataFrame:
    """Quartiles, whiskers and outlier count per group: a box plot.

    Quartiles interpolate linearly; one between two infinite values, or next to
    one, is infinite or NaN.  Whiskers are the extreme *observed* values within
    ``whisker`` times the interquartile range of the box.

    The distinct values of a group lie in order in pieces.  The totals of the
    pieces tell which of them hold a quartile and which of them a fence cuts;
    values are looked at one by one in those only.  The table of pieces is
    written to the shared folder, and again with the quartiles, as each has
    several readers.
    """
    by = names(by)
    cut = in_chunks(_value_counts(df, value, by), [(value, True)], "n", by, chunks)
    cut = replace(cut, pieces=stored(cut.pieces, "pieces"))
    group = [F.col(f"__by_{c}").alias(c) for c in by]
    before, held, rows = F.col("__before_n"), F.col("__sum_n"), F.col("__all_n")
    before = F.coalesce(before, F.lit(0))

    def rank(p: float) -> Column:
        return (rows - 1) * F.lit(p)

    def holds(r: Column) -> Column:
        return (before <= r) & (r < before + held)

    ranks = [f(rank(p)) for _, p in QUARTILES for f in (F.floor, F.ceil)]
    ranked = cut.pieces.filter(reduce(lambda a, b: a | b, map(holds, ranks)))
    upto = cut.rows.join(ranked, cut.on_piece()).withColumn("__upto", cut.upto("n", F.col("__before_n")))

    def term(p: float) -> Column:
        """What a row adds to its group's ``p`` quantile: it has one or two terms."""
        number, upper = F.col(value).cast("double"), rank(p) - F.floor(rank(p))
        low, high = (
            (F.col("__upto") - F.col("n") <= r) & (r < F.col("__upto")) for r in (F.floor(rank(p)), F.ceil(rank(p)))
        )
        return F.when(low & high, number).when(low, number * (1 - upper)).when(high, number * upper)

    quartiles = upto.groupBy(*[F.col(f"__by_{c}").alias(f"__q_{c}") for c in by]).agg(
        *[F.sum(term(p)).alias(q) for q, p in QUARTILES]
    )
    reach = (F.col("q3") - F.col("q1")) * F.lit(whisker)
    fences = [(F.col("q1") - reach).alias("__lo"), (F.col("q3") + reach).alias("__hi")]
    found = cut.pieces.join(quartiles, all_of([same(F.col(f"__by_{c}"), F.col(f"__q_{c}")) for c in by]))
    boxed = stored(found.select(*cut.pieces.columns, "q1", "median", "q3", *fences), "boxes")

    v, lo, hi = F.col(value), F.col("__lo"), F.col("__hi")
    first, last = F.col("__min"), F.col("__max")
    inside, outside = (first >= lo) & (last <= hi), (last < lo) | (first > hi)
    # a fence may cut some pieces; the others count as a whole
    whole = boxed.select(
        *group, "q1", "median", "q3", held.alias("n"), first.alias("min"), last.alias("max"),
        F.when(inside, first).alias("whisker_lo"), F.when(inside, last).alias("whisker_hi"),
        F.when(outside, held).otherwise(F.lit(0)).alias("outliers"),
    )
    near = boxed.filter(~(inside | outside)).select("__c", *[f"__by_{c}" for c in by], "q1", "median", "q3", "__lo", "__hi")
    at = cut.rows.join(near, cut.on_piece())
    within = (v >= lo) & (v <= hi)
    single = at.select(
        *group, "q1", "median", "q3", F.lit(0).cast("bigint").alias("n"), v.alias("min"), v.alias("max"),
        F.when(within, v).alias("whisker_lo"), F.when(within, v).alias("whisker_hi"),
        F.when(within, F.lit(0)).otherwise(F.col("n")).alias("outliers"),
    )
    return (
        whole.unionByName(single)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("n"), F.min("min").alias("min"), F.min("whisker_lo").alias("whisker_lo"),
            F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
            F.max("whisker_hi").alias("whisker_hi"), F.max("max").alias("max"), F.sum("outliers").alias("outliers"),
        )
        .filter(F.col("n").isNotNull())
    )
