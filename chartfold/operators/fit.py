"""Linear relations between measures."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartfold.functions.keys import names


def _correlation(a: str, b: str) -> Column:
    if a == b:
        return F.var_pop(a) / F.nullif(F.var_pop(a), F.lit(0.0))
    # corr() divides by zero on a constant column, which ANSI mode makes an error
    spread = F.sqrt(F.regr_sxx(F.col(a), F.col(b))) * F.sqrt(F.regr_syy(F.col(a), F.col(b)))
    return F.regr_sxy(F.col(a), F.col(b)) / F.nullif(spread, F.lit(0.0))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every two columns: a correlation heatmap.

    One row per ordered pair.  A pair counts the rows where both values are
    there; it is null if one of them does not vary.  All pairs come from one
    aggregation over one scan.
    """
    cols = names(cols)
    pairs = [(a, a) for a in cols] + list(combinations(cols, 2))
    alias = {p: f"__{i}" for i, p in enumerate(pairs)}
    wide = df.agg(*[_correlation(a, b).alias(alias[a, b]) for a, b in pairs])
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"),
                 F.col(alias[(a, b) if (a, b) in alias else (b, a)]).alias("corr"))
        for a in cols for b in cols
    ]
    return wide.select(F.inline(F.array(*cells)))


def trend_line(df: DataFrame, x: str, y: str, by: str | Sequence[str] = ()) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per group, over rows that have both.

    Slope and intercept are null if ``x`` does not vary.
    """
    fx, fy = F.col(x), F.col(y)
    return df.groupBy(*names(by)).agg(
        F.regr_slope(fy, fx).alias("slope"),
        F.regr_intercept(fy, fx).alias("intercept"),
        F.regr_r2(fy, fx).alias("r2"),
        F.min(F.when(fy.isNotNull(), fx)).alias("x_min"),
        F.max(F.when(fy.isNotNull(), fx)).alias("x_max"),
        F.regr_count(fy, fx).alias("n"),
    )
