"""Grouped totals and the hierarchy above them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartfold.functions.keys import names
from chartfold.functions.measures import Measure, count, finals, merges
from chartfold.plans.eager import Lookup, staged_totals, totals


def grouped_totals(
    df: DataFrame,
    by: str | Sequence[str],
    measures: Sequence[Measure] = (count(),),
    lookups: Sequence[Lookup] = (),
) -> DataFrame:
    """One row per group: a bar chart.

    ``by`` may name columns of the ``lookups``, which are joined in the order
    given; ``measures`` are over the columns of ``df``.
    """
    return totals(df, by, measures, lookups)


def hierarchy(
    df: DataFrame,
    levels: Sequence[str],
    measures: Sequence[Measure] = (count(),),
    lookups: Sequence[Lookup] = (),
) -> DataFrame:
    """Totals of every level from the grand total down: sunburst or treemap.

    ``depth`` is the number of levels that a row is split by, so 0 is the grand
    total; it tells a subtotal from a label that is null.  The rollup copies
    its input once per level, so it runs on the leaf totals, not on the rows.
    """
    levels = names(levels)
    leaves = staged_totals(df, levels, measures, lookups)
    depth = reduce(lambda a, b: a + b, [1 - F.grouping(c).cast("int") for c in levels])
    return (
        leaves.rollup(*levels)
        .agg(depth.alias("depth"), *merges(measures))
        .select(*levels, "depth", *finals(measures))
    )
