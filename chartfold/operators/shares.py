"""Parts of a whole: Pareto, pie and funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartfold.functions.keys import all_of, names, same, sort_columns
from chartfold.functions.measures import Measure, count
from chartfold.plans.eager import Lookup, totals
from chartfold.plans.running import running_total

LANE = 62


def _single(measure: Measure) -> Measure:
    if not measure.fills_with_zero:
        raise ValueError(f"shares need a count or a sum, got {measure.kind!r}")
    return measure


def cumulative(
    df: DataFrame,
    by: str | Sequence[str],
    measure: Measure = count(),
    lookups: Sequence[Lookup] = (),
    chunks: int | None = None,
) -> DataFrame:
    """Totals with their running sum and share, largest first: a Pareto chart.

    Equal totals go by key.  The running sum is distributed, so ``by`` may have
    any number of keys.
    """
    by, name = names(by), _single(measure).name
    reduced = totals(df, by, [measure], lookups)
    order = [(name, False), *[(c, True) for c in by]]
    ranked = running_total(
        reduced, order, name, out="cumulative", total="__all", chunks=chunks
    )
    whole = F.nullif(F.col("__all").cast("double"), F.lit(0.0))
    return ranked.select(
        *by, name, "cumulative", (F.col("cumulative").cast("double") / whole).alias("cumulative_share")
    )


def topk_share(
    df: DataFrame,
    by: str | Sequence[str],
    k: int,
    measure: Measure = count(),
    lookups: Sequence[Lookup] = (),
) -> DataFrame:
    """The ``k`` largest groups, the rest as one, and their shares: a pie.

    The row for the rest has ``is_other`` set and null keys.  Equal totals go
    by key.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    by, name = names(by), _single(measure).name
    reduced = totals(df, by, [measure], lookups)
    best = reduced.orderBy(*sort_columns([(name, False), *[(c, True) for c in by]])).limit(k).select(
        *[F.col(c).alias(f"__top_{c}") for c in by], F.lit(True).alias("__top")
    )
    tagged = reduced.join(
        best, all_of([same(F.col(c), F.col(f"__top_{c}")) for c in by]), "left"
    )
    slices = tagged.groupBy(
        *[F.when(F.col("__top"), F.col(c)).alias(c) for c in by],
        F.col("__top").isNull().alias("is_other"),
    ).agg(F.sum(name).alias(name))
    whole = F.sum(name).over(W.partitionBy())  # over k + 1 rows
    return slices.select(
        *by, "is_other", name,
        (F.col(name).cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))).alias("share"),
    )


def funnel(df: DataFrame, user: str, type: str, steps: Sequence[str]) -> DataFrame:
    """Users that did each step and all steps before it, in any order of time.

    One row per step.  A user's rows collapse to a bit per step on the map side,
    so a very active user is no larger than another after the shuffle.
    """
    steps = list(steps)
    if not steps or len(set(steps)) != len(steps):
        raise ValueError("funnel needs different steps, one at least")
    # a bit for every step, as many longs as they need
    lanes = [steps[i : i + LANE] for i in range(0, len(steps), LANE)]
    did = []
    for n, lane in enumerate(lanes):
        bit = F.lit(0).cast("bigint")
        for i, s in enumerate(lane):
            bit = F.when(F.col(type) == s, F.lit(1 << i).cast("bigint")).otherwise(bit)
        did.append(F.bit_or(bit).alias(f"__did{n}"))
    users = df.filter(F.col(type).isin(steps) & F.col(user).isNotNull()).groupBy(user).agg(*did)

    def upto(i: int) -> Column:
        bits = [(1 << min(LANE, i + 1 - n * LANE)) - 1 for n in range(i // LANE + 1)]
        return all_of([F.col(f"__did{n}").bitwiseAND(F.lit(b)) == F.lit(b) for n, b in enumerate(bits)])

    return users.agg(*[F.count_if(upto(i)).alias(f"__{i}") for i in range(len(steps))]).select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias(type), F.col(f"__{i}").alias("users"))
        for i, s in enumerate(steps)
    ])))
