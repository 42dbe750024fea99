"""Aggregation below joins.

A chart groups a fact table by attributes that sit several joins away.  Instead
of joining raw rows and grouping at the end, the fact rows are summed up by the
next join key before every join.  Map-side combining shrinks each key to one
row per task *before* it is shuffled, so a key that holds a third of the table
costs one row per map task instead of one giant reduce partition.  The shuffle
of each aggregation is also the one its join needs.

Tables that are small by their meaning are broadcast, so a join with them needs
no shuffle and no aggregation before it: those that follow one another are all
joined before the next aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartfold.functions.keys import all_of, names
from chartfold.functions.measures import Measure, finals, merges, partials


@dataclass(frozen=True)
class Lookup:
    """A table to join: ``left`` (columns so far) = ``right`` (its columns).

    ``small`` states that the table has a fixed number of rows that any task can
    hold, such as countries or months, however large the data are.
    """

    table: DataFrame
    left: str | Sequence[str]
    right: str | Sequence[str]
    how: str = "inner"
    small: bool = False

    def __post_init__(self):
        if self.how not in ("inner", "left"):
            raise ValueError(f"lookup join must be inner or left, got {self.how!r}")
        if len(names(self.left)) != len(names(self.right)):
            raise ValueError("lookup needs as many left as right columns")


def staged_totals(
    fact: DataFrame,
    by: str | Sequence[str],
    measures: Sequence[Measure],
    lookups: Sequence[Lookup] = (),
) -> DataFrame:
    """First-stage measure columns by ``by``; not yet finalised.

    Equal to joining everything first, also when a lookup's right key repeats:
    each of the matches then takes a copy of the sum, as it would of the rows.
    """
    by = names(by)

    def wanted(available: Sequence[str], rest: Sequence[Lookup]) -> list[str]:
        targets = set(by).union(*(names(lk.left) for lk in rest))
        return [c for c in available if c in targets]

    keys = wanted(fact.columns, lookups)
    current = fact.groupBy(*keys).agg(*partials(measures))
    for i, lk in enumerate(lookups):
        rest = lookups[i + 1:]
        left, right = names(lk.left), names(lk.right)
        carried = [c for c in wanted(lk.table.columns, rest) if c not in keys]
        on = [f"__on{i}_{j}" for j in range(len(right))]
        side = lk.table.select(
            *[F.col(c).alias(k) for c, k in zip(right, on)], *[F.col(c) for c in carried]
        )
        current = current.join(
            F.broadcast(side) if lk.small else side, all_of([F.col(a) == F.col(b) for a, b in zip(left, on)]), lk.how
        )
        there = [*keys, *carried]
        keys = wanted(there, rest)
        if rest and rest[0].small:
            current = current.drop(*on, *[c for c in there if c not in keys])
        else:
            current = current.groupBy(*keys).agg(*merges(measures))
    missing = [c for c in by if c not in keys]
    if missing:
        raise ValueError(f"no table supplies the grouping columns {missing}")
    return current


def totals(
    fact: DataFrame,
    by: str | Sequence[str],
    measures: Sequence[Measure],
    lookups: Sequence[Lookup] = (),
) -> DataFrame:
    staged = staged_totals(fact, by, measures, lookups)
    return staged.select(*names(by), *finals(measures))
