"""Measures that can be summed up in stages.

A chart operator often aggregates twice: once before a shuffle or a join, and
again on the reduced rows.  A ``Measure`` knows its first-stage aggregate, the
aggregate that merges first-stage results, and the final expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("count", "sum", "exact", "min", "max", "avg")

LANE_BITS = 20


@dataclass(frozen=True)
class Measure:
    name: str
    kind: str
    expr: Column | None = None
    scale: int = 0

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown measure kind {self.kind!r}, expected one of {KINDS}")
        if self.expr is None and self.kind != "count":
            raise ValueError(f"measure {self.name!r} of kind {self.kind!r} needs an expression")

    @property
    def fills_with_zero(self) -> bool:
        """Whether an empty bucket counts as 0 (otherwise it is null)."""
        return self.kind in ("count", "sum", "exact")

    def partial(self) -> list[Column]:
        if self.kind == "avg":
            return [
                F.sum(self.expr).alias(f"{self.name}__sum"),
                F.count(self.expr).alias(f"{self.name}__n"),
            ]
        if self.kind == "exact":
            return [
                F.sum(F.shiftright(self.expr, LANE_BITS)).alias(f"{self.name}__hi"),
                F.sum(self.expr.bitwiseAND(F.lit((1 << LANE_BITS) - 1))).alias(f"{self.name}__lo"),
            ]
        if self.kind == "count":
            return [F.count(F.lit(1) if self.expr is None else self.expr).alias(self.name)]
        return [getattr(F, self.kind)(self.expr).alias(self.name)]

    def merge(self) -> list[Column]:
        if self.kind == "avg":
            return [F.sum(c).alias(c) for c in (f"{self.name}__sum", f"{self.name}__n")]
        if self.kind == "exact":
            return [F.sum(c).alias(c) for c in (f"{self.name}__hi", f"{self.name}__lo")]
        fn = F.sum if self.kind in ("count", "sum") else getattr(F, self.kind)
        return [fn(self.name).alias(self.name)]

    def final(self) -> Column:
        if self.kind == "avg":
            # nullif: with ANSI mode on, dividing by zero is an error
            n = F.nullif(F.col(f"{self.name}__n"), F.lit(0))
            return (F.col(f"{self.name}__sum").cast("double") / n).alias(self.name)
        if self.kind == "exact":
            hi, lo = (F.col(f"{self.name}__{lane}").cast("decimal(20,0)") for lane in ("hi", "lo"))
            units = hi * F.lit(1 << LANE_BITS).cast("decimal(8,0)") + lo
            digits = F.lit(f"1e-{self.scale}").cast(f"decimal({self.scale + 1},{self.scale})")
            return (units * digits).cast(f"decimal(38,{self.scale})").alias(self.name)
        if self.kind == "count":
            return F.coalesce(F.col(self.name), F.lit(0).cast("bigint")).alias(self.name)
        return F.col(self.name)


def count(name: str = "n", expr: Column | None = None) -> Measure:
    """Number of rows, or of non-null values of ``expr``."""
    return Measure(name, "count", expr)


def total(name: str, expr: Column) -> Measure:
    return Measure(name, "sum", expr)


def exact_total(name: str, units: Column, scale: int = 0) -> Measure:
    """Exact sum of fixed-point values: ``units`` counts them in ``10 ** -scale``.

    A sum of doubles over a large table depends on the order of rows, and a sum
    of decimals is slow.  This one adds the high and low bits of whole units as
    two longs, and joins them in a decimal once per group.  A long would take
    more than ``2 ** 43`` rows to overflow in the low bits, and such an overflow
    is an error under ANSI mode, never a wrong sum.
    """
    return Measure(name, "exact", units.cast("bigint"), scale)


def mean(name: str, expr: Column) -> Measure:
    return Measure(name, "avg", expr)


def least(name: str, expr: Column) -> Measure:
    return Measure(name, "min", expr)


def greatest(name: str, expr: Column) -> Measure:
    return Measure(name, "max", expr)


def partials(measures: Sequence[Measure]) -> list[Column]:
    return [c for m in measures for c in m.partial()]


def merges(measures: Sequence[Measure]) -> list[Column]:
    return [c for m in measures for c in m.merge()]


def finals(measures: Sequence[Measure]) -> list[Column]:
    return [m.final() for m in measures]
