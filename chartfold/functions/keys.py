"""Small helpers over column names and sort keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SortKey = tuple[str, bool]
"""A column name and whether it sorts ascending."""


def names(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def sort_columns(order: Sequence[SortKey]) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def all_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True)) if conds else F.lit(True)


def sort_key(df: DataFrame, order: Sequence[SortKey]) -> Column:
    """A struct whose own ascending order is ``order``.

    Structs compare field by field with nulls first, as ascending columns do.
    A descending column, which must be a number, turns into its null flag, its
    NaN flag and its reverse.
    """
    fields = []
    for name, asc in order:
        column, kind = F.col(name), df.schema[name].dataType
        if asc:
            fields.append(column)
        elif isinstance(kind, T.IntegralType):
            fields += [column.isNull(), F.bitwise_not(column)]  # a minus could overflow
        elif isinstance(kind, T.DecimalType):
            fields += [column.isNull(), -column]
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            fields += [column.isNull(), ~F.isnan(column), -column]
        else:
            raise ValueError(f"descending order needs a number, {name!r} is {kind.simpleString()}")
    return F.struct(*[f.alias(f"k{i}") for i, f in enumerate(fields)])


def present(df: DataFrame, *cols: str) -> DataFrame:
    """Rows that have a place on the axis: neither null nor NaN in ``cols``."""
    for c in cols:
        df = df.filter(F.col(c).isNotNull())
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            df = df.filter(~F.isnan(c))
    return df


def row_hash(df: DataFrame) -> Column:
    """A hash over all columns.

    Branches of one plan can share a shuffle only if they read the same
    columns from it.  A branch that needs fewer uses this to keep the rest.
    """
    return F.xxhash64(*[F.col(c) for c in df.columns])
