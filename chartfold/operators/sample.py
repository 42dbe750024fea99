"""Repeatable samples for scatter plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keyed_sample(df: DataFrame, key: str, mod: int, rem: int = 0) -> DataFrame:
    """Rows whose key leaves remainder ``rem`` modulo ``mod``.

    The same keys are taken on every run and from every table, so samples join.
    Negative keys count upwards (-1 leaves ``mod - 1``).  Keys that are not
    integers go by their hash.
    """
    if mod < 1 or not 0 <= rem < mod:
        raise ValueError(f"need mod >= 1 and 0 <= rem < mod, got {mod} and {rem}")
    column = F.col(key)
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        column = F.when(column.isNotNull(), F.xxhash64(column))
    return df.filter(F.pmod(column, F.lit(mod)) == rem)
