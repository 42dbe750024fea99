"""Training-data queries that SQL can express against DuckDB."""

import pytest

from chartfold.llm.queries import SQL
from oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    assert compare(spark, name, sf) > 0
