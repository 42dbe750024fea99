"""Every registered query against its SQL on DuckDB."""

import pytest

from __spark_entry__ import entry
from chartfold.queries import QUERIES, SQL
from oracle import compare


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert [f.name for f in entry(spark).schema] == ["r_name", "items", "revenue"]
    assert entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_equals_sql(spark, name, size):
    assert compare(spark, name, f"/root/testdata/sf{size}") > 0
