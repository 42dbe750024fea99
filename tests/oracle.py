"""Runs a registered query on Spark and its SQL on DuckDB and compares them."""

from __future__ import annotations

from pathlib import Path

import duckdb

from __spark_entry__ import oracle_sql, queries

TESTDATA = Path("/root/testdata")


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canonical(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def compare(spark, name: str, directory: str) -> int:
    """Raises on a difference in columns, types, or values; returns the row count."""
    got = queries()[name](spark, directory)
    want = duck(directory).sql(oracle_sql()[name])
    types = {f.name: SPARK_TO_DUCK[f.dataType.simpleString()] for f in got.schema.fields}
    assert types == dict(zip(want.columns, map(str, want.types))), name
    spark_rows = canonical([tuple(r) for r in got.collect()], got.columns)
    duck_rows = canonical(want.fetchall(), want.columns)
    assert len(spark_rows) == len(duck_rows), (name, len(spark_rows), len(duck_rows))
    different = [(a, b) for a, b in zip(spark_rows, duck_rows) if repr(a) != repr(b)]
    assert not different, (name, len(different), different[:3])
    return len(spark_rows)
