"""Every query of the engine against its SQL twin in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from hertzlake.plans.queries import QUERIES, SQL

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def database(folder):
    db = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else str(v)
    return sorted(tuple(plain(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, name):
    found = QUERIES[name](spark, folder)
    twin = database(folder).sql(SQL[name])
    assert sorted(found.columns) == sorted(twin.columns)
    kinds = dict(zip(twin.columns, map(str, twin.types)))
    assert {c: TYPES.get(k, k) for c, k in found.dtypes if k in TYPES} == {c: kinds[c] for c, k in found.dtypes if k in TYPES}
    assert rows_of(found.columns, map(tuple, found.collect())) == rows_of(twin.columns, twin.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
