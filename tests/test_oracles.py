"""Every registered query of the library that has SQL, against DuckDB on the same tables."""

import os

import duckdb
import pytest

from tessera import registry

NAMES = sorted(registry.oracle_sql())


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return None if v is None else repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, sf, duck, name):
    found = registry.queries()[name](spark, sf)
    columns = sorted(found.columns)
    expected = duck.sql(registry.oracle_sql()[name])
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert rows == sorted((tuple(norm(r[i]) for i in at) for r in expected.fetchall()), key=repr)
