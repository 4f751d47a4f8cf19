"""Every query with SQL equals DuckDB's answer on the smallest tables."""

import os

import duckdb
import pytest

from vecspan.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def plain(v):
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_names_are_known():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
