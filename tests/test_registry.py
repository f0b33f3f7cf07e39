"""Every registered query with SQL against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from marginalia import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, map(tuple, df.collect()))
    if name in registry.ORACLE:
        want = duck.execute(registry.ORACLE[name])
        assert sorted(df.columns) == sorted(c[0] for c in want.description)
        assert got == rows([c[0] for c in want.description], want.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
