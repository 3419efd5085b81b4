"""Each query against its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names, rows = table(df.columns, df.collect())
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    want_names, want = table([d[0] for d in result.description], result.fetchall())
    assert names == want_names
    assert len(rows) == len(want)
    for got, expected in zip(rows, want):
        assert got == expected
        assert [type(v) for v in got] == [type(v) for v in expected]
