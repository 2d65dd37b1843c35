"""Every registered query with SQL against DuckDB on the smallest tables; the others at least run."""

import math
import os

import duckdb
import pytest

from sparkloom.plans import registry


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{small}/{file}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, list | tuple) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return str([plain(v) for v in value])
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, oracle, name):
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:  # the operators have tests of their own
        assert rows and len({len(r) for r in rows}) == 1
        return
    result = oracle.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(rows) == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
