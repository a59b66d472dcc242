"""Every query with SQL against DuckDB on the smallest tables, and the rest for running at all."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in SQL:
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
