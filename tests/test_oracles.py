"""Every query with SQL gives the rows that DuckDB gives for it."""

import math
import os

import duckdb
import pytest

from basewatch import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return int(v) if isinstance(v, bool | int) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df, sql = catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    cols = sorted(df.columns)
    at = [sql.columns.index(c) for c in cols]
    mine = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    assert mine == sorted(([plain(r[i]) for i in at] for r in sql.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert all(list(r.asDict()) == df.columns for r in df.collect())
