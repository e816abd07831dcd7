"""Every query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tarnflow.plans import more

SF = "/root/testdata/sf0.001"


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(round(r[k], 6)) if isinstance(r[k], float) else repr(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(more.SQL))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    r = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(got.columns)
    assert norm([tuple(x) for x in got.collect()], got.columns) == norm(r.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
