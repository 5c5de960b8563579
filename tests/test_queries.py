"""Every registered journal query on the smallest tables, compared with its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tracelake.jobs.all_queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the benchmark tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def plain(rows):
    one = lambda v: float(f"{float(v):.12g}") if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted(repr([one(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    if name in ORACLE_SQL:
        relation = duck.sql(ORACLE_SQL[name])
        assert sorted(relation.columns) == columns
        assert plain(rows) == plain(relation.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
