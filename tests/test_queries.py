"""Every registered query of the engine against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

from factloom.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else v
    return sorted((tuple(show(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
