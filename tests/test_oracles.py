"""Every query with a DuckDB equivalent, over the smallest tables."""

import json
import os

import duckdb
import pytest

from barloom.plans import chain  # noqa: F401
from barloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows_of(names, rows):
    order = sorted(names)
    return sorted(json.dumps([r[names.index(c)] for c in order], default=str) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())
