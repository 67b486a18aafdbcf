"""Each query against its SQL in DuckDB, on the same tables."""

import glob
import math
import os

import duckdb
import pytest
from evidentia.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(rows):
    clean = lambda v: round(v, 4) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rel = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = plain([[r[c] for c in columns] for r in df.collect()])
    want = plain(rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert got and got == want
