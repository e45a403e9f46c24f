"""Registered engine queries against DuckDB."""

import os

import duckdb
import pytest

from lumenq import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = engine.queries()[name](spark, SF)
    found = con.execute(engine.oracle_sql()[name])
    names = [c[0] for c in found.description]
    key = lambda rows, cols: sorted(repr([r[cols.index(c)] for c in sorted(cols)]) for r in rows)
    assert sorted(df.columns) == sorted(names)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(found.fetchall(), names)
