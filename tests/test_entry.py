"""Every registered query runs on the smallest tables; those with SQL agree with DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()


def norm(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "None"
        if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "as_tuple"):
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    if name not in ORACLE:
        assert df.columns
        return
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = con.execute(ORACLE[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    assert norm([tuple(r[c] for c in order) for r in rows]) == norm([tuple(r[cols.index(c)] for c in order) for r in got.fetchall()])
