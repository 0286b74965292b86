"""All named queries with SQL against their SQL on the smallest test data; skipped where the data aren't there."""

import glob
import importlib
import os

import pytest

DATA = "/root/testdata/sf0.001"


def _names():
    import __spark_entry__ as entry

    return sorted({name for module in entry.PLANS for name in importlib.import_module(module).SQL})


NAMES = _names()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    sql = con.sql(entry.oracle_sql()[name])
    order = [sql.columns.index(c) for c in columns]
    theirs = sorted(map(repr, (tuple(r[i] for i in order) for r in sql.fetchall())))
    assert mine == theirs


def test_all_plans_import():
    import __spark_entry__ as entry

    assert len(entry.queries()) > 150 and set(entry.oracle_sql()) <= set(entry.queries())
