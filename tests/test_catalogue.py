"""Every registered query outside the optional subpackage against its SQL on the smallest tables."""

import glob
import os

import pytest

from manualmill.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    if name not in catalogue.SQL:
        assert got
        return
    listed = ", ".join(f'"{c}"' for c in columns)
    want = sorted(str(list(r)) for r in duck.execute(f"SELECT {listed} FROM ({catalogue.SQL[name]})").fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
