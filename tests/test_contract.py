"""The driver's contract: every query runs, and agrees with its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
OWN = entry.catalogue.QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(rows):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["x", "y", "z", "r", "g", "b"] and out.count() > 0


@pytest.mark.parametrize("name", list(OWN))
def test_query(spark, duck, name):
    df = OWN[name](spark, SF)
    names = sorted(df.columns)
    got = norm(df.select(*names).collect())
    if name in entry.catalogue.SQL:
        made = duck.execute(entry.catalogue.SQL[name])
        cols = [d[0] for d in made.description]
        assert sorted(cols) == names
        order = [cols.index(c) for c in names]
        assert got == norm([r[k] for k in order] for r in made.fetchall())


def test_names_are_registered():
    assert set(OWN) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
