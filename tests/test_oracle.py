"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import datetime
import decimal
import os

import pytest

import __spark_entry__ as entry
from loomwright.plans import queries as core

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return str(v)[:19]
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    r = db.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    theirs = sorted(repr([plain(x[names.index(c)]) for c in cols]) for x in r.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
