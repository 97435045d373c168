"""Every query runs on the smallest tables, and agrees with its SQL."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CORE = [n for n in QUERIES if not (n.startswith("p") and n.split("_")[0][1:].isdigit()) or n.startswith(("p4_", "p5_"))]


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v if v is None or isinstance(v, (int, float, str, bool)) else str(v)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name in ORACLES:
        want = tables.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)


def test_entry_point(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
