"""The subpackage's queries on the smallest tables, against their SQL where there is some."""

import os

import pytest

from recallgrid.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": ["nid", "tid"], "p2_found": ["tid", "mark"], "p3_found": ["node_a", "node_b"], "p6_found": ["node_a", "node_b"],
    "p7_found": ["node_a", "node_b"], "p10_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows)
    if name in ("p3_found", "p6_found", "p7_found"):
        assert all(a < b for a, b in rows)
    if name in queries.ORACLES:
        want = tables.sql(queries.ORACLES[name])
        at = [want.columns.index(c) for c in df.columns]
        assert sorted(rows, key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
