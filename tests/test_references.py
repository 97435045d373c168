import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recallgrid.functions import bitmaps
from recallgrid.operators.references import ReferenceField, orphan_references, orphan_report

codes = st.lists(st.integers(0, 400_000), max_size=60)


@given(codes, codes, st.integers(0, 9000))
@settings(max_examples=60, deadline=None)
def test_bitmaps(a, b, run):
    a = np.array(a + list(range(run)), dtype=np.int64)
    b = np.array(b + list(range(run // 2)), dtype=np.int64)
    left = bitmaps.decode(bitmaps.and_not(bitmaps.build(a), bitmaps.build(b)))
    assert left.tolist() == sorted(set(a.tolist()) - set(b.tolist()))


JAN, FEB = 1704067200.0 + 3600, 1706745600.0 + 3600


@pytest.fixture
def parents(spark):
    return spark.createDataFrame([("p", 1.0), ("late", FEB), ("odd", None), (None, 1.0), ("p", 2.0)], "id string, indexed_at double").selectExpr("*", "1 as t", "2 as what")


@pytest.fixture
def removals(spark):
    return spark.createDataFrame([("gone",), ("gone",), ("p",), (None,)], "node_id string")


def test_states(spark, parents, removals):
    refs = spark.createDataFrame(
        [("p", JAN), ("late", JAN), ("late", FEB + 10), ("late", FEB - 10), ("gone", JAN), ("never", JAN), ("never", JAN), (None, JAN), ("odd", JAN), ("never", None), ("late", None), ("Never", FEB)],
        "src string, updated double",
    ).selectExpr("*", "'x' as id", "3 as month")
    found = orphan_references([ReferenceField("edges", "src", "updated", refs)], parents, removals)
    assert {tuple(r)[2:] for r in found.collect()} == {
        ("2024-01", "late", "later"), ("2024-02", "late", "later"), ("2024-01", "gone", "removed"), ("2024-01", "never", "never"), (None, "never", "never"), ("2024-02", "Never", "never"),
    }
    assert orphan_report(found).count() == 6


def test_many_ranges_and_empty(spark, parents, removals):
    refs = spark.createDataFrame([(f"x{i % 300}", JAN + (i % 3) * 40 * 86400) for i in range(2000)], "node_id string, ts double")
    whole = {tuple(r) for r in orphan_references([ReferenceField("f", "node_id", "ts", refs)], parents, removals).collect()}
    cut = {tuple(r) for r in orphan_references([ReferenceField("f", "node_id", "ts", refs)], parents, removals, range_rows=50).collect()}
    assert whole == cut and len(cut) == len({(i % 300, i % 3) for i in range(2000)})
    none = orphan_references([ReferenceField("f", "node_id", "ts", refs.limit(0))], parents.limit(0), removals.limit(0))
    assert none.count() == 0
