"""Co-occurrence, similar sets and nearest vectors."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recallgrid.llm.cooccurrence import pair_associations
from recallgrid.llm.neighbours import nearest_neighbours
from recallgrid.llm.queries import plain_tag
from recallgrid.llm.similar_sets import expand_pairs, needed_overlap, similar_sets, t_occurrences


def brute_pairs(rows):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    single = Counter(i for s in baskets.values() for i in s)
    both = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return {p: (n, single[p[0]], single[p[1]], n * len(baskets) / (single[p[0]] * single[p[1]])) for p, n in both.items()}


@pytest.mark.parametrize("chunk_items", [3, 64])
def test_pairs_match_brute_force(spark, chunk_items):
    rng = np.random.default_rng(1)
    rows = [(f"q{b}", f"i{i}") for b, i in zip(rng.integers(0, 60, 400), rng.integers(0, 30, 400))] + [("huge", f"i{i}") for i in range(40)] * 2
    rows += [(None, "i1"), ("q1", None), ("single", "i2")]
    df = spark.createDataFrame(rows, "b string, i string").selectExpr("*", "'x' as item", "1 as n", "2 as basket")
    want = brute_pairs(rows)
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["lift"]) for r in pair_associations(df, "b", "i", chunk_items=chunk_items).collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
    few = {(r["item_a"], r["item_b"]) for r in pair_associations(df, "b", "i", min_count=3, min_lift=1.2, chunk_items=chunk_items).collect()}
    assert few == {p for p, v in want.items() if v[0] >= 3 and v[3] >= 1.2} and few
    assert pair_associations(df.limit(0), "b", "i").count() == 0


sorted_lists = st.lists(st.lists(st.integers(0, 25), unique=True, max_size=20).map(sorted), min_size=1, max_size=9)


@given(sorted_lists, st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_t_occurrences(lists, need):
    counts = Counter(x for one in lists for x in one)
    assert dict(t_occurrences(lists, need)) == {x: n for x, n in counts.items() if n >= need}


def test_needed_overlap():
    assert needed_overlap(10, 7, 0.7) == 7 and needed_overlap(4, 4, 0.7) == 4 and needed_overlap(10, 10, 0.7) == 9


def test_similar_sets_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [rng.choice(60, 9, replace=False).tolist() for _ in range(25)]
    rows = []
    for k, one in enumerate(base):
        for v in range(8):
            own = list(one[: 9 - v % 3]) + ([int(rng.integers(60))] if v % 2 else [])
            rows.append((f"n{k:02}{v}", [f" #T{x} " if v == 4 else f"t{x}" for x in own] + ([None, f"t{own[0]}"] if v == 5 else []) + ["everywhere"]))
    rows += [("none", None), ("empty", []), ("short", ["a", "b", "c"]), ("same", ["a", "A", "#a", " a "]), (None, ["a", "b", "c", "d"])]
    df = spark.createDataFrame(rows, "id string, tags array<string>").selectExpr("*", "1 as rep", "'x' as items", "2 as h")

    def plain(tags):
        return {t.strip(" ").removeprefix("#").lower() for t in tags or [] if t is not None}

    sets = {i: plain(t) for i, t in rows if i is not None and len(plain(t)) >= 4}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    members, pairs = similar_sets(df, "id", "tags", plain_tag)
    got = [(r["node_a"], r["node_b"]) for r in expand_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert members.count() == len(sets)
    from recallgrid.llm import similar_sets as module

    blocks = module.similar_representatives(module.set_classes(module.item_sets(df, "id", "tags", plain_tag, 4)), 0.7, block_rows=5)
    assert {(r["node_a"], r["node_b"]) for r in expand_pairs(members, blocks).collect()} == want
    members, pairs = similar_sets(df.limit(0), "id", "tags", plain_tag)
    assert expand_pairs(members, pairs).count() == 0


def brute_neighbours(vectors, k, least):
    ids = sorted(vectors)
    x = np.stack([vectors[i] for i in ids]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a and s[a, b] >= least), key=lambda b: (-s[a, b], ids[b]))[:k]
        out[i] = [ids[b] for b in order]
    return out


def planted(seed=3, n=500):
    rng = np.random.default_rng(seed)
    vectors = {f"v{i:04}": rng.standard_normal(64) for i in range(n)}
    for i in range(0, 150, 3):
        for j in range(1, 3):
            vectors[f"v{i + j:04}"] = vectors[f"v{i:04}"] + (0.25 + 0.05 * (i % 3)) * rng.standard_normal(64)
    return vectors


def test_recall_against_brute_force(spark):
    vectors = planted()
    rows = [(i, (v * (1 + k % 3)).tolist()) for k, (i, v) in enumerate(vectors.items())]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    want = {(i, j) for i, near in brute_neighbours(vectors, 5, 0.88).items() for j in near}
    got = {(r["id"], r["neighbour"]) for r in nearest_neighbours(df, "id", "vec", 64, 0.88, rows_per_cell=40).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 50
    cut = {(r["id"], r["neighbour"]) for r in nearest_neighbours(df, "id", "vec", 64, 0.88, rows_per_cell=40, max_cell_rows=60).collect()}
    assert cut == got


def test_copies_and_broken_vectors(spark):
    one, two = [1.0] * 64, [1.0] * 32 + [-1.0] * 32
    rows = [(f"c{i}", one) for i in range(9)] + [("d1", two), ("d2", two), ("far", [1.0, *[0.0] * 63])]
    rows += [("c0", one), ("zero", [0.0] * 64), ("nan", [float("nan"), *[1.0] * 63]), ("inf", [float("inf"), *[1.0] * 63]), ("old", [1.0] * 32), ("null", None), (None, one), ("hole", [None, *[1.0] * 63])]
    df = spark.createDataFrame(rows, "node_id string, vec array<double>").selectExpr("*", "64 as dim", "'x' as id", "'y' as rep")
    got = {}
    for r in nearest_neighbours(df, "node_id", "vec", 64, 0.88).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"], round(r["similarity"], 6)))
    names = [f"c{i}" for i in range(9)]
    assert got.keys() == {*names, "d1", "d2"}
    for c in names:
        assert sorted(got[c]) == [(k + 1, x, 1.0) for k, x in enumerate([x for x in names if x != c][:5])]
    assert got["d1"] == [(1, "d2", 1.0)] and got["d2"] == [(1, "d1", 1.0)]
    assert nearest_neighbours(df.limit(0), "node_id", "vec", 64, 0.88).count() == 0
    assert nearest_neighbours(df.filter("node_id = 'd1'"), "node_id", "vec", 64, 0.88).count() == 0


def test_small_group_shares_its_neighbours(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal(64)
    b = a + 0.2 * rng.standard_normal(64)
    df = spark.createDataFrame([("a1", a.tolist()), ("a2", a.tolist()), ("b", b.tolist())], "id string, vec array<double>")
    got = {(r["id"], r["neighbour"]) for r in nearest_neighbours(df, "id", "vec", 64, 0.88).collect()}
    assert got == {("a1", "a2"), ("a2", "a1"), ("a1", "b"), ("a2", "b"), ("b", "a1"), ("b", "a2")}


def test_dense_group_passes_on_only_the_nearest(spark):
    from recallgrid.llm.neighbours import cell_neighbours

    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    vectors = {f"g{i:03}": centre + 0.15 * rng.standard_normal(64) for i in range(300)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id string, vec array<double>")
    unit = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in vectors.items()], "id string, vec array<float>")
    assert cell_neighbours(unit, 0.88, 5, rows_per_cell=100).count() <= 300 * 5 * 5
    want = {(i, j) for i, near in brute_neighbours(vectors, 5, 0.88).items() for j in near}
    got = {(r["id"], r["neighbour"]) for r in nearest_neighbours(df, "id", "vec", 64, 0.88, rows_per_cell=100).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


@pytest.mark.parametrize("block_rows", [150, 25_000])
def test_every_vector_gets_its_neighbours(spark, block_rows, monkeypatch):
    from recallgrid.llm import neighbours as module

    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16))
    vectors = {f"v{i}": [float(np.float32(c)) for c in v] for i, v in enumerate(x)}
    rows = list(vectors.items()) + [(f"copy{i}", vectors["v7"]) for i in range(2)] + [("none", None)]
    vectors |= {f"copy{i}": vectors["v7"] for i in range(2)}
    df = spark.createDataFrame(rows, "id string, v array<float>")
    monkeypatch.setattr(module, "MOST_WAITING", 1_000)
    got = {}
    for r in nearest_neighbours(df, "id", "v", 16, None, k=5, block_rows=block_rows).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute_neighbours(vectors, 5, -1.0)
