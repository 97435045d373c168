"""Distinctive terms and word frequencies."""

from collections import Counter

import numpy as np
import pytest

from recallgrid.llm.distinctive import fit_two_poisson, most_distinctive, term_weights
from recallgrid.llm.frequency import distinct_words, fold_word, word_frequencies
from recallgrid.llm.postings import valid_postings

POSTINGS = "tid long, nid long, tf double"


@pytest.fixture
def node_map(spark):
    # A clashing column that must not matter.
    return spark.createDataFrame([(i, f"n{i}", 1.0) for i in range(40)] + [(None, "x", 0.0)], "nid long, id string, tf double")


def test_valid_postings(spark, node_map):
    rows = [(1, 1, 2.0), (1, 1, 2.0), (1, 1, 3.0), (1, 2, None), (1, 3, float("nan")), (1, 4, 0.0), (1, 5, -1.0), (1, 99, 1.0), (None, 1, 1.0), (1, None, 1.0)]
    df = spark.createDataFrame(rows, POSTINGS).selectExpr("*", "'z' as id", "5 as n")
    assert [tuple(r) for r in valid_postings(df, node_map).collect()] == [(1, 1, 3.0)]
    assert valid_postings(df.limit(0), node_map).count() == 0
    assert valid_postings(df, node_map.limit(0)).count() == 0


def test_em_recovers_a_mixture():
    rng = np.random.default_rng(0)
    counts = np.where(rng.random(20_000) < 0.2, rng.poisson(8.0, 20_000), rng.poisson(1.0, 20_000))
    k, n = np.unique(counts[counts > 0], return_counts=True)
    two = np.concatenate([k, k]).astype(float), np.concatenate([n, n]).astype(float)
    share, elite, rest, mean, df = fit_two_poisson(*two, np.array([0, len(k)]), 20_000.0, rounds=400)
    assert share == pytest.approx([0.2, 0.2], abs=0.02) and elite == pytest.approx([8, 8], abs=0.3) and rest == pytest.approx([1, 1], abs=0.1)
    assert mean == pytest.approx([counts.mean()] * 2) and (df == (counts > 0).sum()).all()


def test_rare_repeated_term_leads(spark, node_map):
    rows = [(1, i, float(3 + i % 9)) for i in range(40)]  # everywhere, at any tf
    rows += [(2, i, 1.0) for i in range(20)] + [(3, 7, 5.0), (3, 8, 1.0)] + [(4, 7, 1.0)] + [(5, 9, 15.0), (1, 9, 15.0)]
    df = spark.createDataFrame(rows, POSTINGS)
    weights = term_weights(df, node_map)
    assert weights.count() == 40 + 20 + 2 + 1 + 1
    best = {r["nid"]: r["tid"] for r in most_distinctive(weights).collect()}
    assert best[7] == 3 and best[9] == 5
    probes = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, 77)], "probe_id long, nid long")
    assert {(r["nid"], r["tid"]) for r in most_distinctive(term_weights(df, node_map, probes)).collect()} == {(7, 3)}
    assert all(0 <= r["elite"] <= 1 and r["weight"] >= 0 for r in weights.collect())
    assert term_weights(df.limit(0), node_map).count() == 0 and term_weights(df, node_map.limit(0)).count() == 0


def test_ties_go_to_the_smaller_tid(spark, node_map):
    df = spark.createDataFrame([(9, 1, 2.0), (8, 1, 2.0)], POSTINGS)
    assert [r["tid"] for r in most_distinctive(term_weights(df, node_map)).collect()] == [8]


def test_words_fold(spark):
    assert fold_word(" Ｃafé ") == fold_word("CAFÉ") == "café"
    terms = spark.createDataFrame([(5, "Note"), (3, "ｎｏｔｅ "), (4, "other"), (6, None), (None, "note"), (7, "")], "tid long, term string").selectExpr("*", "1 as word")
    got = {r["tid"]: (r["word"], r["word_tid"]) for r in distinct_words(terms).collect()}
    assert got == {5: ("note", 3), 3: ("note", 3), 4: ("other", 4), 7: ("", 7)}


@pytest.mark.parametrize("bucket_rows", [20, 10**6])
def test_frequencies_match_brute_force(spark, node_map, bucket_rows):
    rng = np.random.default_rng(4)
    words = {t: f"w{t % 6}" for t in range(12)} | {20: "unused"}
    rows = [(int(t), int(n), float(f)) for t, n, f in zip(rng.integers(0, 14, 500), rng.integers(0, 45, 500), rng.integers(-1, 4, 500))]
    rows += [(0, n, 1.0) for n in range(40)] * 2
    terms = spark.createDataFrame([(t, w if t % 2 else w.upper()) for t, w in words.items()], "tid long, term string")
    best = {}
    for t, n, f in rows:
        if f > 0 and n < 40:
            best[t, n] = max(best.get((t, n), 0), f)
    nodes, postings, occurrences = {}, Counter(), Counter()
    for (t, n), f in best.items():
        if t in words:
            nodes.setdefault(words[t], set()).add(n)
            postings[words[t]] += 1
            occurrences[words[t]] += f
    got = {r["word"]: r for r in word_frequencies(spark.createDataFrame(rows, POSTINGS), terms, node_map, bucket_rows=bucket_rows).collect()}
    assert got.keys() == set(words.values())
    for w, r in got.items():
        n = len(nodes.get(w, ()))
        assert (r["n_nodes"], r["n_postings"], r["occurrences"]) == (n, postings[w], occurrences[w])
        assert r["mark"] == ("rare" if n < 3 else "common" if n > 0.3 * 41 else "")
        assert r["tid"] == min(t for t, x in words.items() if x == w)
    assert word_frequencies(spark.createDataFrame([], POSTINGS), terms, node_map).filter("n_nodes > 0").count() == 0
    assert word_frequencies(spark.createDataFrame(rows, POSTINGS), terms.limit(0), node_map).count() == 0
