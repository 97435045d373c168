import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallgrid.config import Config, read_dotenv
from recallgrid.functions.perturb import head_only, longest_word, mistyped, swapped_particle, translated, unspaced
from recallgrid.operators import dense, distill, fusion, graph, hygiene, joins, learning, lexical, metrics, ranker
from recallgrid.operators.features import effective_trust
from recallgrid.session import numbered
from recallgrid.sources import notes, store


def test_bm25_prefers_the_rarer_term(spark):
    docs = spark.createDataFrame([("a", "alpha beta", ""), ("b", "alpha gamma", ""), ("c", "alpha", ""), ("d", None, ""), ("e", "", None)], "node_id string, body string, title string")
    index = lexical.postings(docs)
    assert {r["node_id"] for r in index.collect()} == {"a", "b", "c"}
    terms = lexical.query_terms(spark.createDataFrame([("q", "alpha beta"), ("none", "zzz"), ("null", None)], "qid string, text string"))
    best = fusion.top_k(lexical.bm25(terms, index, 3, 2.0), 2).collect()
    assert best[0]["node_id"] == "a" and {r["qid"] for r in best} == {"q"}


def test_title_boost(spark):
    docs = spark.createDataFrame([("a", "alpha\nalpha beta", "alpha")], "node_id string, body string, title string")
    tf = {r["term"]: r["tf"] for r in lexical.postings(docs).collect()}
    assert tf["alpha"] == pytest.approx(1 + math.log(2) + 1) and tf["beta"] == 1.0


def test_rrf_starts_at_rank_zero(spark):
    one = spark.createDataFrame([("q", "a", 0), ("q", "b", 1)], "qid string, node_id string, rank int")
    got = {r["node_id"]: r["rrf"] for r in fusion.reciprocal_rank_fusion([one, one.filter("rank = 0")]).collect()}
    assert got == {"a": pytest.approx(2 / 60), "b": pytest.approx(1 / 61)}
    assert fusion.top_k(one.withColumn("score", F.lit(1.0)).drop("rank"), 0).count() == 0


def test_exploration_swaps_the_last_place(spark):
    rows = spark.createDataFrame([(f"q{q}", f"n{i}", float(-i)) for q in range(200) for i in range(6)] + [("few", "n0", 1.0)], "qid string, node_id string, score double")
    got = {}
    for r in fusion.explore(rows, 3, 0.3, seed=5).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["node_id"]
    assert got.pop("few") == {0: "n0"} and len(got) == 200
    assert all(len(g) == 3 and g[0] == "n0" and g[1] == "n1" for g in got.values())
    swapped = [g[2] for g in got.values() if g[2] != "n2"]
    assert 30 <= len(swapped) <= 90 and set(swapped) == {"n3", "n4", "n5"}
    assert {tuple(r) for r in fusion.explore(rows, 3, 0.0, seed=5).collect()} == {tuple(r) for r in fusion.top_k(rows, 3).collect()}


def test_bm25_kernels_agree(spark):
    rng = np.random.default_rng(6)
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(f"w{x}" for x in rng.zipf(1.4, 30) % 60), "") for i in range(150)], "node_id string, body string, title string")
    index = lexical.postings(docs)
    terms = lexical.query_terms(spark.createDataFrame([(f"q{i}", " ".join(f"w{x}" for x in rng.integers(0, 60, 6))) for i in range(20)] + [("none", "zz")], "qid string, text string"))
    full = lexical.bm25(terms, index, 150, 30.0)
    want = {(r["qid"], r["rank"]): (r["node_id"], round(r["score"], 9)) for r in fusion.top_k(full, 7).collect()}
    df = lexical.document_frequency(terms, index)
    got = {(r["qid"], r["rank"]): (r["node_id"], round(r["score"], 9)) for r in lexical.bm25_top_k(terms, index, df, 150, 30.0, 7).collect()}
    assert got == want
    pairs = full.select("qid", "node_id").limit(40)
    some = {(r["qid"], r["node_id"]): r["score"] for r in lexical.bm25_of(pairs, terms, index, df, 150, 30.0).collect()}
    whole = {(r["qid"], r["node_id"]): r["score"] for r in full.collect()}
    assert all(some[k] == pytest.approx(whole[k]) for k in some) and len(some) == 40


def test_limited_walks_give_the_same_expansion(spark):
    rng = np.random.default_rng(4)
    rows = [(f"n{a}", f"n{b}", int(t), 1.0, 0.0) for a, b, t in zip(rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.integers(0, 4, 200))]
    adj = graph.adjacency(graph.latest_edges(spark.createDataFrame(rows, "src string, dst string, etype int, w double, updated double")), 0.0)
    seeds = spark.createDataFrame([(f"q{i}", f"n{(i * 7 + j) % 60}", 1.0 + j) for i in range(8) for j in range(3)], "qid string, node_id string, score double")
    whole, few = graph.pagerank(adj, seeds, tolerance=None), graph.pagerank(adj, seeds, tolerance=None, others=5)
    assert {tuple(r)[:2] for r in graph.expansion(whole, seeds, 5).collect()} == {tuple(r)[:2] for r in graph.expansion(few, seeds, 5).collect()}
    assert few.count() < whole.count()


def test_mutual_link_counts_once(spark):
    edges = spark.createDataFrame([("A", "B", 0, 1.0, 0.0), ("B", "A", 0, 1.0, 0.0), ("A", "C", 1, 0.0, 0.0)], "src string, dst string, etype int, w double, updated double")
    assert {tuple(r) for r in graph.adjacency(edges, 0.0).collect()} == {(0, "A", "B", 1.0), (0, "B", "A", 1.0)}


def test_walks_agree_and_keep_mass(spark):
    rng = np.random.default_rng(3)
    rows = [(f"n{a}", f"n{b}", int(t), float(w), 0.0) for a, b, t, w in zip(rng.integers(0, 30, 80), rng.integers(0, 40, 80), rng.integers(0, 4, 80), rng.random(80))]
    adj = graph.adjacency(graph.latest_edges(spark.createDataFrame(rows, "src string, dst string, etype int, w double, updated double")), 0.0)
    seeds = spark.createDataFrame([("q", "n1", 2.0), ("q", "n2", 1.0), ("p", "alone", 1.0), ("p", "n39", 1.0)], "qid string, node_id string, score double")
    near = {(r["qid"], r["etype"], r["node_id"]): r["score"] for r in graph.pagerank(adj, seeds, tolerance=None).collect()}
    far = {(r["qid"], r["etype"], r["node_id"]): r["score"] for r in graph.pagerank(adj, seeds, tolerance=None, local_edges=0).collect()}
    assert near.keys() == far.keys() and all(abs(near[k] - far[k]) < 1e-12 for k in near)
    scores = lambda rows: {(r["qid"], r["etype"], r["node_id"]): round(r["score"], 9) for r in rows.collect()}
    for few in (None, 3):
        stopped = scores(graph.pagerank(adj, seeds, tolerance=1e-3, others=few))
        assert stopped == scores(graph.pagerank(adj, seeds, tolerance=1e-3, others=few, local_edges=0)) and stopped
    assert stopped != {k: round(near[k], 9) for k in stopped}
    for key in {k[:2] for k in near}:
        assert sum(v for k, v in near.items() if k[:2] == key) == pytest.approx(1.0)


def test_tag_edges_match_a_loop(spark):
    rng = np.random.default_rng(5)
    tags = [sorted({f"t{x}" for x in rng.integers(0, 12, 3)} | ({"meta"} if rng.random() < 0.9 else set())) for _ in range(120)]
    members, want = {}, set()
    for seq, own in enumerate(tags):
        best = {}
        for tag in own:
            there = members.get(tag, [])
            if 2 <= len(there) <= max(40, int(max(1, seq) * 0.3)):
                for m in there[-6:]:
                    best[m] = max(best.get(m, 0), 0.5 * math.log(1 + max(1, seq) / len(there)))
        want |= {(seq, m, round(w, 6)) for m, w in sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:12]}
        for tag in own:
            members.setdefault(tag, []).append(seq)
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(tags)], "seq long, node_id long, tags array<string>")
    for chunk_rows in (7, 10**6):
        assert {(r["src"], r["dst"], round(r["w"], 6)) for r in graph.tag_edges(rows, chunk_rows=chunk_rows).collect()} == want


def test_knn_edges_match_brute_force(spark):
    x = np.random.default_rng(1).standard_normal((90, 8))
    df = spark.createDataFrame([(i, f"n{i:03}", v.tolist()) for i, v in enumerate(x)], "seq long, node_id string, vec array<double>")
    got = {(r["src"], r["dst"]) for r in dense.knn_edges(df, k=3, min_similarity=0.1, window=20).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(90):
        before = sorted(range(max(0, i - 20), i), key=lambda j: -(u[i] @ u[j]))[:3]
        want |= {(f"n{i:03}", f"n{j:03}") for j in before if u[i] @ u[j] >= 0.1}
    assert got == want


def test_cosine_top_k(spark):
    x = np.random.default_rng(2).standard_normal((50, 6))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, vec array<double>")
    got = [r["node_id"] for r in dense.cosine_top_k(vectors.limit(1).withColumnRenamed("node_id", "qid"), vectors, 5).orderBy("rank").collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == np.argsort(-(u @ u[0]))[:5].tolist()
    assert dense.cosine_top_k(vectors.limit(0).withColumnRenamed("node_id", "qid"), vectors, 5).count() == 0


def test_embedding(spark):
    table = dense.initial_table(256, 16)
    assert np.linalg.norm(dense.embed_text("오일 저장 탱크", table)) == pytest.approx(1.0, abs=1e-5)
    assert not dense.embed_text("", table).any()
    assert dense.embed_text("데이터베이스", table) @ dense.embed_text("데이타베이스", table) > dense.embed_text("데이터베이스", table) @ dense.embed_text("고양이", table)


def trust_by_hand(events):
    trust, at = 0.5, 0.0
    for ts, helpful in events:
        if trust != 0.5 and at > 0:
            trust = 0.5 + (trust - 0.5) * 0.5 ** (max(0, ts - at) / 86400 / 45)
        trust, at = min(1, max(0, trust + (0.05 if helpful else -0.1))), ts
    return trust, at


def test_trust_fold(spark):
    rng = np.random.default_rng(8)
    logs = {f"n{i}": sorted((float(t), bool(h)) for t, h in zip(1e9 + rng.random(40) * 3e7, rng.random(40) < 0.2 * i)) for i in range(6)}
    rows = [(n, ts, h, i) for n, log in logs.items() for i, (ts, h) in enumerate(log)] + [(None, 1.0, True, 0), ("x", None, True, 0), ("x", 1.0, None, 0)]
    df = spark.createDataFrame(rows, "node_id string, ts double, helpful boolean, rid long")
    got = {r["node_id"]: (r["trust"], r["trust_updated"]) for r in learning.trust_fold(df).collect()}
    assert got.keys() == logs.keys()
    for n, log in logs.items():
        assert got[n] == pytest.approx(trust_by_hand(log), abs=1e-9)
    half = learning.trust_fold(df.filter("ts < 1.015e9"))
    rest = {r["node_id"]: r["trust"] for r in learning.trust_fold(df.filter("ts >= 1.015e9"), stored=half).collect()}
    assert all(rest[n] == pytest.approx(got[n][0], abs=1e-9) for n in logs)


def test_trust_decays_towards_neutral(spark):
    events = spark.createDataFrame([("a", 1e9, True, i) for i in range(8)], "node_id string, ts double, helpful boolean, rid long")
    row = learning.trust_fold(events).withColumn("later", effective_trust(F.col("trust"), F.col("trust_updated"), 1e9 + 90 * 86400)).first()
    assert row["trust"] > 0.85 and 0.55 < row["later"] < 0.65


def test_coaccess(spark):
    week = 7 * 86400.0
    rows = [("q1", "a", 0.0), ("q1", "b", 5.0), ("q1", "b", 9.0), ("q2", "a", 6 * week), ("q2", "b", 6 * week), ("q3", "a", 1.0), (None, "a", 1.0)]
    df = spark.createDataFrame(rows, "query string, node_id string, ts double")
    got = {(r["src"], r["dst"]): (r["w"], r["updated"]) for r in learning.coaccess_edges(df).collect()}
    w = 0.3 * 0.9**6
    assert got == {p: (pytest.approx(w + 0.3 * (1 - w)), 6 * week) for p in (("a", "b"), ("b", "a"))}
    first = learning.coaccess_edges(df.filter("query <> 'q2'"))
    assert learning.coaccess_edges(df.filter("query = 'q2'"), stored=first).first()["w"] == pytest.approx(w + 0.3 * (1 - w))
    many = spark.createDataFrame([("q", f"n{i}", 1.0) for i in range(30)], "query string, node_id string, ts double")
    assert learning.coaccess_edges(many, block_items=4).count() == 30 * 29


def test_gate(spark):
    rows = spark.createDataFrame([(1000, 100, 0), (1000, 55, 45), (50, 100, 0), (1000, 10, 0)], "e long, w long, l long")
    assert [round(r[0], 3) for r in rows.select(ranker.blend_share(F.col("e"), F.col("w"), F.col("l"))).collect()] == [0.7, 0.0, 0.0, 0.0]


def test_learner_opens_on_signal_not_on_noise(spark):
    rng = np.random.default_rng(0)

    def log(signal):
        rows = []
        for q in range(400):
            x = rng.standard_normal((4, 14))
            used = x[:, 13].argmax() if signal else rng.integers(4)
            rows += [(q * 4 + i, float(q), f"{rng.integers(16**8):015x}"[-15:] + f"{q % 16:x}", x[i].tolist(), bool(i == used)) for i in range(4)]
        rows = [(a, b, f"{q:015x}{q % 16:x}", x, u) for (a, b, _, x, u), q in zip(rows, [r[0] // 4 for r in rows])]
        return spark.createDataFrame(rows, "rid long, ts double, query_hash string, features array<float>, used boolean")

    for signal in (True, False):
        events = log(signal)
        row = ranker.gate(events, ranker.train_on_log(events)).first()
        assert (row["share"] > 0) == signal
    assert ranker.gate(log(False).limit(0), ranker.train_on_log(log(False).limit(0))).first()["share"] == 0.0
    assert ranker.train_on_log(log(True), shard_rows=300).events > 0


def test_joins(spark):
    rels = spark.createDataFrame([("x", "a", 2.0), ("x", "b", 1.0), ("y", "a", 1.0), ("y", "c", 4.0)], "entity string, node_id string, score double")
    scaled = joins.relatedness(rels)
    assert {tuple(r) for r in joins.related_to_all(scaled, 2).collect()} == {("a", 0.25)}
    assert {tuple(r) for r in joins.related_to_any(scaled, 2).collect()} == {("a", 0.625), ("b", 0.25), ("c", 0.5)}


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "c", 2)], "qid string, node_id string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "z"), ("r", "b")], "qid string, node_id string")
    got = {r["qid"]: r for r in metrics.retrieval_metrics(ranked, gold).collect()}
    assert got["q"]["mrr"] == 0.5 and got["q"]["r1"] == 0.0 and got["q"]["r5"] == 1.0
    assert got["q"]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got["r"]["ndcg"] == 0.0


def test_distill_improves_on_clusters():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((4, 16))
    texts = [f"topic{i % 4} word{i % 4}a item {i}" for i in range(120)]
    teachers = np.stack([centres[i % 4] + 0.05 * rng.standard_normal(16) for i in range(120)])
    fit = distill.fit_table(texts, teachers, dense.initial_table(512, 16), epochs=30, rate=0.01)
    assert fit.trained and fit.after > fit.before and fit.accepted
    assert not distill.fit_table(texts[:10], teachers[:10], dense.initial_table(64, 8)).trained


def test_perturbations(spark):
    q = F.col("q")
    df = spark.createDataFrame([("서버를 다시 켜는 방법",), ("one",), (None,), ("",)], "q string")
    rows = df.select(unspaced(q), longest_word(q), translated(q), head_only(q), swapped_particle(q), mistyped(q)).collect()
    assert rows[0][0] == "서버를다시켜는방법" and rows[0][1] == "서버를" and rows[0][2].startswith("server") and rows[0][3] == "서버를 다시"
    assert rows[0][4] in {"서버을 다시 켜는 방법"} and rows[0][5] not in (None, "서버를 다시 켜는 방법")
    assert all(v is None for v in rows[1]) and all(v is None for v in rows[2])


def test_notes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n1.md").write_text('---\ntitle: "Hello"\ntags: [a, 한글]\n---\nSee [[x|y]] and [[ z ]].\n', encoding="utf-8")
    (tmp_path / "n2.md").write_text("plain", encoding="utf-8")
    got = {r["node_id"]: r for r in notes.read_notes(spark, str(tmp_path)).collect()}
    assert got["n1"]["title"] == "Hello" and got["n1"]["tags"] == ["a", "한글"] and got["n1"]["links"] == ["x", "z"] and got["n1"]["text"] == "See [[x|y]] and [[ z ]]."
    assert got["n2"]["title"] == "n2" and got["n2"]["text"] == "plain"


def test_config(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nexport RECALLGRID_DIM=64\nRECALLGRID_JAMO_NGRAMS='2,4'\n", encoding="utf-8")
    monkeypatch.setenv("RECALLGRID_TOP_K", "3")
    c = Config.from_env(str(tmp_path / ".env"), epsilon=0.5)
    assert (c.dim, c.jamo_ngrams, c.top_k, c.epsilon) == (64, (2, 4), 3, 0.5)
    assert read_dotenv(str(tmp_path / "none")) == {}
    for bad in ({"dim": 0}, {"vocab_size": 1}, {"hidden": 0}, {"lr": float("inf")}, {"lr": 0.0}, {"l2": float("nan")}, {"top_k": 0}, {"epsilon": 2}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_store_commits(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "node_id string, body string")
    assert s.commit({"texts": rows}) == 1
    assert s.commit({"texts": s.upsert("texts", rows.filter("node_id = 'a'").selectExpr("node_id", "'new' as body"))}) == 2
    assert {tuple(r) for r in s.read("texts").collect()} == {("a", "new"), ("b", "y")}
    assert {tuple(r) for r in s.read("texts", 1).collect()} == {("a", "x"), ("b", "y")}
    with pytest.raises(store.ConflictError):
        s.commit({"texts": rows}, base=1)
    assert s.vacuum() == 0 and s.vacuum(older_than=0.0) >= 1 and s.read("texts").count() == 2 and s.read("edges").count() == 0


def test_store_changes(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    text = lambda rows: spark.createDataFrame(rows, "node_id string, body string")
    s.commit({"texts": text([(f"n{i}", "old") for i in range(20)])})
    want = {f"n{i}": "old" for i in range(20)}
    for i in range(12):
        s.commit({}, None, [("texts", "gone", text([(f"n{i + 5}", "")])), ("texts", "upsert", text([(f"n{i}", f"new{i}"), (f"x{i}", "more")]))])
        want.pop(f"n{i + 5}", None)
        want |= {f"n{i}": f"new{i}", f"x{i}": "more"}
        assert len(s._manifest(s.version())["texts"]) <= s.MOST_CHANGES + 1
    assert dict(map(tuple, s.read("texts").collect())) == want
    edge = "src string, dst string, etype int, w double, updated double"
    s.commit({"edges": spark.createDataFrame([("a", "b", 0, 1.0, 0.0), ("a", "b", 3, 1.0, 0.0), ("c", "a", 0, 1.0, 0.0), ("c", "d", 1, 1.0, 0.0)], edge)})
    one = text([("a", "")])
    s.commit({}, None, [("edges", "unlinked", one)])
    assert {tuple(r)[:3] for r in s.read("edges").collect()} == {("a", "b", 3), ("c", "a", 0), ("c", "d", 1)}
    s.commit({}, None, [("edges", "gone", one)])
    assert {tuple(r)[:3] for r in s.read("edges").collect()} == {("c", "d", 1)}
    s.set_param("k", "v")
    s.set_param("l", "w")
    assert s.param("k") == "v" and s.set_param("k", None) and s.param("k") is None and s.param("l") == "w"


def test_a_dead_writer_blocks_nobody_for_long(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", "x")], "node_id string, body string")
    s.commit({"texts": rows})
    # A claim without a manifest: its writer is at work, or died.
    (tmp_path / "s" / "_manifests" / f"{2:012d}.claim").write_text("")
    with pytest.raises(store.ConflictError):
        s.commit({"texts": rows.limit(0)})
    assert s.version() == 1 and s.read("texts").count() == 1
    s.CLAIM_SECONDS = -1.0
    assert s.commit({"texts": rows.limit(0)}) == 2 and s.read("texts").count() == 0


def test_concurrent_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    s = store.Store(spark, str(tmp_path / "s"))
    rows = [spark.createDataFrame([(f"w{i}", "x")], "node_id string, body string") for i in range(4)]

    def write(i):
        try:
            return s.commit({"texts": rows[i]}, base=0)
        except store.ConflictError:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, range(4)))
    assert sorted(x for x in done if x) == [1] and s.read("texts").count() == 1


def test_ring_and_dictionary(spark):
    log = spark.createDataFrame([(i,) for i in range(10)], "rid long")
    kept = store.append_capped(log, spark.createDataFrame([(10,)], "rid long"), 3)
    assert sorted(r["rid"] for r in kept.collect()) == [8, 9, 10]
    terms = spark.createDataFrame([(1, "t"), (2, "u")], "tid long, term string")
    ids = spark.createDataFrame([(7, "n")], "nid long, id string")
    spelled = spark.createDataFrame([("t", "n", 1.5)], "term string, node_id string, tf double")
    numbers = store.intern_terms(spelled, terms, ids)
    assert tuple(numbers.first()) == (1, 7, 1.5) and tuple(store.spell_postings(numbers, terms, ids).first()) == ("t", "n", 1.5)


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x long")
    assert all(r["x"] == r["seq"] for r in numbered(df, "x").collect())


def test_long_texts_count_whole(spark):
    body = " ".join(f"word{i % 700}" for i in range(6_000)) + " lastly"
    docs = spark.createDataFrame([("long", body, ""), ("huge", "ab " * 200_000 + "tail", "")], "node_id string, body string, title string")
    rows = {(r["node_id"], r["term"]): r for r in lexical.postings(docs, title_boost=1.0).collect()}
    assert rows["long", "word5"]["n"] == 9 and rows["long", "lastly"]["n"] == 1 and rows["huge", "tail"]["n"] == 1
    assert rows["huge", "ab"]["n"] == 200_000 and rows["huge", "ab"]["doc_len"] == 200_003
    asked = spark.createDataFrame([("q", body)], "qid string, text string")
    assert lexical.query_terms(asked).filter("term = 'lastly'").count() == 1
    table = dense.initial_table(256, 16)
    assert not np.allclose(dense.embed_text(body, table), dense.embed_text(body.replace("lastly", "zebra giraffe"), table), atol=1e-7)


@pytest.mark.parametrize("since", [None, 4_400])
def test_knn_edges_reach_all_earlier_rows(spark, since, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4_500, 8)).astype(np.float32)
    x[4_450], x[4_499] = x[3], x[3]
    df = spark.createDataFrame([(i, f"n{i}", v.tolist()) for i, v in enumerate(x)], "seq long, node_id string, vec array<float>")
    got = {}
    for r in dense.knn_edges(df, k=3, min_similarity=0.1, since=since).filter("int(substr(src, 2)) >= 4400").orderBy("src", F.desc("w")).collect():
        got.setdefault(int(r["src"][1:]), set()).add(int(r["dst"][1:]))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert got == {i: set(np.argsort(-np.round(u[:i] @ u[i], 12), kind="stable")[:3].tolist()) for i in range(4_400, 4_500)}
    assert {3, 4_450} <= got[4_499] and dense.knn_edges(df.limit(0)).count() == 0


def test_batches_of_queries_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    asked = [(f"q{i}", rng.standard_normal(8).tolist()) for i in range(70)]
    v, q = spark.createDataFrame(vectors, "node_id long, vec array<double>"), spark.createDataFrame(asked, "qid string, vec array<double>")
    rows = lambda df: {tuple(r)[:2] + (round(r["score"], 9), r["rank"]) for r in df.collect()}
    whole = rows(dense.cosine_top_k(q, v, 4))
    assert len(whole) == 280
    monkeypatch.setattr(dense, "MAX_QUERIES", 16)
    assert rows(dense.cosine_top_k(q, v, 4)) == whole
    index = spark.createDataFrame([(f"t{t}", d, float(1 + (t + d) % 3), 10 + d % 5) for d in range(400) for t in {d % 7, d % 11, 12}], "term string, node_id long, tf double, doc_len int")
    terms = spark.createDataFrame([(f"q{i}", f"t{t}", 1.0) for i in range(60) for t in {i % 7, i % 13, 12}], "qid string, term string, weight double")
    df = lexical.document_frequency(terms, index)
    best = rows(lexical.bm25_top_k(terms, index, df, 400, 12.0, 5))
    assert best == rows(fusion.top_k(lexical.bm25(terms, index, 400, 12.0), 5)) and len(best) == 300
    monkeypatch.setattr(lexical, "MOST_BROADCAST_TERMS", 40)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 32)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 7)
    assert rows(lexical.bm25_top_k(terms, index, df, 400, 12.0, 5)) == best


def test_overlapping_sets_need_no_shuffle_and_agree_with_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    sets = {f"n{i}": (rng.sample([f"w{min(j, rng.randrange(60))}" for j in range(60)], rng.randrange(0, 30)), rng.random() < 0.3) for i in range(80)}
    sets = {i: (list(dict.fromkeys(w)), neg) for i, (w, neg) in sets.items()}
    sets["n80"], sets["n81"] = sets["n7"], (sets["n7"][0], not sets["n7"][1])
    rows = spark.createDataFrame([(i, w, neg) for i, (w, neg) in sets.items()], "other_id string, words array<string>, negated boolean").repartition(3)
    asked = rows.filter("substr(other_id, 3) in ('', '0', '1', '7')").withColumnRenamed("other_id", "node_id")
    ids = [r["node_id"] for r in asked.collect()]
    for blocks, common, words in ((7, 8, 10_000), (1024, 0, 60)):
        monkeypatch.setattr(hygiene, "BLOCK_SETS", blocks)
        monkeypatch.setattr(hygiene, "MOST_COMMON_WORDS", common)
        monkeypatch.setattr(hygiene, "MOST_ASKED_WORDS", words)
        want = {}
        for a in ids:
            for b in sets:
                x, y = set(sets[a][0]), set(sets[b][0])
                if a != b and x & y and len(x & y) / len(x | y) >= 0.2 - 1e-9:
                    want[a, b] = (len(x & y), len(x), len(y))
        found = hygiene.overlapping(asked, rows, 0.2)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r["node_id"], r["other_id"]): (r["shared"], r["n"], r["m"]) for r in found.collect()} == want
        scores = {}
        for (a, b), (c, n, m) in want.items():
            s = c / (n + m - c) * (max(0.0, 1 - c / (float(n) * m) ** 0.5) + (0.5 if sets[a][1] != sets[b][1] else 0.0))
            if s >= 0.3:
                scores.setdefault(a, []).append((-s, b))
        some = hygiene.overlapping(asked, rows, 0.2, best=(3, 0.3))
        top = hygiene.contradictions(some.withColumn("cosine", F.col("shared") / F.sqrt(F.col("n").cast("double") * F.col("m"))), 3, 0.3)
        assert {(r["node_id"], r["other_id"]) for r in top.collect()} == {(a, b) for a, x in scores.items() for _, b in sorted(x)[:3]}


@pytest.mark.parametrize("near, types", [(1.0, 4), (0.02, 4), (-1.0, 4), (1.0, 2)])
def test_walks_by_reach_and_by_blocks_agree_with_all_edges(spark, monkeypatch, near, types):
    rng = random.Random(11)
    monkeypatch.setattr(graph, "NEAR_SHARE", near)
    monkeypatch.setattr(graph, "HUB_EDGES", 6)
    monkeypatch.setattr(graph, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(graph, "GROUP_ROWS", 3)
    edges = {(t, f"n{rng.randrange(150):03}", f"n{0 if rng.random() < 0.1 else rng.randrange(150):03}") for t in range(types) for _ in range(150 + 100 * t)}
    out = {}
    for t, s, d in edges:
        out.setdefault((t, s), []).append(d)
    adj = spark.createDataFrame([(t, s, d, 1 / len(out[t, s])) for t, s, d in edges], "etype int, src string, dst string, p double")
    seeds = {q: {f"{'n' if rng.random() < 0.9 else 'x'}{rng.randrange(170):03}": rng.random() for _ in range(4)} for q in range(6)}
    asked = spark.createDataFrame([(q, n, s) for q, ns in seeds.items() for n, s in ns.items()], "qid long, node_id string, score double")
    for tolerance in (None, 0.02):
        want = {}
        for q, ns in seeds.items():
            v = {n: s / sum(ns.values()) for n, s in ns.items()}
            for t in range(types):
                mass = dict(v)
                for _ in range(20):
                    new = {n: 0.5 * s for n, s in v.items()}
                    for n, m in mass.items():
                        for d in out.get((t, n), []):
                            new[d] = new.get(d, 0.0) + 0.5 * m / len(out[t, n])
                        if (t, n) not in out:
                            for d, s in v.items():
                                new[d] += 0.5 * m * s
                    gap = sum(abs(new.get(n, 0.0) - mass.get(n, 0.0)) for n in {*new, *mass})
                    mass = new
                    if tolerance is not None and gap < tolerance:
                        break
                want |= {(q, t, n): m for n, m in mass.items()}
        got = {(r["qid"], r["etype"], r["node_id"]): r["score"] for r in graph.pagerank(adj, asked, tolerance=tolerance).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        few = {(r["qid"], r["etype"], r["node_id"]): r["score"] for r in graph.pagerank(adj, asked, tolerance=tolerance, others=5, digits=4).collect()}
        for q, ns in seeds.items():
            most = {}
            for (k, _, n), m in want.items():
                if k == q and n not in ns:
                    most[n] = max(most.get(n, 0.0), m)
            kept = {*sorted(most, key=lambda n: (-round(most[n], 9), n))[:5], *ns}
            assert {k for k in few if k[0] == q} == {k for k in want if k[0] == q and k[2] in kept}
        assert all(abs(few[k] - want[k]) <= 0.5001e-4 for k in few)


def test_graphs_are_counted_by_type_before_they_are_walked_by_joins(spark, monkeypatch):
    rows = [(t, f"n{i}", f"n{i + 1}", 1.0) for t in (0, 1) for i in range(3)]
    adj = spark.createDataFrame(rows, "etype int, src string, dst string, p double")
    seeds = spark.createDataFrame([(1, "n0", 1.0)], "qid long, node_id string, score double")
    monkeypatch.setattr(graph, "pagerank_loop", None)
    assert graph.pagerank(adj, seeds, tolerance=None, local_edges=3).count() == 8


def test_walks_move_masses_in_the_core_only(monkeypatch):
    monkeypatch.setattr(graph, "HUB_EDGES", 6)
    monkeypatch.setattr(graph, "ROWS_AT_ONCE", 7)
    rng = np.random.default_rng(9)
    for both, equal in ((True, True), (True, False), (False, True), (False, False)):
        a, b = rng.integers(0, 120, 110), np.where(rng.random(110) < 0.2, 0, rng.integers(0, 120, 110))
        pairs = np.unique(np.concatenate([a * 120 + b, b * 120 + a] if both else [a * 120 + b]))
        _, ends = np.unique(np.concatenate([pairs // 120, pairs % 120]), return_inverse=True)
        src, dst, size = ends[: len(pairs)], ends[len(pairs) :], ends.max() + 1
        w = np.ones(len(src)) if equal else rng.random(len(src))
        w = 0.5 * w / np.bincount(src, weights=w)[src]
        starts = np.searchsorted(src, np.arange(size + 1))
        homes = [np.unique(rng.integers(0, size, 12)) for _ in range(5)]
        restarts = [np.full(len(h), 0.8 / len(h)) for h in homes]
        wide = graph._Wide(starts, dst, w)
        assert wide.n < 0.8 * size
        for rounds in (1, 2, 19, 20):
            x, back = wide.walk(homes, restarts, np.full(5, 0.2), 0.5, rounds, None)
            for j, (h, v) in enumerate(zip(homes, restarts)):
                mass, alone = np.bincount(h, weights=v, minlength=size), 1.0
                for _ in range(rounds):
                    again = 0.5 + 0.5 * (mass[np.diff(starts) == 0].sum() + 0.2 * alone)
                    mass = np.bincount(dst, weights=mass[src] * w, minlength=size) + again * np.bincount(h, weights=v, minlength=size)
                    alone = again
                assert np.abs(x[wide.row, j] - mass).max() < 1e-14 and abs(back[j] - alone) < 1e-14


@pytest.mark.parametrize("both, hubs", [(True, 3), (False, 3), (True, 0)])
def test_far_walks_by_hubs_need_no_matrix_of_all_nodes(spark, monkeypatch, both, hubs):
    monkeypatch.setattr(graph, "NEAR_SHARE", -1.0)
    for name, value in (("HUB_EDGES", 6), ("ROWS_AT_ONCE", 7), ("FEW_QUERIES", 0), ("HUBS", hubs), ("HUB_REACH", 12), ("HUB_SHARE", 1.0), ("BLOCK_BYTES", 16_000)):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(5)
    pairs = {(rng.randrange(500), rng.randrange(3) if rng.random() < 0.25 else rng.randrange(500)) for _ in range(500)}
    edges = {(0, *p) for p in pairs} | {(0, *p[::-1]) for p in pairs if both or p[1] < 3 and rng.random() < 0.8} | {(1, a, b) for a, b in pairs if a % 3}
    weight = {e: rng.choice([1.0, 1.0, 2.0]) for e in edges}
    total, out = {}, {}
    for (t, s, d), w in weight.items():
        total[t, s] = total.get((t, s), 0.0) + w
        out.setdefault((t, s), []).append((d, w))
    adj = spark.createDataFrame([(t, f"n{s:03}", f"n{d:03}", w / total[t, s]) for (t, s, d), w in weight.items()], "etype int, src string, dst string, p double")
    # Seeds beside the graph, hubs as seeds, and seeds that share a reach.
    seeds = {q: {rng.choice([rng.randrange(500), rng.randrange(3), 900 + q]) if i else 40 + q: 1 / (60 + i) for i in range(12)} for q in range(12)}
    asked = spark.createDataFrame([(q, f"n{n:03}", s) for q, ns in seeds.items() for n, s in ns.items()], "qid long, node_id string, score double")
    want = {}
    for q, ns in seeds.items():
        v = {n: s / sum(ns.values()) for n, s in ns.items()}
        for t in (0, 1):
            mass = dict(v)
            for _ in range(20):
                new = {n: 0.5 * s for n, s in v.items()}
                for n, m in mass.items():
                    for d, w in out.get((t, n), []):
                        new[d] = new.get(d, 0.0) + 0.5 * m * w / total[t, n]
                    if (t, n) not in out:
                        for d, s in v.items():
                            new[d] += 0.5 * m * s
                mass = new
            want |= {(q, t, f"n{n:03}"): m for n, m in mass.items()}
    monkeypatch.setattr(graph, "_Wide", None)
    got = {(r["qid"], r["etype"], r["node_id"]): r["score"] for r in graph.pagerank(adj, asked, tolerance=None, others=6).collect()}
    for q, ns in seeds.items():
        most = {}
        for (k, _, n), m in want.items():
            if k == q and int(n[1:]) not in ns:
                most[n] = max(most.get(n, 0.0), m)
        kept = {*sorted(most, key=lambda n: (-round(most[n], 9), n))[:6], *(f"n{n:03}" for n in ns)}
        assert {k for k in got if k[0] == q} == {k for k in want if k[0] == q and k[2] in kept}
    assert all(abs(got[k] - want[k]) < 1e-13 for k in got)


def test_frequent_terms_are_added_by_a_product(spark, monkeypatch):
    index = spark.createDataFrame([(f"t{t}", d, float(1 + (t * d) % 3), 8 + d % 5) for d in range(200) for t in {d % 7, d % 31, 40}], "term string, node_id long, tf double, doc_len int")
    terms = spark.createDataFrame([(f"q{i}", f"t{t}", 1.0 + i % 3) for i in range(30) for t in {i % 7, i, 40}], "qid string, term string, weight double")
    df = lexical.document_frequency(terms, index)
    rows = lambda: {(r["qid"], r["rank"], r["node_id"], round(r["score"], 9)) for r in lexical.bm25_top_k(terms, index, df, 200, 10.0, 4).collect()}
    want = {(r["qid"], r["rank"], r["node_id"], round(r["score"], 9)) for r in fusion.top_k(lexical.bm25(terms, index, 200, 10.0), 4).collect()}
    monkeypatch.setattr(lexical, "CELLS_AT_ONCE", 50)
    monkeypatch.setattr(lexical, "DENSE_TERMS", 2)
    for share in (0.0, 0.01, 1.0):
        monkeypatch.setattr(lexical, "DENSE_SHARE", share)
        assert rows() == want
