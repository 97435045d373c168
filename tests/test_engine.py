import pytest

from recallgrid.engine import MemoryEngine

NOTES = [
    ("a", "docker deploy failed on the server", "Docker", ["ops"], ["b"]),
    ("b", "kubernetes cluster upgrade notes", "K8s", ["ops"], []),
    ("c", "고양이 사료를 주문했다", "고양이", ["pet"], []),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    with MemoryEngine.open(spark, str(tmp_path_factory.mktemp("engine")), dim=16, vocab_size=256) as e:
        rows = spark.createDataFrame(NOTES, "node_id string, text string, title string, tags array<string>, links array<string>")
        e.index(rows, now=1e9)
        yield e


def test_search_learn_remove(spark, engine):
    queries = spark.createDataFrame([("q1", "docker server"), ("q2", "고양이"), ("q3", "")], "qid string, text string")
    hits = engine.search(queries, now=1e9)
    first = {r["qid"]: r["node_id"] for r in hits.filter("rank = 0").collect()}
    assert first["q1"] == "a" and first["q2"] == "c"
    assert engine.search(queries, top_k=0, now=1e9).count() == 0
    assert {r["kind"] for r in engine.search(queries, kinds=["fact"], now=1e9).collect()} == set()
    before = {r["node_id"]: r["trust"] for r in engine.store.read("nodes").collect()}
    events = [("docker server", "a", True, 1e9, [1.0] * 14), ("docker server", "b", True, 1e9, [0.5] * 14), ("docker server", "c", False, 1e9, [0.0] * 14)]
    report = engine.feedback(spark.createDataFrame(events, "query string, node_id string, used boolean, ts double, features array<float>"))
    assert report["applied"] == 3 and report["version"] == engine.store.version() and report["pairs"] in (0, 2) and (report["loss"] > 0) == (report["pairs"] > 0)
    assert {r["what"]: r["n"] for r in engine.stats().collect()}["ranker:events"] == report["events"]
    assert engine.edge("a", "b", 3)["w"] > 0 and engine.edge("a", "zz", 3) is None
    after = {r["node_id"]: r["trust"] for r in engine.store.read("nodes").collect()}
    assert after["a"] == pytest.approx(before["a"] + 0.05) and after["c"] == before["c"]
    assert {(r["src"], r["dst"]) for r in engine.store.read("edges").filter("etype = 3").collect()} == {("a", "b"), ("b", "a")}
    engine.record_access(hits.filter("qid = 'q1' and rank = 0"), now=1e9)
    assert {r["access_count"] for r in engine.store.read("nodes").filter("node_id = 'a'").collect()} == {1}


def test_reindex_is_idempotent(spark, engine):
    rows = spark.createDataFrame(NOTES, "node_id string, text string, title string, tags array<string>, links array<string>")
    before = engine.store._manifest(engine.store.version())
    engine.index(rows, now=2e9)
    after = engine.store._manifest(engine.store.version())
    # Only times change, and only the changed rows are written.
    assert {t for t in after if after[t] != before[t]} == {"nodes"} and len(after["nodes"]) in (1, len(before["nodes"]) + 1)
    engine.index(spark.createDataFrame([("c", "강아지 산책")], "node_id string, text string"), now=2e9)
    assert engine.get_text(spark.createDataFrame([("c",)], "node_id string")).first()["body"] == "강아지 산책"
    assert engine.store.read("nodes").count() == 3


def test_join_modes(spark, engine):
    both = {r["node_id"]: r["score"] for r in engine.search_join(["docker", "server"]).collect()}
    either = {r["node_id"] for r in engine.search_join(["docker", "server"], "or").collect()}
    assert both["a"] == pytest.approx(1.0) and both.keys() <= either
    with pytest.raises(ValueError):
        engine.search_join(["x"], "xor")


def test_contradictions(spark, tmp_path):
    with MemoryEngine.open(spark, str(tmp_path / "c"), dim=16, vocab_size=256) as e:
        rows = [("x", "the payment gateway works with the new backend service"), ("y", "the payment gateway never works with the new backend service"), ("z", "cats sleep all day")]
        e.index(spark.createDataFrame(rows, "node_id string, text string"), now=1e9)
        found = e.contradictions(spark.createDataFrame([("x",)], "node_id string")).collect()
        assert [r["other_id"] for r in found] == ["y"] and found[0]["negation_flip"]
        e.remove(spark.createDataFrame([("y",)], "node_id string"))
        assert e.contradictions(spark.createDataFrame([("x",)], "node_id string")).count() == 0
        assert {r["what"]: r["n"] for r in e.stats().collect()}["nodes"] == 2


def test_handles(spark, tmp_path):
    import asyncio

    from recallgrid.adapter import Retriever, VectorHandle

    async def use(e):
        handle, retriever = VectorHandle(e), Retriever(e)
        assert handle.descriptor["dimension"] == 16
        docs = [{"id": "n1", "text": "server deploy log", "metadata": {"category": "fact", "tags": ["ops"], "importance": 0}}, {"id": "n2", "text": "cat food"}]
        assert await handle.index_batch(docs) == 2
        await handle.index("n3", "server room key", {"title": "Key"})
        assert (await handle.search("server deploy", top_k=1, score_threshold=-100.0))[0]["id"] == "n1"
        assert (await handle.fetch_document("n1"))["kind"] == "fact" and (await handle.fetch_document("n1"))["importance"] == 1.0
        hits = await retriever.retrieve("server", top_k=3)
        assert (await retriever.feedback(hits[0]["query_token"], [hits[0]["node_id"]]))["applied"] == 1.0
        assert await retriever.feedback("unknown", []) == {"applied": 0.0}
        assert await handle.reindex() == 0
        await handle.remove("n1")
        assert await handle.fetch_document("n1") is None

    with MemoryEngine.open(spark, str(tmp_path / "h"), dim=16, vocab_size=256, epsilon=0.0) as e:
        asyncio.run(use(e))


def test_contradictions_of_a_short_note_among_long_ones(spark, tmp_path):
    short = "gateway works backend"
    rows = [("x", short)] + [(f"a{i:03}", (short + " ") * 30 + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(90)] + [("z", "gateway never works backend")]
    with MemoryEngine.open(spark, str(tmp_path / "s"), dim=16, vocab_size=256) as e:
        e.index(spark.createDataFrame(rows, "node_id string, text string"), now=1e9)
        found = e.contradictions(spark.createDataFrame([("x",)], "node_id string")).collect()
        assert max(found, key=lambda r: r["score"])["other_id"] == "z"


def test_contradiction_pairs_without_a_cap(spark, tmp_path):
    from recallgrid.plans.corpus import contradiction_pairs

    short = "gateway works backend"
    rows = [(0, short)] + [(i, short + " " + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(1, 91)] + [(99, "gateway never works backend")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r["node_id"], r["other_id"]) for r in contradiction_pairs(spark, str(tmp_path)).collect()] == [(0, 99)]


def test_long_bodies_are_stored_whole(spark, tmp_path):
    body = "the payment gateway works with the new backend service " * 90
    with MemoryEngine.open(spark, str(tmp_path / "l"), dim=16, vocab_size=256) as e:
        e.index(spark.createDataFrame([("x", body), ("y", body + "but never on sundays")], "node_id string, text string"), now=1e9)
        assert e.get_text(spark.createDataFrame([("y",)], "node_id string")).first()["body"] == body + "but never on sundays"
        found = e.contradictions(spark.createDataFrame([("x",)], "node_id string")).collect()
        assert [r["other_id"] for r in found] == ["y"] and found[0]["negation_flip"]


def test_feedback_trains_on_all_rows_and_goes_on(spark, tmp_path):
    from recallgrid.functions.text import is_held_out, query_hash
    from pyspark.sql import functions as F

    schema = "query string, node_id string, used boolean, ts double, features array<float>"

    def batch(start):
        return spark.createDataFrame([(f"q{i}", n, n == "a", 1e9 + i, [float((i * 7 + j) % 5) + (n == "a") for j in range(14)]) for i in range(start, start + 40) for n in ("a", "b")], schema)

    with MemoryEngine.open(spark, str(tmp_path / "f"), dim=16, vocab_size=256, replay_cap=8) as e:
        e.index(spark.createDataFrame([("a", "one"), ("b", "two")], "node_id string, text string"), now=1e9)
        held, total = 0, 0
        for start in (0, 40):
            before = e._state()[0]
            rows = batch(start)
            held += rows.filter("used").filter(is_held_out(query_hash(F.col("query")))).count()
            e.feedback(rows)
            total += 40
            after, _ = e._state()
            # A step and 8 replays for each pair that isn't held out, one event for each that is.
            assert after.events == 9 * (total - held) + held and after.seen == 2 * (total - held)
            if start:
                assert abs(after.live[0] - before.live[0]).max() < abs(after.live[0] - type(after)().live[0]).max()
        assert e.store.read("feedback").count() <= 8
