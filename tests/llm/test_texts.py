"""Packing, mixing and keyword-stuffed pages."""

import os
from collections import defaultdict

import numpy as np
import pytest

from recallgrid.llm.mixing import mix_sources, pivotal
from recallgrid.llm.packing import ShardIndex, pack_shard, pack_texts, packing_report
from recallgrid.llm.spam import Blocks, Scan, _weighted_pages, function_units, spam_scores, unit_code
from recallgrid.llm.tokens import DEFAULT_VOCABULARY, encode, encoder

needs_vocabulary = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary file")
NOTE_KO = "점심 뒤에 들은 바로는 산책이 따로 끝났다고 한다. 보일러 문제는 빠르게 풀렸지만 수리 쪽은 다음 주에 다시 보기로 했다."
NOTE_EN = "The backup was slow this morning, but only half of it worked. We decided to archive the draft before the holidays."


def test_shard_index_finds_the_neighbour():
    items = [np.array([1, 2, 3, 4]), np.array([1, 2, 3, 9]), np.array([5, 6, 7, 8])]
    scores = ShardIndex(items).scores(items[0])
    assert scores[0] > scores[1] > 0 and scores[2] == 0


def test_pack_shard_places_everything_once():
    rng = np.random.default_rng(0)
    items = [rng.integers(0, 500, n) for n in rng.integers(1, 400, 300)] + [rng.integers(0, 9, 1000), np.array([1])]
    boxes = pack_shard(items, 1000)
    assert sorted(i for b in boxes for i in b) == list(range(len(items)))
    used = [sum(len(items[i]) for i in b) for b in boxes]
    assert max(used) <= 1000 and sum(used) / (1000 * len(boxes)) > 0.97
    assert pack_shard([np.array([1, 2])] * 5, 2) == [[i] for i in range(5)]


@needs_vocabulary
def test_packing(spark):
    rows = [(i, f"{NOTE_EN} number {i} " * (1 + i % 5)) for i in range(200)] + [(500, NOTE_KO * 400), (501, None), (502, ""), (503, " \n"), (504, "x" * 30_000), (None, "lost")] + [(7, f"{NOTE_EN} number 7 " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as container", "1 as place", "'b' as signature")
    for shard_rows in (60, 10_000):
        packed = pack_texts(df, capacity=512, shard_rows=shard_rows).collect()
        ranges, boxes = defaultdict(list), defaultdict(int)
        for r in packed:
            ranges[r["doc_id"]].append((r["token_start"], r["token_end"]))
            boxes[r["container"]] += r["token_end"] - r["token_start"]
        enc = encoder()
        want = defaultdict(list)
        for doc, text in rows:
            if doc is not None:
                want[doc].append(len(encode(enc, text)))
        assert ranges.keys() == want.keys() and max(boxes.values()) <= 512
        for doc, sizes in want.items():
            assert sum(e - s for s, e in ranges[doc]) == sum(sizes)
            if max(sizes) <= 512:
                assert len(ranges[doc]) == len(sizes)
            else:
                assert sorted(ranges[doc])[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(ranges[doc]), sorted(ranges[doc])[1:]))
        places = [(r["container"], r["place"]) for r in packed]
        assert len(set(places)) == len(places)
    report = packing_report(pack_texts(df, capacity=512), 512).first()
    assert report["fill"] > 0.9 and report["fullest"] == 512
    assert pack_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("order", ["descending", "random"])
def test_pivotal_keeps_mass_and_expectation(order):
    rng = np.random.default_rng(1)
    shares, sizes = rng.random(40), rng.integers(1, 60, 40).astype(float)
    if order == "descending":
        sizes = np.sort(sizes)[::-1]
    total, runs = np.zeros(40), 3000
    for seed in range(runs):
        out = pivotal(shares, sizes, np.random.default_rng(seed))
        assert ((out > 0) & (out < 1)).sum() <= 1 and (out * sizes).sum() == pytest.approx((shares * sizes).sum())
        total += out
    assert np.abs(total / runs - shares).max() < 0.05
    assert pivotal(np.array([]), np.array([]), rng).tolist() == [] and pivotal(np.array([1.0, 0.0]), np.array([5.0, 5.0]), rng).tolist() == [1.0, 0.0]


@needs_vocabulary
def test_mixing(spark):
    rows = [(i, NOTE_EN + f" {i}", ["alpha-one", "ALPHA_ONE ", "beta", "gamma"][i % 4]) for i in range(400)]
    rows += [(1000, None, "beta"), (1001, "", "beta"), (1002, "text", None), (None, "text", "beta"), (1003, "text", "unlisted")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as copies", "2 as share", "3 as n_tokens")
    targets = spark.createDataFrame([("Alpha one", 0.2, 1), ("beta", 0.5, 3), ("gamma", 0.2, 2), ("missing", 0.1, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    for chunk_rows in (30, 20_000):
        mixture, report = mix_sources(docs, targets, chunk_rows=chunk_rows, fan_in=3)
        by = {r["source"]: r for r in report.collect()}
        assert by.keys() == {"alpha-one", "beta", "gamma", "missing"} and by["missing"]["mixture_tokens"] == 0
        for name, share in (("alpha-one", 2 / 9), ("beta", 5 / 9), ("gamma", 2 / 9)):
            assert by[name]["planned_share"] == pytest.approx(share, abs=1e-6) and by[name]["actual_share"] == pytest.approx(share, abs=0.005)
        rows_out = mixture.collect()
        assert len({r["doc_id"] for r in rows_out}) == len(rows_out)
        assert max(r["copies"] for r in rows_out if r["source"] == "beta") == 3 and all(r["copies"] >= 1 for r in rows_out)
        assert all(r["copies"] <= 1 for r in rows_out if r["source"] == "alpha-one")
    small, report = mix_sources(docs, targets, total_tokens=500.0)
    assert report.agg({"mixture_tokens": "sum"}).first()[0] == pytest.approx(500, abs=60)
    none, report = mix_sources(docs.limit(0), targets)
    assert none.count() == 0 and report.count() == 4
    none, report = mix_sources(docs, targets.limit(0))
    assert none.count() == 0 and report.count() == 0


EN_STARTS = ["The backup was slow this morning", "We moved the shelf to the cellar", "I forgot to answer the letter from the bank", "It was too cold for the garden", "She asked about the key of the old house", "They still owe us the second half of the rent"]
EN_ENDS = ["and nobody knows why.", "but the rest of it can wait.", "so I will call them again on Monday.", "because the last attempt did not work.", "which is fine for now.", "and we agreed to look at it again in spring."]
KO_STARTS = ["점심 뒤에 보일러를 고쳤고", "이사는 다음 달로 미뤘는데", "은행에서 온 편지를 아직 읽지 않아서", "날씨가 추워서 산책을 못 갔지만", "수리 기사가 늦게 와서", "회의가 길어졌기 때문에"]
KO_ENDS = ["내일 다시 보기로 했다.", "비용이 생각보다 컸다.", "누구도 이유를 알지 못했다.", "저녁에 한 번 더 전화할 생각이다.", "결국 처음으로 돌아갔다.", "그래도 배운 게 많았다."]
JA_STARTS = ["今日は朝から雨が降っていたので", "会議が長くなったために", "駅前の店が閉まっていて", "友達から手紙が届いたが", "昨日の夜は寒かったけれど", "新しい机を買ったので"]
JA_ENDS = ["家で本を読んでいました。", "明日もう一度考えることにした。", "だれも理由を知らなかった。", "夕方にもう一度電話をするつもりです。", "結局は最初に戻った。", "それでも学ぶことが多かった。"]
FOREIGN = [
    "Hier matin nous avons visité la maison de ma tante, qui voulait vendre le jardin à ses voisins. Elle pense que le prix est juste, mais personne ne sait encore quand le notaire pourra signer les papiers.",
    "Gestern haben wir den Keller aufgeräumt und dabei die alten Briefe meiner Großmutter gefunden. Niemand wusste, dass sie so lange in der Stadt gewohnt hat, bevor der Krieg zu Ende war.",
    "Ayer por la tarde fuimos al mercado para comprar fruta, pero la tienda de la esquina estaba cerrada. Mi hermana dice que el dueño se ha ido de viaje y que no vuelve hasta el lunes.",
    "Sarah emailed Bob yesterday regarding invoice discrepancies. Payment arrives Monday.",
    "회의 자료 준비 완료. 예산 검토 필요. 내일 오전 보고 예정.",
]


def _notes(starts, ends, n, rng):
    return [" ".join(f"{rng.choice(starts)} {rng.choice(ends)}".replace("。 ", "。") for _ in range(rng.integers(2, 9))) for _ in range(n)]


def _pages(rng):
    brand = lambda: "".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(3))
    words = rng.choice(["lamp", "insurance", "hotel", "umbrella", "mattress", "loan"], 3, replace=False)
    offers = ["cheap", "best", "discount", "online", "price", "sale"]
    stuffed = lambda sep, n: sep.join(f"{rng.choice(offers)} {rng.choice(words)}" for _ in range(n))
    return [
        stuffed(" ", 60), stuffed(", ", 30), stuffed(" | ", 40), "\n".join(f"https://www.{brand()}.example/{brand()}/{rng.integers(9999)}" for _ in range(20)), " ".join(f"#{rng.choice(offers)}{rng.choice(words)}" for _ in range(30)),
        "\n".join(f"[{rng.choice(offers)} {rng.choice(words)}](https://{brand()}.example)" for _ in range(15)), " · ".join(f"[[{brand()}]]" for _ in range(30)), EN_STARTS[0] + " " + EN_ENDS[0] + "\n" + stuffed(", ", 40),
        " / ".join(f"{rng.choice(list('달력여권이사빵')) * 2} {rng.choice(['할인', '가격', '추천', '업체'])}" for _ in range(50)),
    ]


def test_spam_is_told_by_the_distance_not_by_words(spark):
    rng = np.random.default_rng(3)
    good = [*_notes(EN_STARTS, EN_ENDS, 150, rng), *_notes(KO_STARTS, KO_ENDS, 150, rng), *_notes(JA_STARTS, JA_ENDS, 60, rng), *FOREIGN]
    good += [EN_STARTS[1] + " " + EN_ENDS[1] + "\n\nhttps://www.zapini.example/queue-playlist?id=99", KO_STARTS[0] + " " + KO_ENDS[0] + "\n- [x] 안경 2\n- [ ] 김치 3\n- [ ] 지표 5\n" + KO_STARTS[1] + " " + KO_ENDS[2]]
    good += ["\n".join(f"12:{i:02}:07 INFO ranker.split rows={i * 37} done" for i in range(40)), "```\n" + "def run():\n    return check(a, 5)\n" * 10 + "```\n" + EN_STARTS[2] + " " + EN_ENDS[3]]
    bad = [p for _ in range(3) for p in _pages(rng)] + ["、".join(f"{rng.choice(['激安', '格安', '最安値', '通販'])}{rng.choice(['時計', '財布', '旅行'])}" for _ in range(60))]
    rows = [(i, t) for i, t in enumerate(good)] + [(10_000 + i, t) for i, t in enumerate(bad)] + [(20_000, bad[0]), (30_000, None), (30_001, " \n"), (None, bad[0]), (30_002, "x"), (30_003, "가" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as group", "1 as listed", "0 as spam", "2 as distance", "'w' as weight", "'b' as blocks")
    scored = {r["doc_id"]: r["spam"] for r in spam_scores(df).collect()}
    assert {d for d, s in scored.items() if s and d < 30_000} == {10_000 + i for i in range(len(bad))} | {20_000}
    assert 30_000 not in scored and 30_001 not in scored and None not in scored and len(scored) == len(rows) - 3
    # Without the distance, the same features mark nothing.
    assert spam_scores(df, cutoff=float("inf")).filter("spam").count() == 0
    assert spam_scores(df.limit(0)).count() == 0 and spam_scores(df.filter("doc_id = 30000")).count() == 0


@pytest.mark.parametrize("share", [0.34, 0.7])
def test_spam_that_fills_a_group(spark, share):
    rng = np.random.default_rng(4)
    notes = _notes(EN_STARTS, EN_ENDS, 100, rng)
    page = "cheap lamp best lamp online lamp deal, " * 40
    for pages in ([page] * 300, [page + f"lamp {chr(97 + i % 26)}{chr(97 + i // 26)} price, " * (i % 9) for i in range(300)]):
        rows = [(i, t) for i, t in enumerate(notes)] + [(1000 + i, t) for i, t in enumerate(pages[: round(100 * share / (1 - share))])]
        scored = spam_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"] for r in scored if r["spam"]} == {d for d, _ in rows if d >= 1000}
    only = spam_scores(spark.createDataFrame([(i, page) for i in range(5)], "doc_id long, text string"))
    assert only.filter("spam").count() == 5


def test_function_words_are_learned(spark):
    rng = np.random.default_rng(5)
    notes = [*_notes(EN_STARTS, EN_ENDS, 90, rng), *_notes(KO_STARTS, KO_ENDS, 90, rng)] + [_pages(rng)[0]] * 40
    pages = _weighted_pages(spark.createDataFrame(list(enumerate(notes)), "doc_id long, text string"))
    assert pages.agg({"weight": "sum"}).first()[0] == pytest.approx(len(set(notes)), abs=1)
    found = function_units(pages)
    assert {unit_code(w) for w in ("the", "it", "and", "to")} <= set(found["latin"]) and {unit_code(w, True) for w in ("고", "다")} <= set(found["hangul"])
    assert not {unit_code(w) for w in ("lamp", "cheap", "best", "discount")} & set(found["latin"])


def test_words_and_blocks():
    s = Scan(["One two2three 한글은_말", "", "雨が x\u0301y"])
    word = lambda i: "".join(map(chr, s.codes[s.first[i] : s.last[i] + 1]))
    assert [word(i) for i in range(len(s.first))] == ["one", "two", "three", "한글은_말", "雨", "が", "x\u0301y"]
    assert s.word_hash[0] == Scan(["two one"]).word_hash[1] and len(set(s.word_hash.tolist())) == 7
    empty = np.empty(0, np.uint64)
    text = "https://a.test/x\nhttps://b.test/y\n" * 9 + "The end is near."
    b = Blocks(Scan([text]), empty)
    assert b.n == 2 and b.features[0, 1] == 1.0 and b.links.tolist() == [18, 0] and b.features[1].tolist()[:2] == [1.0, 0.0] and b.features[1, 5] == 0.0
    assert b.size.sum() == len("".join(text.split()))
    log = Blocks(Scan(["10:00:01 go\n10:00:02 go\n09:00:00 go\n"]), empty)
    assert log.n == 1 and log.features[0, -1] == pytest.approx(2 / 3) and log.features[0, 2] > 0.5
    assert Blocks(Scan([" \n"]), empty).n == 0
