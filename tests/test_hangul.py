import pytest
from pyspark.sql import functions as F

from recallgrid.functions.hangul import jamo, jamo_column, strip_suffix, strip_suffix_column
from recallgrid.functions.text import bucket_pair, embed_tokens, fnv1a, lexical_tokens, normalize

STEMS = {
    "서울에서": "서울", "아침부터": "아침", "친구에게": "친구", "실록을": "실록", "판정을": "판정", "게임이": "게임", "요리가": "요리", "고향이": "고향",
    "어디가": "어디", "서울로": "서울", "학교로": "학교", "집으로": "집으", "회의": "회의", "주의": "주의", "의사": "의사", "가게": "가게", "나는": "나는",
    "검색했다": "검색", "사용합니다": "사용", "정리하는": "정리", "abc": "abc", "": "",
}


@pytest.mark.parametrize("word,stem", STEMS.items())
def test_strip_suffix(word, stem):
    assert strip_suffix(word) == stem


def test_strip_suffix_column_agrees(spark):
    rows = spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", strip_suffix_column(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == STEMS


def test_jamo(spark):
    assert jamo("먹었다") == "ㅁㅓㄱㅇㅓㅆㄷㅏ"
    assert jamo("한글 OK") == "ㅎㅏㄴㄱㅡㄹ OK"
    assert len(jamo("가나", pad=True)) == 6
    assert ord(jamo("가")[0]) == 0x3131
    row = spark.createDataFrame([("먹었다 ok",)], "t string").select(jamo_column(F.col("t")), jamo_column(F.col("t"), pad=True)).first()
    assert tuple(row) == (jamo("먹었다 ok"), jamo("먹었다 ok", pad=True))


def test_streams():
    assert normalize("ＡＢＣ") == "abc"
    assert [t for t in lexical_tokens("오일 저장 탱크") if t.startswith("ₓ")] == ["ₓ일저", "ₓ장탱"]
    assert lexical_tokens("오일 저장 backup") == ["오일", "저장", "backup", "ₓ일저", "bac", "ack", "cku", "kup"]
    assert lexical_tokens("the 12345678 1234 tool") == ["1234", "123", "234", "tool", "too", "ool"]
    assert len(lexical_tokens("가나다라 " * 5000, limit=50)) == 50
    assert not any(t.startswith("ₓ") for t in embed_tokens("오일 저장"))
    assert any(t.startswith("ⱼ") for t in embed_tokens("오일 저장"))
    assert max(map(len, lexical_tokens("x" * 2_000_000))) == 128


def test_hash():
    assert fnv1a("") == 0xCBF29CE484222325
    assert fnv1a("a") == 0xAF63DC4C8601EC8C
    assert all(0 <= b < 64 for b in bucket_pair("가", 64))
