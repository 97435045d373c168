"""Hangul arithmetic and guarded suffix stripping, for Python workers and as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST, LAST = 0xAC00, 0xD7A3

# Compatibility jamo in syllable order, the sign for an empty tail, and the closed lists of
# Korean particles and endings.
LEADS = "ㄱ ㄲ ㄴ ㄷ ㄸ ㄹ ㅁ ㅂ ㅃ ㅅ ㅆ ㅇ ㅈ ㅉ ㅊ ㅋ ㅌ ㅍ ㅎ".split()
VOWELS = "ㅏ ㅐ ㅑ ㅒ ㅓ ㅔ ㅕ ㅖ ㅗ ㅘ ㅙ ㅚ ㅛ ㅜ ㅝ ㅞ ㅟ ㅠ ㅡ ㅢ ㅣ".split()
TAILS = ["", *"ㄱ ㄲ ㄳ ㄴ ㄵ ㄶ ㄷ ㄹ ㄺ ㄻ ㄼ ㄽ ㄾ ㄿ ㅀ ㅁ ㅂ ㅄ ㅅ ㅆ ㅇ ㅈ ㅊ ㅋ ㅌ ㅍ ㅎ".split()]
EMPTY_TAIL = "ᴥ"
PARTICLES = """에서의 으로의 까지의 에게서 으로써 으로서 이라고 라고는 에서는 에서도 에서만 으로는 으로도 으로만 이라는 이라도 한테서 부터는 까지는
까지도 마저도 밖에는 에서 에게 한테 께서 으로 라고 이라 라는 부터 까지 마저 조차 처럼 보다 대로 만큼 이나 이든 이며 이고 밖에""".split()
AFTER_CONSONANT = "이 은 을 과".split()
AFTER_VOWEL = "가 는 를 와 로".split()
AFTER_ANY = "에 도 만".split()
ENDINGS = """하겠습니다 했습니다 합니다만 했는데요 했습니까 됩니다 습니다 합니다 입니다 했는데 하면서 하려고 했지만 하다가 했어요 하세요 했다 한다 하는 하게
하고 하지 하면 해서 하여 하기 된다 됐다 되는 되어 돼서 이다 였다""".split()
_RIEUL = TAILS.index("ㄹ")

#: Suffixes of several syllables in the order they are tried: particles before endings, long before short.
LONG_SUFFIXES = [sorted(PARTICLES, key=len, reverse=True), sorted(ENDINGS, key=len, reverse=True)]


def is_syllable(ch: str) -> bool:
    return FIRST <= ord(ch) <= LAST


def has_hangul(text: str) -> bool:
    return any(map(is_syllable, text))


def tail_of(ch: str) -> int:
    """Number of the tail consonant of a syllable, 0 for none."""
    return (ord(ch) - FIRST) % len(TAILS)


def jamo(text: str, pad: bool = False) -> str:
    """Syllables as compatibility jamo; with ``pad`` every syllable has three. Other characters stay."""

    def split(ch: str) -> str:
        rest, tail = divmod(ord(ch) - FIRST, len(TAILS))
        lead, vowel = divmod(rest, len(VOWELS))
        return LEADS[lead] + VOWELS[vowel] + (TAILS[tail] or (EMPTY_TAIL if pad else ""))

    return "".join(split(ch) if is_syllable(ch) else ch for ch in text)


def strip_suffix(word: str) -> str:
    """The word less one particle or ending, or the word itself if none can safely go."""
    if len(word) < 3 or not is_syllable(word[-1]):
        return word
    for suffixes in LONG_SUFFIXES:
        for suffix in suffixes:
            if word.endswith(suffix) and len(word) >= len(suffix) + 2:
                return word.removesuffix(suffix)
    stem, last = word[:-1], word[-1]
    if not is_syllable(stem[-1]):
        return word
    tail = tail_of(stem[-1])
    fits = last in AFTER_ANY or last in (AFTER_CONSONANT if tail else AFTER_VOWEL) or (last == "로" and tail == _RIEUL)
    return stem if fits else word


def jamo_column(text: Column, pad: bool = False) -> Column:
    code = lambda c: F.ascii(c) - F.lit(FIRST)
    table = lambda values: F.array(*[F.lit(v) for v in values])
    tails = [*TAILS]
    if pad:
        tails[0] = EMPTY_TAIL

    def split(c: Column) -> Column:
        n = code(c)
        parts = [
            F.element_at(table(LEADS), (F.floor(n / (len(VOWELS) * len(TAILS))) + 1).cast("int")),
            F.element_at(table(VOWELS), (F.floor((n % (len(VOWELS) * len(TAILS))) / len(TAILS)) + 1).cast("int")),
            F.element_at(table(tails), (n % len(TAILS) + 1).cast("int")),
        ]
        return F.when(c.rlike("[가-힣]"), F.concat(*parts)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), split), "")


def strip_suffix_column(word: Column) -> Column:
    """:func:`strip_suffix` without leaving the JVM."""
    last, before = F.substring(word, -1, 1), F.substring(word, -2, 1)
    tail = (F.ascii(before) - F.lit(FIRST)) % len(TAILS)
    patterns = [f"^(.{{2,}}?)(?:{'|'.join(s)})$" for s in LONG_SUFFIXES]
    short = last.isin(AFTER_ANY) | (last.isin(AFTER_CONSONANT) & (tail > 0)) | (last.isin(AFTER_VOWEL) & (tail == 0)) | ((last == "로") & (tail == _RIEUL))
    out = F.when((F.length(word) < 3) | ~last.rlike("[가-힣]"), word)
    for pattern in patterns:
        out = out.when(word.rlike(pattern), F.regexp_extract(word, pattern, 1))
    return out.when(before.rlike("[가-힣]") & short, F.regexp_replace(word, ".$", "")).otherwise(word)
