"""Tokenising: the lexical and the embedding stream, and hashes of tokens and texts."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain, groupby, islice, pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions.hangul import has_hangul, jamo, strip_suffix

# Words without signal, marks of token kinds, negation markers, input bounds, hash constants.
STOPWORDS = "the a an of to and is in it i you".split()
JAMO_MARK, CROSS_MARK = "ⱼ", "ₓ"
NEGATIONS = [
    "않", "안 ", "안된", "안 된", "안됨", "못 ", "못한", "못함", "없", "아니", "불가", "금지", "말 것", "실패",
    "not ", "no ", "never", "don't", "doesn't", "can't", "cannot", "won't", "broken", "fails", "failed", "disabled", "unavailable",
]
WORD_CHARS, LONG_NUMBER = 128, 6
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

_WORD = re.compile(r"[\w']+")
_STOP = frozenset(STOPWORDS)
WORD_CLASS = r"[\p{L}\p{N}_']+"


def normalize(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def words(text: str):
    for word in _WORD.findall(normalize(text)):
        if word not in _STOP and not (len(word) > LONG_NUMBER and word.isdigit()):
            yield word[:WORD_CHARS]


def grams(word: str, sizes) -> list[str]:
    """Overlapping character n-grams of the sizes shorter than the word."""
    return [word[i : i + n] for n in sizes if n < len(word) for i in range(len(word) - n + 1)]


def _lexical(text: str, sizes, strip: bool, cross: bool):
    crossing: list[str] = []
    for korean, run in groupby(words(text), key=has_hangul):
        if korean:
            run = list(run)
            for word in run:
                yield word
                if strip and (stem := strip_suffix(word)) != word:
                    yield stem
                yield from grams(word, sizes)
            if cross:
                crossing = [CROSS_MARK + a[-1] + b[0] for a, b in pairwise(run)]
        else:
            for word in run:
                yield word
                yield from crossing
                crossing = []
                if len(word) > 3:
                    yield from grams(word, (3,))
    yield from crossing


def lexical_stream(text: str, sizes=(2,), strip: bool = True, cross: bool = True, limit: int | None = None):
    """Words, stems, syllable bigrams (trigrams for other scripts), and bigrams across the blanks of a run of
    Hangul words, which follow the first word after the run; of the whole text, or its first ``limit``."""
    return islice(_lexical(text, sizes, strip, cross), limit)


def lexical_tokens(text: str, sizes=(2,), strip: bool = True, cross: bool = True, limit: int | None = None) -> list[str]:
    """:func:`lexical_stream` as a list."""
    return list(lexical_stream(text, sizes, strip, cross, limit))


def embed_tokens(text: str, sizes=(2,), jamo_sizes=(3, 5), strip: bool = True, limit: int | None = None) -> list[str]:
    """The lexical stream without crossing bigrams, then padded jamo n-grams of the Hangul words."""
    marked = (JAMO_MARK + g for w in words(text) if has_hangul(w) for g in grams(jamo(w, pad=True), jamo_sizes))
    return list(islice(chain(_lexical(text, sizes, strip, False), marked), limit))


def fnv1a(token: str) -> int:
    h = FNV_OFFSET
    for byte in token.encode():
        h = ((h ^ byte) * FNV_PRIME) % (1 << 64)
    return h


def bucket_pair(token: str, buckets: int) -> tuple[int, int]:
    """Two nearly independent buckets of a token."""
    h = fnv1a(token)
    high, low = divmod(h, 1 << 32)
    return h % buckets, (high ^ low) % buckets


def words_column(text: Column) -> Column:
    """:func:`words` in the JVM, with lower case for the full normalisation.

    It agrees where NFKC and case folding change nothing but letter case (so on plain Korean and English).
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD_CLASS), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(STOPWORDS) & ~((F.length(w) > LONG_NUMBER) & w.rlike(r"^\p{Nd}+$")))
    return F.transform(kept, lambda w: F.substring(w, 1, WORD_CHARS))


def grams_column(word: Column, n: int) -> Column:
    """Overlapping n-grams of a word longer than ``n``, else an empty array."""
    return F.when(F.length(word) > n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substr(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def has_negation(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for marker in NEGATIONS:
        out = out | low.contains(marker)
    return out


def query_hash(query: Column) -> Column:
    return F.substring(F.sha1(query), 1, 16)


def is_held_out(hashed: Column) -> Column:
    """A fixed quarter of the queries (by hash) judges the learner and never trains it."""
    return F.substring(hashed, 16, 1).isin("0", "4", "8", "c")


def content_digest(body: Column, kind: Column, tags: Column, links: Column, importance: Column, pinned: Column, geometry: str, teacher: Column) -> Column:
    """SHA-1 over every input that derived rows depend on, joined by U+001F."""
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    flag = F.when(pinned, "True").otherwise("False")
    parts = [body, kind, joined(tags), joined(links), F.format_string("%.6f", importance), flag, F.lit(geometry), teacher]
    return F.sha1(F.array_join(F.array(*parts), "\x1f"))
