"""Keyword-stuffed and link-list pages: robust Mahalanobis outliers in spam-directed directions.

Nothing here knows words of a language. Function words (and, in Hangul, word endings) are learned from the
collection; pages are measured block by block; each language group's ordinary blocks give a robust centre
and scatter; a page is spam if the greater part of it lies in blocks that are outliers towards spam.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.session import cut_lineage, spread

#: Measures of a block, each from 0 to 1. The first six rise towards spam; the last two mark records (logs,
#: code, forms), however far out they lie.
FEATURES = ("unbound", "linked", "repeated", "order", "separated", "unended", "syntax", "ordered")
SPAM_AXES = 6
#: What a block of prose looks like before any is seen, with the weight of so many documents, and the least
#: deviation of each feature. That of ``unbound`` is a share of what a group's prose has of function words, so that
#: their lack alone reaches no cutoff in any language.
PRIOR_CENTRE, PRIOR_DOCS = np.array([0.4, 0.0, 0.25, 0.03, 0.2, 0.1, 0.02, 0.0]), 20.0
LEAST_DEVIATION = np.array([0.22, 0.22, 0.08, 0.05, 0.06, 0.3, 0.015, 0.04])

SCRIPTS = ("latin", "hangul", "kana", "cyrillic", "other")
LATIN, HANGUL, KANA, CYRILLIC, OTHER = range(len(SCRIPTS))
#: Code point ranges of the scripts. Kana stands for all scripts written without blanks.
_RANGES = (
    (0x41, 0x24F, LATIN), (0x1E00, 0x1EFF, LATIN), (0xFF21, 0xFF5A, LATIN), (0x400, 0x52F, CYRILLIC), (0x1100, 0x11FF, HANGUL), (0x3130, 0x318F, HANGUL), (0xAC00, 0xD7A3, HANGUL),
    (0xE00, 0xEFF, KANA), (0x3005, 0x3007, KANA), (0x3040, 0x30FF, KANA), (0x31F0, 0x31FF, KANA), (0x3400, 0x4DBF, KANA), (0x4E00, 0x9FFF, KANA), (0xF900, 0xFAFF, KANA), (0xFF66, 0xFF9D, KANA),
)
_LINK = re.compile(r"<a\s[^<>]*>[^<]*</a>|\[[^\[\]\n]*\]\([^()\s]*\)|\[\[[^\[\]\n]*\]\]|(?:https?://|www\.)[\w.~:/?#@!$&()*+;=%-]+|(?<!\w)#[^\s#,|、·★/]+", re.ASCII)
_MAY_LINK = re.compile(r"://|www\.|\]\(|\[\[|<a\s|#[^\s#]")
#: A line that starts with a figure of several parts: a time or date.
_STAMP = re.compile(r"^[^\w\n]*(\d+(?:[-:/.t ]\d+)+)", re.MULTILINE)
_BLANK, _LETTER, _FIGURE, _MARK = range(4)
_SYNTAX, _ENDERS = "()[]{}=", ".!?。！？…"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
BLOCK_SIZE, SLICE_CHARS, LEVELS = 240, 2_000_000, 200


@lru_cache
def _tables():
    """``kind`` (blank, letter, figure, mark), ``script``, and the flags of syntax and sentence ends, per code point."""
    kind, script = np.full(0x20001, _MARK, dtype=np.uint8), np.full(0x20001, OTHER, dtype=np.uint8)
    by_category = {"L": _LETTER, "M": _LETTER, "N": _FIGURE, "Z": _BLANK}
    for c in range(0x20000):
        kind[c] = by_category.get(unicodedata.category(chr(c))[0], _MARK)
    kind[[9, 10, 11, 12, 13]], kind[[0x5F, 0x20000]] = _BLANK, _LETTER
    for low, high, name in _RANGES:
        script[low : high + 1] = name
    flags = np.zeros((2, 0x20001), dtype=bool)
    flags[0, [ord(c) for c in _SYNTAX]] = True
    flags[1, [ord(c) for c in _ENDERS]] = True
    return kind, script, flags[0], flags[1]


def _mix(a: np.ndarray, b) -> np.ndarray:
    """Codes spread over 64 bits; ``b`` is a number or an array."""
    b = np.uint64(b * 0xC2B2AE3D27D4EB4F % 2**64) if isinstance(b, int) else b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (a ^ b) * _BASE
    x = (x ^ (x >> np.uint64(32))) * _BASE
    return x ^ (x >> np.uint64(29))


class Scan:
    """Some texts as one array of characters, with their documents, words and links."""

    def __init__(self, texts: list[str]):
        kind, script, _, _ = _tables()
        self.texts = [t.lower() for t in texts]
        self.codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.n_docs, n = len(texts), len(self.codes)
        lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.doc_start = np.cumsum(lengths) - lengths
        self.doc = np.repeat(np.arange(self.n_docs), lengths)
        self.at = np.minimum(self.codes, 0x20000)
        self.kind = kind[self.at]
        self.link, self.link_start = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        for start, text in zip(self.doc_start.tolist(), self.texts):
            if _MAY_LINK.search(text):
                for m in _LINK.finditer(text):
                    self.link[start + m.start() : start + m.end()] = True
                    self.link_start[start + m.start()] = True
        self.fresh = np.zeros(n, dtype=bool)
        self.fresh[self.doc_start[lengths > 0]] = True
        self.letter = (self.kind == _LETTER) & ~self.link
        # Combining marks belong to the word, whatever its script.
        self.alone = self.letter & (script[self.at] == KANA)
        before = np.concatenate([[False], self.letter[:-1]])
        single = self.alone | np.concatenate([[False], self.alone[:-1]])
        self.first = np.flatnonzero(self.letter & (~before | single | self.fresh))
        self.word = np.cumsum(np.bincount(self.first, minlength=n)) - 1
        size = np.bincount(self.word[self.letter], minlength=len(self.first))
        last = self.first + size - 1
        up = np.cumprod(np.full(n, _BASE, dtype=np.uint64)) if n else np.empty(0, np.uint64)
        down = np.cumprod(np.full(n, _INVERSE, dtype=np.uint64)) if n else np.empty(0, np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((self.codes + np.uint64(7)) * up)])
        self.word_hash = _mix((sums[last + 1] - sums[self.first]) * down[self.first], 2)
        self.word_script = script[self.at[self.first]]
        self.word_doc = self.doc[self.first]
        self.ending = _mix(self.codes[last].astype(np.uint64), 1)
        self.has_ending = self.word_script == HANGUL
        self.last = last
        letters = self.letter.nonzero()[0]
        self.script_letters = np.bincount(self.doc[letters] * len(SCRIPTS) + script[self.at[letters]], minlength=self.n_docs * len(SCRIPTS)).reshape(self.n_docs, len(SCRIPTS))

    def groups(self) -> list[str]:
        """The language group of each document: a script with three quarters of its letters, ``mixed``, or ``none``."""
        total = self.script_letters.sum(axis=1)
        top = self.script_letters.argmax(axis=1)
        main = self.script_letters.max(axis=1, initial=0)
        return [("none" if not t else SCRIPTS[k] if 4 * m >= 3 * t else "mixed") for t, k, m in zip(total, top, main)]

    def units(self):
        """``(script, code, word number)`` of the words and Hangul endings; codes have 32 bits."""
        with_end = np.flatnonzero(self.has_ending)
        number = np.concatenate([np.arange(len(self.first)), with_end])
        return self.word_script[number], np.concatenate([self.word_hash, self.ending[with_end]]) >> np.uint64(32), number


def unit_code(word: str, ending: bool = False) -> int:
    s = Scan([word])
    return int((s.ending if ending else s.word_hash)[0] >> np.uint64(32))


def _slices(texts: list[str]):
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= SLICE_CHARS or i - start >= 8_000:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _support(batches):
    """Per batch and unit (a word, or a Hangul word's last letter): the summed weight of the documents that use it
    as function words are used; as unit -1, per script, that of all documents with a few words of it."""
    shift = np.uint64
    for batch in batches:
        texts, weights = batch.column("text").to_pylist(), batch.column("weight").to_numpy()
        keys, sums = [], []
        for a, b in _slices(texts):
            s, w = Scan(texts[a:b]), weights[a:b]
            words = np.bincount(s.word_doc * len(SCRIPTS) + s.word_script, minlength=s.n_docs * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
            known = words >= 6
            keys.append(np.stack([np.arange(len(SCRIPTS)), np.full(len(SCRIPTS), -1)], axis=1))
            sums.append(w @ known)
            script, unit, number = s.units()
            follower = np.concatenate([s.word_hash[1:], [np.uint64(0)]])[number] >> shift(48)
            # One number each: document, script, unit, follower.
            held = np.sort((s.word_doc[number].astype(np.uint64) << shift(51)) | (script.astype(np.uint64) << shift(48)) | (unit << shift(16)) | follower)
            new = np.concatenate([[True], held[1:] != held[:-1]])[: len(held)]
            owner = held >> shift(16)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])[: len(held)])
            varied = np.add.reduceat(new, first, dtype=np.int64) if len(first) else first
            # A document that strings a few words together keeps following each with the same ones.
            first = first[varied >= 0.3 * np.diff(np.append(first, len(held)))]
            doc, kind = (owner[first] >> shift(35)).astype(np.int64), ((owner[first] >> shift(32)) & shift(7)).astype(np.int64)
            good = known[doc, kind]
            keys.append(np.stack([kind, (owner[first] & shift(0xFFFFFFFF)).astype(np.int64)], axis=1)[good])
            sums.append(w[doc[good]])
        if keys:
            keys, sums = np.concatenate(keys), np.concatenate(sums)
            one = (keys[:, 0] << 33) + keys[:, 1] + 1
            distinct, where = np.unique(one, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array((distinct >> 33).astype(np.int32)), pa.array((distinct & (2**33 - 1)) - 1), pa.array(np.bincount(where, weights=sums))], names=["script", "unit", "docs"])


def function_units(pages: DataFrame, share: float = 0.2, least_docs: float = 3.0, most: int = 300) -> dict[str, list[int]]:
    """Per script the function words of the collection: the codes of the units that at least ``share`` of its documents use.

    ``pages`` has ``text, weight``. Sums are combined per batch and per task before they move. At most ``most``
    units of a script (those of the most documents) come to the driver.
    """
    sums = pages.select("text", "weight").mapInArrow(_support, "script int, unit long, docs double").groupBy("script", "unit").agg(F.sum("docs").alias("docs"))
    sums = cut_lineage(sums.filter(F.col("docs") >= least_docs))
    totals = sums.filter("unit = -1").select("script", F.col("docs").alias("total"))
    often = sums.filter("unit >= 0").join(F.broadcast(totals), "script").filter(F.col("docs") >= share * F.col("total"))
    place = F.row_number().over(Window.partitionBy("script").orderBy(F.col("docs").desc(), "unit"))
    out: dict[str, list[int]] = {}
    for r in often.withColumn("place", place).filter(F.col("place") <= most).collect():
        out.setdefault(SCRIPTS[r["script"]], []).append(r["unit"])
    return {name: sorted(units) for name, units in sorted(out.items())}


def _found(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), max(0, len(table) - 1))
    return table[at] == values if len(table) else np.zeros(len(values), dtype=bool)


class Blocks:
    """The blocks of a scan: runs of lines and sentences of one kind, in pieces of about ``BLOCK_SIZE`` characters."""

    def __init__(self, s: Scan, lexicon: np.ndarray):
        _, _, syntax, ender = _tables()
        n = len(s.codes)
        solid = s.kind != _BLANK
        solid_at = np.flatnonzero(solid)
        line = (s.codes == 10) | (s.codes == 13)
        ends = ender[s.at] & ~s.link & np.concatenate([~solid[1:], [True]])[:n]
        bound = _found(s.word_hash >> np.uint64(32), lexicon) | (s.has_ending & _found(s.ending >> np.uint64(32), lexicon))
        starts = s.fresh | np.concatenate([[False], (line | ends)[:-1]])[:n]
        unit = np.cumsum(starts) - 1
        m = int(unit[-1]) + 1 if n else 0
        count = lambda at, weights=None: np.bincount(unit[at], weights=weights, minlength=m)
        size, linked = count(solid), count(solid & s.link)
        has, held = count(s.first), count(s.first, bound)
        # A sentence ends in its mark, perhaps with a bracket or quote behind it.
        tail = solid_at[np.flatnonzero(np.concatenate([unit[solid_at][1:] != unit[solid_at][:-1], [True]])[: len(solid_at)])]
        closed = ender[s.at[tail]] | ((s.kind[tail] == _MARK) & ender[s.at[np.maximum(tail, 1) - 1]])
        ended = np.zeros(m, dtype=bool)
        ended[unit[tail]] = closed & ~s.link[tail]
        mark = 4 * (2 * linked > size) + 2 * ((4 * held >= has) & (has > 0)) + ended
        full = np.flatnonzero(size > 0)
        owner = s.doc[np.flatnonzero(starts)]
        change = np.ones(len(full), dtype=bool)
        change[1:] = (owner[full][1:] != owner[full][:-1]) | (mark[full][1:] != mark[full][:-1])
        run_of = np.full(m, -1)
        run_of[full] = np.cumsum(change) - 1
        run = run_of[unit]
        runs = run[solid_at]
        total = np.bincount(runs, minlength=int(change.sum()))
        begin = np.cumsum(total) - total
        pieces = np.maximum(1, np.round(total / BLOCK_SIZE)).astype(np.int64)
        offset = np.cumsum(pieces) - pieces
        block = np.zeros(n, dtype=np.int64)
        block[solid_at] = offset[runs] + np.minimum((np.arange(len(runs)) - begin[runs]) * pieces[runs] // np.maximum(1, total[runs]), pieces[runs] - 1)
        # A word belongs to the block in which it starts.
        letters = np.flatnonzero(s.letter)
        block[letters] = block[s.first[s.word[letters]]]
        k = int(pieces.sum())
        per = lambda at, weights=None: np.bincount(block[at], weights=weights, minlength=k).astype(np.float64)
        self.n = k
        self.size = per(solid)
        self.doc = np.zeros(k, dtype=np.int64)
        self.doc[block[solid_at]] = s.doc[solid_at]
        at = block[s.first]
        self.words = np.bincount(at, minlength=k).astype(np.float64)
        safe = np.maximum(1.0, self.words)
        unbound = 1 - np.bincount(at, weights=bound, minlength=k) / safe
        held, counts = self._counts(at, s.word_hash)
        share = counts / safe[held]
        entropy = -np.bincount(held, weights=share * np.log(share), minlength=k)
        order = np.where(self.words > 1, 1 - entropy / np.log(np.maximum(2.0, self.words)), 0.0)
        # Pieces of words, longer ones in alphabets than in syllables: compounds of the same words repeat them.
        next_code = lambda step: np.where(np.concatenate([s.letter[step:], np.zeros(step, bool)])[: len(s.letter)], np.concatenate([s.codes[step:], np.zeros(step, np.uint32)])[: len(s.codes)], 0)[letters].astype(np.uint64)
        script = s.word_script[s.word[letters]]
        gram = _mix(s.codes[letters].astype(np.uint64), next_code(1))
        long = (script == LATIN) | (script == CYRILLIC) | (script == OTHER)
        gram = np.where(long, _mix(_mix(gram, next_code(2)), next_code(3)), gram)
        distinct = np.bincount(self._counts(block[letters], gram)[0], minlength=k)
        repeated = 1 - distinct / np.maximum(1.0, per(letters))
        marks = (s.kind == _MARK) & ~s.link & ~syntax[s.at]
        # A line break between lines of a block separates as a mark does.
        breaks = np.flatnonzero(starts & (np.concatenate([[False], line[:-1]])[:n]))
        breaks = solid_at[np.minimum(np.searchsorted(solid_at, breaks), max(0, len(solid_at) - 1))] if len(solid_at) else breaks
        apart = per(marks & solid) + per(breaks)
        figure = (s.kind == _FIGURE) & ~s.link
        figures = per(np.flatnonzero(figure & ~np.concatenate([[False], figure[:-1]])[:n]))
        separated = apart / np.maximum(1.0, apart + self.words + figures)
        safe_size = np.maximum(1.0, self.size)
        stamped = np.zeros(n, dtype=bool)
        for start, text in zip(s.doc_start.tolist(), s.texts):
            before: list[int] = []
            for found in _STAMP.finditer(text):
                now = [int(x[-18:]) for x in re.findall(r"\d+", found.group(1))]
                if now >= before:
                    stamped[start + found.start(1)] = True
                before = now
        dated = count(stamped) > 0
        # So is the indentation of a line.
        head = np.flatnonzero(starts)[full]
        body = solid_at[np.searchsorted(solid_at, head)] if len(full) else head
        deep = (body - head >= 2) & (line[np.maximum(head, 1) - 1] | s.fresh[head])
        indent = np.bincount(block[body[deep]], weights=(body - head)[deep], minlength=k)
        brackets = (per(syntax[s.at] & ~s.link) + indent) / (safe_size + indent)
        self.links = per(s.link_start)
        self.features = np.stack(
            [unbound, per(solid & s.link) / safe_size, repeated, order, separated, per(solid & ~ended[unit]) / safe_size, brackets, per(solid & dated[unit]) / safe_size], axis=1
        ).clip(0, 1)


    @staticmethod
    def _counts(block: np.ndarray, value: np.ndarray):
        """The block of each distinct value of a block, and how often it is there (values by 40 bits of their hash)."""
        keys = np.sort((block.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        return (keys[first] >> np.uint64(40)).astype(np.int64), np.diff(np.append(first, len(keys)))


def _measure(lexicon: dict[str, list[int]]):
    """Documents with their blocks as bytes: features, words, links (a byte each) and size (two bytes)."""

    def run(batches):
        units = np.array(sorted({u for script in lexicon.values() for u in script}), dtype=np.uint64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            groups, packed = [], []
            for a, b in _slices(texts):
                s = Scan(texts[a:b])
                blocks = Blocks(s, units)
                cells = np.empty((blocks.n, len(FEATURES) + 4), dtype=np.uint8)
                cells[:, : len(FEATURES)] = np.round(blocks.features * LEVELS)
                cells[:, -4] = np.minimum(255, blocks.words)
                cells[:, -3] = np.minimum(255, blocks.links)
                cells[:, -2:] = np.minimum(65_535, blocks.size).astype(np.uint16)[:, None].view(np.uint8)
                groups += s.groups()
                order = np.argsort(blocks.doc, kind="stable")
                cut = np.searchsorted(blocks.doc[order], np.arange(s.n_docs + 1))
                whole = cells[order]
                packed += [whole[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(groups, pa.string()), batch.column("weight"), pa.array(packed, pa.binary())], names=["doc_id", "group", "weight", "blocks"])

    return run


def _unpack(column):
    """Features, words, links and sizes of all blocks of a batch, and the row of each."""
    cells = [np.frombuffer(x, dtype=np.uint8).reshape(-1, len(FEATURES) + 4) for x in column.to_pylist()]
    row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    whole = np.concatenate(cells) if cells else np.empty((0, len(FEATURES) + 4), np.uint8)
    return whole[:, : len(FEATURES)], whole[:, -4].astype(np.float64), whole[:, -3].astype(np.float64), np.ascontiguousarray(whole[:, -2:]).view(np.uint16)[:, 0].astype(np.float64), row


def _histogram(batches):
    """The blocks of at least five words by language group and features in steps of 1/20; a document's share its weight."""
    for batch in batches:
        levels, words, _, _, row = _unpack(batch.column("blocks"))
        names, which = np.unique(np.array(batch.column("group").to_pylist(), dtype=object).astype(str), return_inverse=True)
        keep = words >= 5
        coarse = (levels[keep].astype(np.int64) + LEVELS // 40) // (LEVELS // 20)
        key = which[row[keep]]
        for f in range(len(FEATURES)):
            key = key * 32 + coarse[:, f]
        keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        weight = batch.column("weight").to_numpy() / np.maximum(1, np.bincount(row[keep], minlength=batch.num_rows))
        total = np.bincount(inverse, weights=weight[row[keep]], minlength=len(keys))
        columns = [pa.array(names[which[row[keep]][first]].astype(object), pa.string()), *[pa.array(coarse[first, f] / 20.0) for f in range(len(FEATURES))], pa.array(total)]
        yield pa.RecordBatch.from_arrays(columns, names=["group", *FEATURES, "weight"])


def _weighted_limit(rows, keep: float) -> dict:
    """Per group the least level up to which ``keep`` of the weight lies, from rows ``(group, level, weight)``."""
    out: dict = {}
    for group in {r[0] for r in rows}:
        levels = sorted((r[1], r[2]) for r in rows if r[0] == group)
        total, run = sum(w for _, w in levels), 0.0
        for level, w in levels:
            run += w
            if run >= keep * total:
                out[group] = level
                break
    return out


def _per_group(values: dict):
    out = None
    for group, value in sorted(values.items()):
        out = F.when(F.col("group") == group, value) if out is None else out.when(F.col("group") == group, value)
    return out


def _squared(centre: np.ndarray, scatter: np.ndarray):
    inverse = np.linalg.inv(scatter)
    gap = [F.col(f) - float(c) for f, c in zip(FEATURES, centre)]
    return sum((gap[i] * gap[j] * float(inverse[i, j] * (1 if i == j else 2)) for i in range(len(gap)) for j in range(i, len(gap))), F.lit(0.0))


def robust_prior():
    """Centre and scatter of a group of which nothing has been seen."""
    scatter = np.diag(LEAST_DEVIATION**2)
    scatter[0, 0] *= (1 - PRIOR_CENTRE[0]) ** 2
    return PRIOR_CENTRE, scatter


def robust_scatter(histogram: DataFrame, rounds: int = 3, keep: float = 0.25, truncation: float = 2.2) -> dict:
    """Robust centre and scatter of each language group's blocks, by concentration steps over their histogram.

    The first subset is the share ``keep`` of a group's blocks with the most function words; each round then takes the
    share ``keep`` with the smallest distances. ``truncation`` widens the scatter of so small a share (the factor of a
    normal distribution in eight dimensions). Centre and scatter are drawn towards the prior by the weight of
    ``PRIOR_DOCS`` documents, so that a group of a few pages is judged as prose of no known language. Only
    sums and bins of distances per group reach the driver.
    """
    p = len(FEATURES)
    floor = robust_prior()[1]
    models: dict = {}
    for step in range(rounds + 1):
        level = F.col("unbound") if not step else F.least(F.floor(_per_group({g: _squared(*m) for g, m in models.items()}) * 4) / 4, F.lit(100.0))
        ranked = histogram.withColumn("level", level)
        bins = ranked.groupBy("group", "level").agg(F.sum("weight").alias("weight")).collect()
        limits = _weighted_limit([tuple(r) for r in bins], keep)
        if not limits:
            break
        inside = ranked.filter(F.col("level") <= _per_group({g: float(x) for g, x in limits.items()}))
        w = F.col("weight")
        sums = [F.sum(w).alias("n"), *[F.sum(w * F.col(f)).alias(f"m_{i}") for i, f in enumerate(FEATURES)]]
        sums += [F.sum(w * F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s_{i}_{j}") for i in range(p) for j in range(i, p)]
        for r in inside.groupBy("group").agg(*sums).collect():
            n = r["n"]
            centre = np.array([r[f"m_{i}"] for i in range(p)]) / n
            second = np.array([[r[f"s_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / n
            scatter = truncation * (second - np.outer(centre, centre))
            least = LEAST_DEVIATION**2
            least[0] *= (1 - centre[0]) ** 2
            scatter += np.diag(np.maximum(0.0, least - np.diag(scatter)))
            drawn = (n * centre + PRIOR_DOCS * PRIOR_CENTRE) / (n + PRIOR_DOCS)
            models[r["group"]] = (drawn, (n * scatter + PRIOR_DOCS * floor) / (n + PRIOR_DOCS))
    return models


def judge_blocks(features: np.ndarray, words: np.ndarray, links: np.ndarray, centre: np.ndarray, scatter: np.ndarray, cutoff: float, least_turn: float = 1.0):
    """Squared distances of blocks, and whether each is an outlier towards spam.

    A deviation has a part along the spam axes, in their direction, and a rest (records, or less of what
    spam has). It is an outlier towards spam if the first part exceeds ``cutoff`` and the rest, and if it leaves sentences at all: by
    ``least_turn`` deviations fewer function words or more links, without which repetition is a subject kept to.
    Rates over few words or links are drawn to the centre.
    """
    gap = features - centre
    gap[:, [0, 2, 3, 4]] *= (words / (words + 3.0))[:, None]
    gap[:, 1] *= links / (links + 0.7)
    inverse = np.linalg.inv(scatter)
    length = lambda x: np.einsum("ij,jk,ik->i", x, inverse, x)
    towards = np.where(np.arange(len(FEATURES)) < SPAM_AXES, np.maximum(gap, 0.0), 0.0)
    distance, part = length(gap), length(towards)
    turned = (towards[:, :2] / np.sqrt(np.diag(scatter)[:2])).sum(axis=1) >= least_turn
    return distance, (part > cutoff) & turned & (part > length(gap - towards))


def _score(models: dict, cutoff: float, greater_part: float):
    plain = robust_prior()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            levels, words, links, size, row = _unpack(batch.column("blocks"))
            features = levels / float(LEVELS)
            groups = np.array(batch.column("group").to_pylist(), dtype=object)
            distance, spam = np.zeros(len(row)), np.zeros(len(row), dtype=bool)
            for group in set(groups.tolist()):
                at = np.flatnonzero((groups == group)[row])
                distance[at], spam[at] = judge_blocks(features[at], words[at], links[at], *models.get(group, plain), cutoff)
            whole = np.maximum(1.0, np.bincount(row, weights=size, minlength=n))
            mean = lambda x: np.bincount(row, weights=size * x, minlength=n) / whole
            # A word or two string nothing together.
            said = np.bincount(row, weights=words, minlength=n) + 4 * (mean(features[:, 1]) > 0)
            listed = np.where(said > 3, mean(spam), 0.0)
            columns = [batch.column("doc_id"), batch.column("group"), *[pa.array(mean(features[:, f])) for f in range(len(FEATURES))]]
            columns += [pa.array(mean(distance)), pa.array(listed), pa.array(listed > greater_part)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "group", *FEATURES, "distance", "listed", "spam"])

    return run


def _weighted_pages(documents: DataFrame, share: float = 1 / 1000) -> DataFrame:
    """``doc_id, text, weight``: all copies of a text that holds more than ``share`` of the rows weigh as one row.

    There are at most ``1/share`` such texts, so their hashes and counts are broadcast.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S")).withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("all"))
    hot = counts.join(F.broadcast(total), (F.col("n") > 1) & (F.col("n") > F.col("all") * share)).select("h", (1.0 / F.col("n")).alias("weight"))
    return rows.join(F.broadcast(hot), "h", "left").select("doc_id", "text", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def spam_scores(documents: DataFrame, cutoff: float = 20.1, greater_part: float = 0.5) -> DataFrame:
    """``doc_id, group``, the features, ``distance``, ``listed`` and ``spam`` for each document with a text.

    A text is cut into blocks (see :class:`Blocks`). ``unbound`` is the share of words that are no function
    words of the collection (see :func:`function_units`), ``linked`` that of links and tags, ``repeated`` that
    of pieces of words seen before in the block, ``order`` one less the normalised word entropy, ``separated``
    that of marks and line breaks among words and marks, ``syntax`` that of brackets and indentation, ``ordered``
    that of lines which start with ascending times. A block counts if it lies towards spam at a squared
    Mahalanobis distance from its language group's robust centre above ``cutoff`` (the 99 % point of chi-square with 8
    degrees of freedom; see :func:`judge_blocks`). ``spam`` holds if such blocks
    make up more than ``greater_part`` of the text (``listed``); ``distance`` and features are means over its blocks.

    Null and blank texts, and null ids, are left out; repeated rows are scored each; statistics cover all
    documents, and the copies of a frequent text count there as one. Language groups are told by the script of the letters,
    whatever ``lang`` says. Empty tables give no rows; other columns are ignored.
    """
    pages = spread(_weighted_pages(documents), "doc_id")
    lexicon = function_units(pages)
    measured = cut_lineage(pages.mapInArrow(_measure(lexicon), "doc_id long, group string, weight double, blocks binary"))
    columns = "group string, " + ", ".join(f"{f} double" for f in FEATURES)
    histogram = measured.select("group", "weight", "blocks").mapInArrow(_histogram, columns + ", weight double")
    histogram = cut_lineage(histogram.groupBy("group", *FEATURES).agg(F.sum("weight").alias("weight")))
    models = robust_scatter(histogram)
    return measured.select("doc_id", "group", "blocks").mapInArrow(_score(models, cutoff, greater_part), f"doc_id long, {columns}, distance double, listed double, spam boolean")
