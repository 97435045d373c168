"""Contradictory notes: much common wording, but diverging or negated content."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.session import pieces

#: Words of asked sets that are sent to every task at once.
MOST_ASKED_WORDS = 500_000
#: Rows and asked sets whose counts a task holds as a matrix; words counted by a product, which are in more than one of so many asked sets.
BLOCK_SETS, MOST_COMMON_WORDS, COMMON_SHARE = 1024, 4096, 64

def jaccard(shared: Column, n: Column, m: Column) -> Column:
    return shared / (n + m - shared)


def overlapping(asked: DataFrame, sets: DataFrame, least: float, best: tuple[int, float] | None = None) -> DataFrame:
    """``node_id, other_id, shared, n, m`` of all rows of ``asked(node_id, words)`` and other rows of ``sets(other_id, words)``
    with a jaccard of ``least`` or more (and a common word): the number of common words and those of each; words don't repeat.

    The asked sets travel to the tasks, a part of at most about ``MOST_ASKED_WORDS`` words after the other. A block of
    rows counts its common words with a block of asked sets as a matrix and passes on only the pairs that qualify, so
    pairs below ``least`` are never moved. Words of many asked sets are counted by a product, the others one by one.

    With ``best``, a number and a least score, both sides have ``negated`` too, which comes out as ``negated, other_negated``.
    Then a block passes on only the pairs that may be among an asked set's so many best conflicts of that score, with the
    cosine of the sets; the score is worked out as in :func:`contradiction_score`, to the last bit.
    """
    parts = pieces(asked.agg(F.sum(F.size("words"))).first()[0] or 0, MOST_ASKED_WORDS)
    # More parts of a part would get the same rows again.
    return reduce(DataFrame.unionByName, [_overlapping(asked.filter(F.pmod(F.xxhash64("node_id"), F.lit(parts)) == i), sets, least, best) for i in range(parts)])


def _overlapping(asked: DataFrame, sets: DataFrame, least: float, best: tuple[int, float] | None) -> DataFrame:
    rows = asked.filter(F.size("words") > 0).select("node_id", "words", "negated" if best else F.lit(False).alias("negated")).toArrow().combine_chunks()
    lists, names = rows.column("words").combine_chunks(), rows.column("node_id").combine_chunks()
    known = lists.flatten().dictionary_encode()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    word, of = known.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
    many = np.bincount(word, minlength=len(known.dictionary))
    common = np.argsort(-many, kind="stable")[:MOST_COMMON_WORDS]
    common = common[many[common] * COMMON_SHARE > len(size)]
    place = np.full(len(many), -1)
    place[common] = np.arange(len(common))
    negated = rows.column("negated").to_numpy()
    shared = asked.sparkSession.sparkContext.broadcast((names, size, negated, known.dictionary, word, of, place))

    def run(batches):
        names, size, negated, vocabulary, word, of, place = shared.value
        # The least of an asked set's best scores so far in this task, and the others before it.
        top = np.full((len(size), best[0]), best[1] - 1e-9) if best else None
        width, blocks = max(0, place.max(initial=-1) + 1), []
        for first in range(0, len(size), BLOCK_SETS):
            n = size[first : first + BLOCK_SETS]
            own = (of >= first) & (of < first + len(n))
            w, q = word[own], of[own] - first
            mine = np.zeros((len(n), width), dtype=np.float32)
            often = place[w] >= 0
            mine[q[often], place[w[often]]] = 1.0
            order = np.argsort(w, kind="stable")
            blocks.append((first, n, mine, q[order], np.searchsorted(w[order], np.arange(len(place) + 1))))
        for batch in batches:
            for low in range(0, batch.num_rows if blocks else 0, BLOCK_SETS):
                block = batch.slice(low, BLOCK_SETS)
                ids, words = block.column("other_id"), block.column("words")
                place_of_id = np.empty(block.num_rows, dtype=np.int64)
                place_of_id[pc.array_sort_indices(ids).to_numpy()] = np.arange(block.num_rows)
                flag = block.column("negated").to_numpy(zero_copy_only=False)
                m = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                code = pc.index_in(words.flatten(), vocabulary)
                hit = code.is_valid().to_numpy(zero_copy_only=False)
                doc, code = np.repeat(np.arange(len(m)), m)[hit], code.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                often = place[code] >= 0
                has = np.zeros((width, len(m)), dtype=np.float32)
                has[place[code[often]], doc[often]] = 1.0
                doc, code = doc[~often], code[~often]
                for first, n, mine, queries, starts in blocks:
                    counts = mine @ has
                    # A rare word's rows times its asked sets, as one long list.
                    repeat = starts[code + 1] - starts[code]
                    ends = np.cumsum(repeat)
                    q = queries[np.repeat(starts[code] - ends + repeat, repeat) + np.arange(repeat.sum())]
                    counts += np.bincount(q * len(m) + np.repeat(doc, repeat), minlength=counts.size).reshape(counts.shape)
                    # Counts are whole in float32; this first test is a little wider than the second.
                    q, d = np.nonzero((counts > 0) & (counts * np.float32(1 + least) >= np.float32(least * (1 - 1e-5)) * (n[:, None] + m[None, :]).astype(np.float32)))
                    c = counts[q, d].astype(np.int64)
                    kept = (c / (n[q] + m[d] - c) >= least - 1e-9) & ~pc.equal(names.take(pa.array(q + first)), ids.take(pa.array(d))).to_numpy(zero_copy_only=False)
                    q, d, c = q[kept], d[kept], c[kept]
                    if best:
                        overlap, cosine = c / (n[q] + m[d] - c), c / np.sqrt(n[q].astype(np.float64) * m[d])
                        score = overlap * (np.maximum(0.0, 1 - cosine) + np.where(negated[q + first] != flag[d], 0.5, 0.0))
                        kept = np.flatnonzero(score >= top[q + first, 0])
                        kept = kept[np.lexsort((place_of_id[d[kept]], -score[kept], q[kept]))]
                        number = np.arange(len(kept)) - np.searchsorted(q[kept], q[kept])
                        kept, number = kept[number < best[0]], number[number < best[0]]
                        q, d, c = q[kept], d[kept], c[kept]
                        seen = np.full((len(n), best[0]), -np.inf)
                        seen[q, number] = score[kept]
                        both = np.concatenate([top[first : first + len(n)], seen], axis=1)
                        top[first : first + len(n)] = np.sort(both, axis=1)[:, best[0] :]
                    columns = [names.take(pa.array(q + first)), ids.take(pa.array(d)), *(pa.array(x.astype(np.int32)) for x in (c, n[q], m[d])), pa.array(negated[q + first]), pa.array(flag[d])]
                    yield pa.RecordBatch.from_arrays(columns, names=["node_id", "other_id", "shared", "n", "m", "negated", "other_negated"])

    schema = f"node_id {asked.schema['node_id'].dataType.simpleString()}, other_id {sets.schema['other_id'].dataType.simpleString()}, shared int, n int, m int, negated boolean, other_negated boolean"
    found = sets.filter(F.size("words") > 0).select("other_id", "words", "negated" if best else F.lit(False).alias("negated")).mapInArrow(run, schema)
    return found.drop(*([] if best else ["negated", "other_negated"]))


def contradiction_score(overlap: Column, cosine: Column, flip: Column) -> Column:
    return overlap * (F.greatest(F.lit(0.0), 1 - cosine) + F.when(flip, 0.5).otherwise(0.0))


def contradictions(pairs: DataFrame, top_k: int = 5, min_score: float = 0.15) -> DataFrame:
    """Best conflicts per node of ``pairs(node_id, other_id, shared, n, m, negated, other_negated, cosine)``, with the
    numbers of words from :func:`overlapping`; pairs without common words don't conflict."""
    rows = pairs.withColumn("jaccard", jaccard(F.col("shared"), F.col("n"), F.col("m")))
    rows = rows.filter("jaccard > 0").withColumn("negation_flip", F.col("negated") != F.col("other_negated"))
    rows = rows.withColumn("score", contradiction_score(F.col("jaccard"), F.col("cosine"), F.col("negation_flip"))).filter(F.col("score") >= min_score)
    order = Window.partitionBy("node_id").orderBy(F.col("score").desc(), "other_id")
    best = rows.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= top_k)
    r = lambda c: F.round(c, 4).alias(c)
    return best.select("node_id", "other_id", r("score"), r("jaccard"), r("cosine"), "negation_flip")
