"""Postings and BM25 over batches of queries."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.text import lexical_stream
from recallgrid.operators.fusion import Best, top_k
from recallgrid.session import pieces, shuffle_width, spread

#: (Query, term) rows that are sent to every task at once; a larger batch of queries goes in parts.
MOST_BROADCAST_TERMS = 500_000
#: Documents and queries whose scores a task holds as a matrix.
BLOCK_DOCS, BLOCK_QUERIES = 2048, 2048
#: A term that adds to more than this share of that matrix is added by a product, so many terms at a time; the others cell by cell, about so many at a time.
DENSE_SHARE, DENSE_TERMS, CELLS_AT_ONCE = 0.001, 256, 1_000_000


def postings(docs: DataFrame, title_boost: float = 2.0, limit: int | None = None, title_limit: int | None = None, only: set[str] | None = None, **tokens) -> DataFrame:
    """``term, node_id, n, tf, doc_len`` of ``docs(node_id, body, title)``, without a shuffle.

    With ``only``, a batch of queries' terms, just these come out, and a row per document with a null term.

    ``n`` counts the term in the whole body (or its first ``limit`` tokens), ``tf`` is ``1 + ln n`` plus ``title_boost - 1``
    for a term of the title (which the body is expected to contain), ``doc_len`` the body's tokens. Null or
    empty bodies give no rows.
    """

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for node, body, title in zip(*(batch.column(c).to_pylist() for c in ("node_id", "body", "title"))):
                counts = Counter(lexical_stream(body or "", limit=limit, **tokens))
                length = counts.total()
                weights = {t: 1.0 + log(n) for t, n in counts.items()}
                if title and title_boost > 1:
                    for t in set(lexical_stream(title, limit=title_limit, **tokens)):
                        weights[t] = weights.get(t, 0.0) + title_boost - 1
                if only is not None:
                    weights = {t: w for t, w in weights.items() if t in only} | {None: 0.0}
                for term, tf in weights.items():
                    for column, value in zip(out, (term, node, counts.get(term, 0), tf, length)):
                        column.append(value)
            kinds = (pa.string(), batch.schema.field("node_id").type, pa.int32(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["term", "node_id", "n", "tf", "doc_len"])

    rows = spread(docs.select("node_id", "body", "title"), "node_id")
    kind = rows.schema["node_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"term string, node_id {kind}, n int, tf double, doc_len int")


def query_terms(queries: DataFrame, limit: int | None = None, **tokens) -> DataFrame:
    """``qid, term, weight`` of ``queries(qid, text)``; a term's weight is ``1 + ln`` of its count in the query."""
    rows = queries.select(F.col("qid").alias("node_id"), F.col("text").alias("body"), F.lit("").alias("title"))
    terms = postings(rows, title_boost=1.0, limit=limit, **tokens)
    return terms.select(F.col("node_id").alias("qid"), "term", F.col("tf").alias("weight"))


def corpus_stats(lengths: DataFrame, length: str = "doc_len") -> tuple[int, float]:
    """Number of documents and mean length, both at least 1."""
    row = lengths.agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("total")).first()
    n = max(1, row["n"])
    return n, max(1.0, (row["total"] or 0) / n)


def bm25(terms: DataFrame, index: DataFrame, n_docs: int, mean_len: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``qid, node_id, score`` for every query and every document that shares a term with it.

    ``terms(qid, term, weight)`` is the batch of queries, ``index(term, node_id, tf, doc_len)`` the postings; a
    null ``doc_len`` counts as the mean. The postings of the queries' terms are gathered by document, so that
    a document's scores are summed where they are and a frequent term's postings lie in all tasks. The
    batch's weighted terms go to every task, a part of the queries of at most about ``MOST_BROADCAST_TERMS`` rows after
    the other.
    """
    parts = pieces(terms.count(), MOST_BROADCAST_TERMS)
    if parts > 1:
        halves = [bm25(terms.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i), index, n_docs, mean_len, k1, b) for i in range(parts)]
        return reduce(DataFrame.unionByName, halves)
    wanted, small = terms.select("term").distinct(), F.broadcast
    hits = index.join(small(wanted), "term", "left_semi").select("term", "node_id", "tf", "doc_len")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df, "term").select("qid", "term", (F.col("weight") * idf).alias("w"))
    length = F.coalesce(F.col("doc_len").cast("double"), F.lit(mean_len))
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length / mean_len))
    hits = hits.repartition(shuffle_width(index.sparkSession), "node_id")
    return hits.join(small(weighted), "term").groupBy("qid", "node_id").agg(F.sum(part).alias("score"))


def bm25_of(pairs: DataFrame, terms: DataFrame, index: DataFrame, df: DataFrame, n_docs: int, mean_len: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The scores of given ``pairs(qid, node_id)``; pairs without a common term don't come out."""
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.coalesce(F.col("doc_len").cast("double"), F.lit(mean_len))
    part = F.col("weight") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length / mean_len))
    hits = pairs.select("qid", "node_id").distinct().join(index.select("term", "node_id", "tf", "doc_len"), "node_id")
    return hits.join(terms.join(df, "term"), ["qid", "term"]).groupBy("qid", "node_id").agg(F.sum(part).alias("score"))


def document_frequency(terms: DataFrame, index: DataFrame) -> DataFrame:
    """``term, df`` of the batch's terms."""
    return index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_top_k(terms: DataFrame, index: DataFrame, df: DataFrame, n_docs: int, mean_len: float, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``qid, node_id, score, rank``: the ``k`` best documents per query of a batch.

    The batch's weighted terms travel to the tasks, a part of the queries of at most about ``MOST_BROADCAST_TERMS`` rows
    after the other. Postings are gathered by document; a block of documents adds up the scores of a block of queries
    as a matrix and a task passes on only its own ``k`` best per query, so frequent terms cost no shuffle of pairs and a task's
    memory grows neither with the documents nor with the queries.
    """
    parts = pieces(terms.count(), MOST_BROADCAST_TERMS)
    if parts > 1:
        return reduce(DataFrame.unionByName, [bm25_top_k(terms.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i), index, df, n_docs, mean_len, k, k1, b) for i in range(parts)])
    rows = terms.join(df, "term").select("qid", "term", "weight", "df").toArrow()
    asked = rows.column("qid").combine_chunks().dictionary_encode()
    known = rows.column("term").combine_chunks().dictionary_encode()
    query_of, term_of = asked.indices.to_numpy(), known.indices.to_numpy()
    many = rows.column("df").to_numpy()
    weight = rows.column("weight").to_numpy() * np.log(1 + (n_docs - many + 0.5) / (many + 0.5))
    order = np.lexsort((query_of, term_of))
    query_of, weight = query_of[order], weight[order]
    keys = term_of[order].astype(np.int64) * len(asked.dictionary) + query_of
    shared = terms.sparkSession.sparkContext.broadcast((asked.dictionary, known.dictionary, query_of, weight, keys))
    names = {c: terms.schema[c].dataType.simpleString() for c in ("qid", "term")} | {"node_id": index.schema["node_id"].dataType.simpleString()}

    def best_of(best, node, term, part, queries, query_of, weight, keys):
        """Adds the best of a block of documents, by blocks of queries."""
        docs = node.dictionary_encode()
        doc, size = docs.indices.to_numpy(), len(docs.dictionary)
        order = np.argsort(term, kind="stable")
        doc, term, part = doc[order], term[order], part[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        many = np.diff(first, append=len(term))
        for low in range(0, len(queries), BLOCK_QUERIES):
            scores = np.zeros((min(BLOCK_QUERIES, len(queries) - low), size))
            # The block's queries of each term.
            a, b = (np.searchsorted(keys, term[first] * len(queries) + x) for x in (low, low + len(scores)))
            cells = (b - a) * many
            dense = np.flatnonzero(cells > DENSE_SHARE * scores.size)
            for s in range(0, len(dense), DENSE_TERMS):
                some = dense[s : s + DENSE_TERMS]
                one, two = np.zeros((len(scores), len(some))), np.zeros((len(some), size))
                for i, t in enumerate(some):
                    one[query_of[a[t] : b[t]] - low, i] = weight[a[t] : b[t]]
                    two[i, doc[first[t] : first[t] + many[t]]] = part[first[t] : first[t] + many[t]]
                scores = scores + one @ two if s else one @ two
            flat, rest = scores.reshape(-1), np.flatnonzero((cells > 0) & (cells <= DENSE_SHARE * scores.size))
            turn = np.cumsum(cells[rest]) // CELLS_AT_ONCE
            for some in np.split(rest, np.flatnonzero(np.diff(turn)) + 1):
                n = cells[some]
                t = np.repeat(some, n)
                q, d = np.divmod(np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n), many[t])
                q, d = q + a[t], d + first[t]
                np.add.at(flat, (query_of[q] - low).astype(np.int64) * size + doc[d], weight[q] * part[d])
            # Scores that aren't above 0 count as none; where a query's limit is above 0, they don't reach it.
            open_ = np.flatnonzero(best.least[low : low + len(scores)] <= 0)
            if len(open_):
                own = scores[open_]
                own[own <= 0] = -np.inf
                scores[open_] = own
            best.add(scores, low, docs.dictionary)

    def run(batches):
        """Rows come sorted by document; a block is scored when it has enough documents, at the end of one."""
        words, best = shared.value[1], Best(len(shared.value[0]), k)
        nodes, terms_seen, parts, held = [], [], [], 0

        def close():
            node = pa.chunked_array(nodes).combine_chunks()
            best_of(best, node, np.concatenate(terms_seen), np.concatenate(parts), shared.value[0], *shared.value[2:])

        for batch in batches:
            code = pc.index_in(batch.column("term"), words)
            hit = code.is_valid()
            batch, code = batch.filter(hit), code.filter(hit).to_numpy(zero_copy_only=False).astype(np.int64)
            if not batch.num_rows:
                continue
            node = batch.column("node_id")
            length = batch.column("doc_len").fill_null(mean_len).to_numpy(zero_copy_only=False) / mean_len
            tf = batch.column("tf").to_numpy(zero_copy_only=False)
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))
            new = np.concatenate([[not nodes or node[0] != nodes[-1][-1]], pc.not_equal(node[1:], node[:-1]).to_numpy(zero_copy_only=False)]).astype(bool)
            number, start = held + np.cumsum(new), 0
            # Rows at which a document starts that no longer fits into the block.
            for cut in [*np.flatnonzero(new & (number > BLOCK_DOCS) & ((number - 1) % BLOCK_DOCS == 0)).tolist(), batch.num_rows]:
                if cut > start:
                    nodes.append(node[start:cut])
                    terms_seen.append(code[start:cut])
                    parts.append(part[start:cut])
                if cut < batch.num_rows:
                    close()
                    nodes, terms_seen, parts = [], [], []
                start = cut
            held = int((number[-1] - 1) % BLOCK_DOCS + 1)
        if nodes:
            close()
        yield from best.batches(shared.value[0])

    hits = index.select("term", "node_id", "tf", F.col("doc_len").cast("double").alias("doc_len")).join(df.select("term"), "term", "left_semi")
    width = max(shuffle_width(index.sparkSession), index.sparkSession.sparkContext.defaultParallelism)
    found = hits.repartition(width, "node_id").sortWithinPartitions("node_id").mapInArrow(run, f"qid {names['qid']}, node_id {names['node_id']}, score double")
    return top_k(found, k)
