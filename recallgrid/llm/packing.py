"""Filling containers of fixed capacity with texts, by lexical retrieval packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.tokens import DEFAULT_VOCABULARY, encode, encoder, ship
from recallgrid.operators.skew import heavy_codes
from recallgrid.session import pieces


class ShardIndex:
    """BM25 over a shard's items; an item's own terms are the query."""

    def __init__(self, items: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(items)
        lengths = np.array([len(x) for x in items], dtype=np.float64)
        owner = np.repeat(np.arange(n), lengths.astype(np.int64))
        tokens = np.concatenate(items) if n else np.empty(0, dtype=np.int64)
        keys, tf = np.unique(tokens.astype(np.int64) * max(n, 1) + owner, return_counts=True)
        self.n, self.docs = n, (keys % max(n, 1)).astype(np.int64)
        terms = keys // max(n, 1)
        self.terms, starts, df = np.unique(terms, return_index=True, return_counts=True)
        self.starts, self.df = starts, df
        mean = max(1.0, lengths.mean()) if n else 1.0
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * lengths / mean)
        self.weights = np.repeat(idf, df) * tf * (k1 + 1) / (tf + norm[self.docs])

    def scores(self, tokens: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, np.unique(tokens))
        size = self.df[at]
        rows = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.docs[rows], weights=self.weights[rows], minlength=self.n)


def pack_shard(items: list[np.ndarray], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers; every item of ``1..capacity`` tokens is in exactly one.

    The longest unused item seeds a container. Its unused neighbours by BM25 fill the window, best first,
    as far as each fits; what no neighbour fits is filled with the longest unused items that do.
    """
    sizes = np.array([len(x) for x in items], dtype=np.int64)
    index = ShardIndex(items)
    by_size = np.lexsort((np.arange(len(items)), -sizes))
    unused = np.ones(len(items), dtype=bool)
    out = []
    for seed in by_size:
        if not unused[seed]:
            continue
        unused[seed] = False
        box, room = [int(seed)], int(capacity - sizes[seed])
        smallest = sizes[unused].min(initial=capacity + 1)
        if room >= smallest:
            scores = index.scores(items[seed])
            near = np.flatnonzero(unused & (scores > 0) & (sizes <= room))
            for i in near[np.lexsort((near, -scores[near]))]:
                if sizes[i] <= room:
                    box.append(int(i))
                    room -= int(sizes[i])
                    unused[i] = False
                    if room < smallest:
                        break
            if room >= smallest:
                for i in by_size[np.searchsorted(-sizes[by_size], -room) :]:
                    if unused[i] and sizes[i] <= room:
                        box.append(int(i))
                        room -= int(sizes[i])
                        unused[i] = False
        out.append(box)
    return out


def _pack(capacity: int, path: str):
    """Containers of the shards of a partition, from rows sorted by shard."""

    def table(shard, docs, starts, items, full, empty):
        rows, number = [], 0
        for box in pack_shard(items, capacity) if items else []:
            rows += [(docs[i], number, place, starts[i], starts[i] + len(items[i])) for place, i in enumerate(box)]
            number += 1
        for doc, start, end in full:
            rows.append((doc, number, 0, start, end))
            number += 1
        last = len(rows)
        rows += [(doc, 0, last + k, 0, 0) for k, doc in enumerate(empty)]
        doc, box, place, start, end = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc, pa.int64()),
                pa.array([f"{shard:09d}-{b:07d}" for b in box], pa.string()),
                pa.array(place, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(end, pa.int64()),
            ],
            names=["doc_id", "container", "place", "token_start", "token_end"],
        )

    def run(batches):
        enc, now, held = encoder(path), None, ([], [], [], [], [])
        for batch in batches:
            for shard, doc, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "text"))):
                if shard != now:
                    if now is not None:
                        yield table(now, *held)
                    now, held = shard, ([], [], [], [], [])
                docs, starts, items, full, empty = held
                tokens = np.array(encode(enc, text), dtype=np.int64)
                if not len(tokens):
                    empty.append(doc)
                    continue
                start = 0
                while len(tokens) - start >= capacity and len(tokens) > capacity:
                    full.append((doc, start, start + capacity))
                    start += capacity
                if start < len(tokens):
                    docs.append(doc)
                    starts.append(start)
                    items.append(tokens[start:])
        if now is not None:
            yield table(now, *held)

    return run


def pack_texts(documents: DataFrame, capacity: int = 2048, shard_rows: int = 4000, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, container, place, token_start, token_end``: every text in containers of ``capacity`` tokens.

    Texts are sharded by a lexical signature (the smallest hash of their words), so that shards of about ``shard_rows``
    rows hold alike texts; a signature with very many texts (see :func:`heavy_codes`) is spread in as many parts as its
    own count asks for. Each shard packs its items, in the order of signature, id and text, with its own BM25 index,
    so the same rows give the same containers. A text longer than ``capacity`` is cut into full containers and a rest,
    which is packed like a short text; no other text is cut. Null and empty texts have no tokens and lie
    in the first container of their shard with the range 0 to 0. Rows with a null ``doc_id`` are left out;
    repeated rows are packed as often as they occur; other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    words = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.xxhash64(w))
    rows = rows.withColumn("signature", F.array_min(words))
    n, heavy = heavy_codes(rows, "signature", share=1 / 1024)
    spark, shards = documents.sparkSession, pieces(n, shard_rows)
    ship(spark, path)
    # Parts of a 32nd of a shard keep the shards of nearly equal size.
    part_rows = max(1, shard_rows // 32)
    wide = [(code, pieces(count, part_rows)) for code, count in heavy.items() if count > part_rows]
    part = F.lit(0).cast("long")
    if wide:
        # At most 2 048 rows, one for each heavy signature.
        widths = F.broadcast(spark.createDataFrame(wide, "code long, width int"))
        rows = rows.join(widths, F.xxhash64("signature") == F.col("code"), "left")
        part = F.when(F.col("width").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("width"))).otherwise(part)
    rows = rows.select("doc_id", "text", "signature", F.pmod(F.xxhash64("signature", part), F.lit(shards)).alias("shard"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, pieces(shards, 8))
    sharded = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "signature", "doc_id", F.xxhash64("text"))
    return sharded.select("shard", "doc_id", "text").mapInArrow(_pack(capacity, path), "doc_id long, container string, place int, token_start long, token_end long")


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Containers, tokens, and the share of the containers' capacity that is used."""
    boxes = packed.groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.count(F.lit(1)).alias("n_items"))
    return boxes.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("n_items").alias("n_items"),
        F.sum("tokens").alias("n_tokens"),
        F.max("tokens").alias("fullest"),
        F.round(F.sum("tokens") / (F.count(F.lit(1)) * F.lit(capacity)), 6).alias("fill"),
    )
