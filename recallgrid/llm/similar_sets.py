"""All pairs of similar sets, by T-occurrence merging of partitioned inverted lists."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.skew import hot_split_join
from recallgrid.session import cut_lineage

_EPS = 1e-9


def needed_overlap(a: int, b: int, threshold: float) -> int:
    return math.ceil(threshold / (1 + threshold) * (a + b) - _EPS)


def t_occurrences(lists: list[list[int]], need: int):
    """Yield ``(record, count)`` of the records found in at least ``need`` of the sorted lists.

    The longest lists are set apart. The others are merged by a heap; where the smallest record can't
    reach the bound, just enough list heads are popped that the next one is the first which still can, and
    the popped lists skip to it by binary search. What the merge leaves is looked up in the long lists.
    """
    lists = sorted((x for x in lists if x), key=len)
    apart = min(need - 1, len(lists) // 2)
    if len(lists) < need:
        return
    short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
    low = need - apart
    heap = [(x[0], i) for i, x in enumerate(short)]
    heapq.heapify(heap)
    at = [0] * len(short)
    while len(heap) >= low:
        value = heap[0][0]
        popped = []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= low:
            count = len(popped)
            for x in long:
                k = bisect_left(x, value)
                count += k < len(x) and x[k] == value
            if count >= need:
                yield value, count
            for i in popped:
                at[i] += 1
                if at[i] < len(short[i]):
                    heapq.heappush(heap, (short[i][at[i]], i))
            continue
        while heap and len(popped) < low - 1:
            popped.append(heapq.heappop(heap)[1])
        if not heap:
            return
        to = heap[0][0]
        for i in popped:
            at[i] = bisect_left(short[i], to, at[i])
            if at[i] < len(short[i]):
                heapq.heappush(heap, (short[i][at[i]], i))


def join_group(token: int, group: list[tuple], threshold: float, blocks: bool):
    """Similar pairs of a group whose records all have ``token`` in their prefix.

    A record is ``(id, block, items)`` with the items in the global order. With ``blocks``, only pairs of
    records from different blocks are wanted, and a record is looked up in the other block's lists alone. A pair is
    emitted by the group of its first common item only.
    """
    if len(group) < 2:
        return
    group.sort(key=lambda r: (len(r[2]), r[0]))
    sizes = [len(r[2]) for r in group]
    lists_of: dict[int, dict[int, list[int]]] = {}
    for i, record in enumerate(group):
        index = lists_of.setdefault(record[1] if blocks else 0, {})
        for x in record[2]:
            index.setdefault(x, []).append(i)
    for i, (name, block, items) in enumerate(group):
        smallest = math.ceil(threshold * len(items) - _EPS)
        start = bisect_left(sizes, smallest)
        if start >= i:
            continue
        need = needed_overlap(len(items), smallest, threshold)
        index = lists_of[0] if not blocks else next((lists for b, lists in lists_of.items() if b != block), {})
        lists = []
        for x in items:
            full = index.get(x, [])
            lists.append(full[bisect_left(full, start) : bisect_left(full, i)])
        for j, shared in t_occurrences(lists, need):
            other, _, other_items = group[j]
            if shared < needed_overlap(len(items), len(other_items), threshold):
                continue
            there = set(other_items)
            if next(x for x in items if x in there) == token:
                yield name, other, shared, len(items) + len(other_items) - shared


def _join_partitions(threshold: float):
    def run(batches):
        key, group = None, []

        def close():
            pairs = join_group(key[0], group, threshold, key[1] != key[2]) if key is not None else iter(())
            while out := list(islice(pairs, 10_000)):
                yield table(out)

        def table(out):
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                names=["a", "b", "shared", "joint"],
            )

        for batch in batches:
            keys = zip(batch.column("token").to_pylist(), batch.column("p").to_pylist(), batch.column("q").to_pylist())
            for k, name, block, items in zip(keys, batch.column("rep").to_pylist(), batch.column("block").to_pylist(), batch.column("items").to_pylist()):
                if k != key:
                    yield from close()
                    key, group = k, []
                group.append((name, block, items))
        yield from close()

    return run


def item_sets(records: DataFrame, id_col: str, items_col: str, normal, min_size: int) -> DataFrame:
    """``id, items``: the distinct normalised items, sorted; records with fewer than ``min_size`` are left out."""
    items = F.array_sort(F.array_distinct(F.filter(F.transform(F.col(items_col), normal), lambda x: x.isNotNull())))
    return records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), items.alias("items")).filter(F.size("items") >= min_size)


def set_classes(sets: DataFrame) -> DataFrame:
    """``id, rep, items``: each record with the representative (smallest id) of its equal sets."""
    heads = sets.groupBy("items").agg(F.min("id").alias("rep"))
    return hot_split_join(sets, heads, "items")


def similar_representatives(classes: DataFrame, threshold: float, block_rows: int = 4000) -> DataFrame:
    """``a, b, shared, joint``: pairs of class representatives with ``shared / joint >= threshold``.

    Items are ordered from rare to frequent. Two sets can only be similar if they share one of their first
    few items, so each set goes to the inverted lists of these; a partition of lists merges them with
    :func:`t_occurrences`. The lists of an item on more than ``block_rows`` sets are cut into blocks whose
    pairs are separate groups. Items travel as 64-bit hashes.
    """
    reps = classes.filter("id = rep").select("rep", F.explode("items").alias("item"))
    counts = reps.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    coded = hot_split_join(reps, counts, "item").select("rep", "df", F.xxhash64("item").alias("h"))
    ordered = coded.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))
    ordered = ordered.withColumn("keep", F.size("o") - F.ceil(F.size("o") * F.lit(threshold) - _EPS) + 1)
    probes = ordered.select("rep", F.transform("o", lambda x: x["h"]).alias("items"), F.explode(F.slice("o", F.lit(1), F.col("keep").cast("int"))).alias("first"))
    blocks = F.ceil(F.col("first.df") / block_rows).cast("int")
    probes = probes.filter("first.df > 1").select("rep", "items", F.col("first.h").alias("token"), blocks.alias("blocks"))
    probes = probes.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    probes = probes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    probes = probes.select("token", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "rep", "items")
    grouped = probes.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q")
    found = grouped.mapInArrow(_join_partitions(threshold), "a string, b string, shared int, joint int")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "joint")


def similar_sets(records: DataFrame, id_col: str, items_col: str, normal, threshold: float = 0.7, min_size: int = 4):
    """Classes of equal sets and the similar pairs of their representatives, as two DataFrames.

    ``normal`` maps an item column to its normal form (null to drop it). Null and repeated items don't
    count; null or short item lists are left out, as are null ids. Together the two results hold every
    pair with a Jaccard similarity of ``threshold`` or more.
    """
    classes = cut_lineage(set_classes(item_sets(records, id_col, items_col, normal, min_size)))
    return classes.select("id", "rep"), similar_representatives(classes, threshold)


def expand_pairs(members: DataFrame, pairs: DataFrame, chunk_rows: int = 1000) -> DataFrame:
    """``node_a, node_b, similarity``: all pairs of records, from representatives and membership.

    A class of more than ``chunk_rows`` equal sets is cut into chunks by a hash of the record; the pairs of each two
    chunks are made by separate tasks.
    """
    sizes = cut_lineage(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / chunk_rows).cast("int")))
    chunked = cut_lineage(hot_split_join(members, sizes.select("rep", "chunks", "n"), "rep").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")))
    counts = sizes.select("rep", "chunks")
    numbers = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    wanted = pairs.select("a", "b", (F.col("shared") / F.col("joint")).alias("similarity"))
    wanted = wanted.join(counts.select(F.col("rep").alias("a"), "chunks"), "a").withColumn("p", numbers).drop("chunks")
    wanted = wanted.join(counts.select(F.col("rep").alias("b"), "chunks"), "b").withColumn("q", numbers).drop("chunks")
    left = chunked.select(F.col("rep").alias("a"), F.col("chunk").alias("p"), F.col("id").alias("x"))
    right = chunked.select(F.col("rep").alias("b"), F.col("chunk").alias("q"), F.col("id").alias("y"))
    across = wanted.join(left, ["a", "p"]).join(right, ["b", "q"]).select("x", "y", "similarity")
    several = chunked.filter("n > 1")
    one = several.select("rep", F.col("chunk").alias("p"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("q"), F.col("id").alias("x"))
    two = several.select("rep", F.explode(F.sequence(F.lit(0), "chunk")).alias("p"), F.col("chunk").alias("q"), F.col("id").alias("y"))
    same = one.join(two, ["rep", "p", "q"]).filter("p < q or x < y")
    both = across.unionByName(same.select("x", "y", F.lit(1.0).alias("similarity")))
    return both.select(F.least("x", "y").alias("node_a"), F.greatest("x", "y").alias("node_b"), "similarity")
