"""Most similar vectors for every vector, by collision counting over sorted single projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.operators.skew import hot_split_join
from recallgrid.session import cut_lineage, numbered, pieces

#: Half a window's width against the radius it is to catch, and queries of a cell that are counted at a time.
WINDOW, COUNTED_ROWS = 1.5, 128
#: Rows of a block's products, pairs kept until the best are taken, and twice the error of a product in single precision.
ASKED_ROWS, TARGET_ROWS, MOST_WAITING, MARGIN = 256, 4_096, 2_000_000, np.float32(1e-5)


def _unit_rows(dim: int):
    """Rows whose vector has ``dim`` finite values, not all zero, scaled to length 1."""

    def run(batches):
        for batch in batches:
            vec = batch.column("vec")
            long_enough = pc.equal(pc.list_value_length(vec), dim).fill_null(False)
            batch = batch.filter(long_enough)
            if not batch.num_rows:
                continue
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = x[good] / np.abs(x[good]).max(axis=1, keepdims=True, initial=0)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            offsets = pa.array(np.arange(0, len(x) * dim + 1, dim, dtype=np.int32))
            unit = pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good)), unit], names=["id", "vec"])

    return run


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id, vec``: unit vectors of the rows with ``dim`` finite values, not all zero; one row per id.

    Of an id's differing usable vectors the smallest (as an array) stands for it.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).filter("id is not null and vec is not null")
    return rows.mapInArrow(_unit_rows(dim), "id string, vec array<float>").groupBy("id").agg(F.min("vec").alias("vec"))


def fit_pivots(sample: np.ndarray, cells: int, rounds: int = 3, seed: int = 7) -> np.ndarray:
    """Unit pivots: rows of the sample, drawn and then moved to the mean of the rows nearest to them."""
    rng = np.random.default_rng(seed)
    pivots = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[s : s + 1000] @ pivots.T).argmax(axis=1) for s in range(0, len(sample), 1000)])
        order = np.argsort(nearest, kind="stable")
        starts = np.searchsorted(nearest[order], np.arange(len(pivots)))
        there = np.diff(np.append(starts, len(order))) > 0
        sums = np.add.reduceat(sample[order], starts[there], axis=0)
        pivots[there] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return pivots


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1)


def fit_cells(sample: np.ndarray, cells: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pivots in two levels, about the square root of ``cells`` above and as many as ``cells`` below, so that a
    vector meets few of them however many there are."""
    above = fit_pivots(sample, max(1, math.isqrt(cells)))
    nearest = np.concatenate([(sample[s : s + 4096] @ above.T).argmax(axis=1) for s in range(0, len(sample), 4096)])
    below = [sample[nearest == t] for t in range(len(above))]
    return above, [fit_pivots(own, max(1, round(cells * len(own) / len(sample)))) if len(own) else above[t : t + 1] for t, own in enumerate(below)]


def place_in_cells(x: np.ndarray, above: np.ndarray, below: list[np.ndarray], probes: int, tops: int) -> np.ndarray:
    """The ``probes`` cells with the pivots most similar to each row, looked for under its ``tops`` best upper pivots; -1 for none."""
    first = np.cumsum([0, *[len(b) for b in below]])
    tops = min(tops, len(above))
    scores = x @ above.T
    best = np.argpartition(-scores, tops - 1, axis=1)[:, :tops]
    similar = np.full((len(x), tops, probes), -np.inf, dtype=np.float32)
    cell = np.full((len(x), tops, probes), -1, dtype=np.int64)
    row, at = np.divmod(np.argsort(best, axis=None, kind="stable"), tops)
    cuts = np.searchsorted(best[row, at], np.arange(len(above) + 1))
    for t, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
        if s == e:
            continue
        inner = x[row[s:e]] @ below[t].T
        keep = min(probes, inner.shape[1])
        near = np.argpartition(-inner, keep - 1, axis=1)[:, :keep]
        similar[row[s:e], at[s:e], :keep] = np.take_along_axis(inner, near, axis=1)
        cell[row[s:e], at[s:e], :keep] = near + first[t]
    similar, cell = similar.reshape(len(x), -1), cell.reshape(len(x), -1)
    return np.take_along_axis(cell, np.argpartition(-similar, probes - 1, axis=1)[:, :probes], axis=1)


def _assign(shared, probes: int, tops: int):
    """Each vector once for each of its cells."""

    def run(batches):
        above, below = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = place_in_cells(_matrix(batch.column("vec")), above, below, probes, tops)
            row, at = np.nonzero(cell >= 0)
            rows = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(cell[row, at].astype(np.int32)), rows.column("id"), rows.column("vec")], names=["cell", "id", "vec"])

    return run


def collision_candidates(x: np.ndarray, directions: np.ndarray, width: float, threshold: int, k: int, levels: int = 2, verify=None):
    """Pairs ``i < j`` of rows that collide on at least ``threshold`` projections, with their distances.

    Every projection is one sorted array; the window centred on a query is a range of its ranks, and a row collides if its
    rank lies there. A level's windows are twice as wide as the level before (virtual rehashing: the arrays
    stay, only the windows grow). Collisions are counted for ``COUNTED_ROWS`` queries at a time, so memory grows with the
    rows and not with their square. ``verify(i, j)`` returns the distances. A level's radius is its half window over
    ``WINDOW``; the search ends early if every row has ``k`` verified neighbours nearer than that.
    """
    n, m = len(x), directions.shape[1]
    projected = np.ascontiguousarray((x @ directions).T)
    order = np.argsort(projected, axis=1)
    values = np.take_along_axis(projected, order, axis=1)
    small = np.uint16 if n < 65_536 else np.uint32
    rank = np.empty((m, n), dtype=small)
    np.put_along_axis(rank, order, np.arange(n, dtype=small)[None, :], axis=1)
    for level in range(levels):
        half = width / 2 ** (levels - 1 - level)
        # Ends of the windows, for the sorted queries first: neighbouring searches are quick.
        low, high = np.empty((m, n), dtype=small), np.empty((m, n), dtype=small)
        for d in range(m):
            low[d, order[d]] = np.searchsorted(values[d], values[d] - half)
            high[d, order[d]] = np.searchsorted(values[d], values[d] + half, side="right")
        reach, found = high - low, []
        for s in range(0, n, COUNTED_ROWS):
            own = slice(s, min(n, s + COUNTED_ROWS))
            count = np.zeros((own.stop - s, n - s), dtype=np.uint8)
            offset, inside = np.empty(count.shape, dtype=small), np.empty(count.shape, dtype=bool)
            for d in range(m):
                # Unsigned, so that a rank below the window wraps to a large number.
                np.subtract(rank[d, None, s:], low[d, own, None], out=offset)
                np.less(offset, reach[d, own, None], out=inside)
                np.add(count, inside.view(np.uint8), out=count)
            i, j = np.nonzero(count >= threshold)
            i, j = i[j > i] + s, j[j > i] + s
            found.append((i, j, verify(i, j)))
            # Pairs at the level's radius collide on all but a few projections of the window around it.
            near = found[-1][2] <= half / WINDOW
            if s == 0 and level < levels - 1 and (n <= k or np.bincount(np.concatenate([i[near], j[near]]), minlength=n)[: own.stop].min() < k):
                break  # These rows have met all others and lack neighbours: on to wider windows.
        else:
            i, j, distance = (np.concatenate(c) for c in zip(*found))
            near = distance <= half / WINDOW
            if np.bincount(np.concatenate([i[near], j[near]]), minlength=n).min() >= k:
                break
    return i, j, distance


def _directions(dim: int, projections: int, seed: int = 11) -> np.ndarray:
    """Random directions at right angles to each other (as far as ``dim`` allows), of the length of normal ones."""
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-projections // dim))]
    return (np.concatenate(parts, axis=1)[:, :projections] * math.sqrt(dim)).astype(np.float32)


def _search_cells(min_similarity: float, k: int, projections: int, width: float, threshold: int):
    """The ``k`` most similar vectors of each vector of a cell (or of a pair of a large cell's blocks), from rows
    sorted by cell. A pair may come out of each cell that both share."""

    def best_of(key, ids, blocks, x):
        def verify(i, j):
            similarity = np.empty(len(i), dtype=np.float64)
            for s in range(0, len(i), 100_000):
                e = slice(s, s + 100_000)
                similarity[e] = np.einsum("ij,ij->i", x[i[e]], x[j[e]], dtype=np.float64)
            return np.sqrt(np.maximum(0.0, 2 - 2 * similarity))

        i, j, distance = collision_candidates(x, _directions(x.shape[1], projections), width, threshold, k, verify=verify)
        similarity = 1 - distance**2 / 2
        own = similarity >= min_similarity
        if key[1] != key[2]:
            own &= blocks[i] != blocks[j]
        i, j, similarity = i[own], j[own], similarity[own]
        src, dst, both = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([similarity, similarity])
        place = np.empty(len(ids), dtype=np.int64)
        place[np.argsort(np.array(ids, dtype=object), kind="stable")] = np.arange(len(ids))
        order = np.lexsort((place[dst], -both, src))
        src, dst, both = src[order], dst[order], both[order]
        top = np.arange(len(src)) - np.searchsorted(src, src) < k
        return [(ids[a], ids[b], s) for a, b, s in zip(src[top].tolist(), dst[top].tolist(), both[top].tolist())]

    def table(rows):
        cols = list(zip(*rows)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["id", "other", "similarity"])

    def run(batches):
        key, ids, parts = None, [], []

        def close():
            if len(ids) < 2:
                return []
            x, blocks = (np.concatenate(c) for c in zip(*parts))
            return best_of(key, ids, blocks, x)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "p", "q")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(keys)]])
            x, names = _matrix(batch.column("vec")), batch.column("id").to_pylist()
            block = batch.column("block").to_numpy()
            for s, e in zip(cuts[:-1], cuts[1:]):
                k_now = tuple(keys[s].tolist())
                if k_now != key:
                    if rows := close():
                        yield table(rows)
                    key, ids, parts = k_now, [], []
                ids += names[s:e]
                parts.append((x[s:e], block[s:e]))
        yield table(close())

    return run


def cell_neighbours(
    unit: DataFrame,
    min_similarity: float,
    k: int = 5,
    rows_per_cell: int = 100,
    probes: int = 5,
    tops: int = 9,
    sample_rows: int = 400_000,
    max_cell_rows: int = 3_000,
    projections: int = 24,
    threshold: int = 18,
) -> DataFrame:
    """``id, other, similarity``: of the rows ``id, vec`` with a cosine of ``min_similarity`` or more, at least
    the ``k`` most similar ones of each row.

    Windows over the whole table would hold a fixed share of all rows, so the table is first cut into cells of about
    ``rows_per_cell`` rows: every vector goes to the ``probes`` cells with the most similar pivots (found under its ``tops`` best pivots of the upper level). The pivots are fitted
    on 16 rows for each cell, chosen by hash, but no more than about ``sample_rows``, which bounds the cells to half
    as many; every row is indexed. Inside a cell, collision counting
    proposes pairs (see :func:`collision_candidates`), and their cosine is computed exactly. A cell with
    more than about ``max_cell_rows`` rows (as the sample shows) is cut into blocks, whose pairs are searched one by one, so no
    row is left out. A cell passes on each row's best ``k`` only, so a dense group doesn't emit all its pairs.
    """
    spark, n = unit.sparkSession, unit.count()
    if n == 0:
        return unit.select("id", F.col("id").alias("other"), F.lit(0.0).alias("similarity"))
    cells = min(sample_rows // 2, pieces(n, rows_per_cell))
    buckets = pieces(n, min(sample_rows, max(2_000, 16 * cells)))
    chosen = unit.filter(F.pmod(F.xxhash64("id"), F.lit(buckets)) == 0).select("vec").limit(2 * sample_rows).toArrow()
    if not chosen.num_rows:
        chosen = unit.select("vec").limit(1).toArrow()
    sample = _matrix(chosen.column("vec").combine_chunks())
    above, below = fit_cells(sample, cells)
    shared = spark.sparkContext.broadcast((above, below))
    each = unit.mapInArrow(_assign(shared, probes, tops), "cell int, id string, vec array<float>")
    # The sample tells which cells are large: at most as many rows as cells.
    placed = np.concatenate([place_in_cells(sample[s : s + 10_000], above, below, probes, tops) for s in range(0, len(sample), 10_000)])
    rows = np.bincount(placed[placed >= 0]) * (n / len(sample))
    wide = [(int(c), math.ceil(rows[c] * 2 / max_cell_rows)) for c in np.flatnonzero(rows > max_cell_rows)]
    each = each.withColumn("blocks", F.lit(1))
    if wide:
        each = each.drop("blocks").join(F.broadcast(spark.createDataFrame(wide, "cell int, blocks int")), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    each = each.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("cell", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "vec")
    width = max(0.05, WINDOW * math.sqrt(2 - 2 * min_similarity))
    search = _search_cells(min_similarity, k, projections, width, threshold)
    parts = max(2 * spark.sparkContext.defaultParallelism, pieces(n, 10_000))
    found = each.repartition(parts, "cell", "p", "q").sortWithinPartitions("cell", "p", "q").mapInArrow(search, "id string, other string, similarity double")
    return found.groupBy("id", "other").agg(F.max("similarity").alias("similarity"))


def _search_all(k: int):
    """``seq, other, similarity``: the ``k`` most similar targets of each asked row, from rows sorted so that those
    asked come first in a block. A product in single precision finds what may be among the best; its similarity
    is then computed exactly. Of equal ones the smaller ``seq`` is taken."""

    def best(i, j, similarity):
        order = np.lexsort((j, -similarity, i))
        i, j, similarity = i[order], j[order], similarity[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[top], j[top], similarity[top]

    class Block:
        def __init__(self, seq, x):
            self.seq, self.x, self.least = seq, x, np.full(len(seq), -np.inf, dtype=np.float32)
            self.found, self.waiting = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), []
            self.held = 0

        def settle(self):
            self.found = best(*(np.concatenate(c) for c in zip(self.found, *self.waiting)))
            self.waiting, self.held = [], 0
            i, _, similarity = self.found
            last = np.searchsorted(i, np.arange(len(self.seq)), side="right") - 1
            full = np.bincount(i, minlength=len(self.seq)) >= k
            self.least[full] = np.maximum(self.least[full], similarity[last[full]].astype(np.float32))

        def meet(self, seq, x):
            for s in range(0, len(self.seq), ASKED_ROWS):
                scores = self.x[s : s + ASKED_ROWS] @ x.T
                least = self.least[s : s + ASKED_ROWS]
                if len(seq) > k and np.isneginf(least).any():
                    # One of the best k + 1 may be the row itself.
                    np.maximum(least, np.partition(scores, len(seq) - k - 1, axis=1)[:, len(seq) - k - 1], out=least)
                hit = np.flatnonzero(scores >= (least - MARGIN)[:, None])
                i, j = hit // len(seq) + s, hit % len(seq)
                other = self.seq[i] != seq[j]
                i, j = i[other], j[other]
                similarity = np.empty(len(i))
                for a in range(0, len(i), 100_000):
                    e = slice(a, a + 100_000)
                    similarity[e] = np.einsum("ij,ij->i", self.x[i[e]], x[j[e]], dtype=np.float64)
                self.waiting.append((i, seq[j], similarity))
                self.held += len(i)
                if self.held > MOST_WAITING:
                    self.settle()

        def rows(self):
            self.settle()
            i, j, similarity = self.found
            return pa.RecordBatch.from_arrays([pa.array(self.seq[i]), pa.array(j), pa.array(similarity)], names=["seq", "other", "similarity"])

    def run(batches):
        block, number, asked, targets = None, None, [], []

        def joined(parts):
            return tuple(np.concatenate(c) for c in zip(*parts))

        def meet():
            nonlocal block, asked, targets
            if asked:
                block, asked = Block(*joined(asked)), []
            if targets and block is not None:
                block.meet(*joined(targets))
            targets = []

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "target")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(keys)]])
            x, seq = _matrix(batch.column("vec")), batch.column("seq").to_numpy()
            for s, e in zip(cuts[:-1], cuts[1:]):
                if keys[s, 0] != number:
                    meet()
                    if block is not None:
                        yield block.rows()
                    block, number = None, keys[s, 0]
                (targets if keys[s, 1] else asked).append((seq[s:e], x[s:e]))
                if sum(len(t[0]) for t in targets) >= TARGET_ROWS:
                    meet()
        meet()
        if block is not None:
            yield block.rows()

    return run


def all_neighbours(unit: DataFrame, k: int = 5, block_rows: int = 25_000) -> DataFrame:
    """``id, other, similarity``: the ``k`` most similar other rows of each of the rows ``id, vec``, however far.

    Exact, by the blocked product of all rows with all rows: each block of about ``block_rows`` rows is held by
    a task that streams the whole table past it. Work grows with the square of the rows.
    """
    rows = cut_lineage(numbered(unit, "id"))
    n = rows.count()
    blocks = max(pieces(n, block_rows), min(unit.sparkSession.sparkContext.defaultParallelism, pieces(n, 500)))
    asked = rows.select(F.pmod("seq", F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("target"), "seq", "vec")
    targets = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("target"), "seq", "vec")
    meeting = asked.unionByName(targets).repartitionById(blocks, "block").sortWithinPartitions("block", "target")
    found = meeting.mapInArrow(_search_all(k), "seq long, other long, similarity double")
    found = found.join(rows.select("seq", "id"), "seq")
    return found.join(rows.select(F.col("seq").alias("other"), F.col("id").alias("name")), "other").select("id", F.col("name").alias("other"), "similarity")


def nearest_neighbours(vectors: DataFrame, id_col: str, vec_col: str, dim: int, min_similarity: float | None, k: int = 5, **search) -> DataFrame:
    """``id, neighbour, similarity, place``: the ``k`` most similar vectors of other ids for each id.

    Only vectors with ``dim`` finite values, not all zero, take part, one per id; only neighbours with a
    cosine of ``min_similarity`` or more come out, of equal ones the smaller id first. Without a
    ``min_similarity`` every id gets its ``k`` neighbours, by :func:`all_neighbours`. Equal vectors are
    searched once: their ids are each other's neighbours with similarity 1, and they share the
    neighbours of the one that stands for them. An empty table gives no rows.
    """
    unit = cut_lineage(usable_vectors(vectors, id_col, vec_col, dim).withColumns({"h": F.xxhash64("vec"), "h2": F.hash("vec")}))
    # Equal vectors are told by 96 bits of hashes.
    heads = cut_lineage(unit.groupBy("h", "h2", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    single = heads.select("id", "vec")
    both = (all_neighbours(single, k, **search) if min_similarity is None else cell_neighbours(single, min_similarity, k, **search)).withColumnRenamed("id", "rep")
    best = Window.partitionBy("rep").orderBy(F.col("similarity").desc(), "other")
    links = cut_lineage(both.withColumn("i", F.row_number().over(best)).filter(F.col("i") <= k).drop("i"))
    # Groups of equal vectors: all members, and the first few that can be anybody's neighbours.
    groups = heads.filter("n > 1").select("h", F.col("h2").alias("same"), F.col("id").alias("rep"), "n")
    members = cut_lineage(hot_split_join(unit.select("id", "h", "h2"), groups, "h").filter("h2 = same").select("rep", "id", "n"))
    in_group = Window.partitionBy("rep").orderBy("id")
    firsts = members.withColumn("i", F.row_number().over(in_group)).filter(F.col("i") <= k + 1).groupBy("rep").agg(F.collect_list("id").alias("firsts"))
    copies = hot_split_join(members.select("rep", "id"), firsts, "rep").select("id", F.explode("firsts").alias("neighbour"), F.lit(1.0).alias("similarity")).filter("id <> neighbour")
    small = members.filter(F.col("n") <= k).select("rep", "id")
    sources = links.join(small, "rep", "left").withColumn("id", F.coalesce("id", "rep")).join(groups.filter(F.col("n") > k).select("rep"), "rep", "left_anti")
    across = sources.join(firsts.select(F.col("rep").alias("other"), "firsts"), "other", "left").select("id", F.explode(F.coalesce("firsts", F.array("other"))).alias("neighbour"), "similarity")
    order = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")
    return copies.unionByName(across).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
