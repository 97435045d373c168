"""Typed edges, adjacency, and personalised PageRank for batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.session import cut_lineage, numbered, pieces

LINK, TAG, KNN, COACCESS = 0, 1, 2, 3
WEEK = 7 * 86400.0
#: Edges of a type that are sent to every task.
LOCAL_EDGES = 4_000_000
#: A query whose reach has no more than this share of a type's edges walks on its own; the others share a matrix of so many bytes.
NEAR_SHARE, BLOCK_BYTES = 0.1, 130_000_000
#: Rows of that matrix that are taken at a time; edges of a node that is taken by itself; rows whose largest value is kept.
ROWS_AT_ONCE, HUB_EDGES, GROUP_ROWS = 1_024, 64, 256
#: Kinds of factors by which the matrix's rows are ordered, at most.
ALIKE = 256
#: Walks of more queries than this go by hubs where most reach far: at most so many nodes of more edges than that. The reach of
#: a query's seeds and of its candidates beside the hubs is this share of the edges at most, and candidates are so many at most; else the query shares the matrix.
FEW_QUERIES, HUBS, HUB_REACH, HUB_SHARE, HUB_POOL = 32, 32, 256, 0.2, 4_096
#: Seeds that a task holds, about.
SEEDS_AT_ONCE = 20_000


def tag_edges(nodes: DataFrame, fanout: int = 6, common_share: float = 0.30, common_least: int = 40, chunk_rows: int = 1_000_000) -> DataFrame:
    """``src, dst, w`` between ``nodes(seq, node_id, tags)`` and earlier nodes with a common tag.

    ``seq`` numbers the nodes from 0 in insertion order. A tag counts for a node if at least 2 earlier nodes
    have it but no more than the larger of ``common_least`` and the share ``common_share`` of them. It links
    the last ``fanout`` of these with half its inverse frequency; the best ``2 * fanout`` links stay. A tag's
    nodes are taken in chunks of the insertion order; of the chunks before its own, a node needs only their
    number of nodes and their last few, so a tag on a third of all nodes is no single task.
    """
    tagged = nodes.filter("tags is not null").select("seq", "node_id", F.explode(F.array_distinct("tags")).alias("tag")).filter("tag is not null")
    tagged = tagged.withColumn("chunk", F.floor(F.col("seq") / chunk_rows))
    in_chunk = Window.partitionBy("tag", "chunk").orderBy("seq")
    rows = tagged.select(
        "tag", "chunk", "seq", "node_id",
        (F.row_number().over(in_chunk) - 1).alias("place"),
        F.collect_list("node_id").over(in_chunk.rowsBetween(-fanout, -1)).alias("near"),
        F.collect_list("node_id").over(in_chunk.rowsBetween(1 - fanout, 0)).alias("tail"),
    )
    ends = rows.groupBy("tag", "chunk").agg(F.count(F.lit(1)).alias("n"), F.max_by("tail", "seq").alias("tail"))
    before = Window.partitionBy("tag").orderBy("chunk")
    # Every chunk listed holds a node, so the last ``fanout`` chunks hold the last ``fanout`` nodes.
    ends = ends.select("tag", "chunk", (F.sum("n").over(before) - F.col("n")).alias("df_before"), F.flatten(F.collect_list("tail").over(before.rowsBetween(-fanout, -1))).alias("far"))
    framed = rows.join(ends, ["tag", "chunk"]).select("seq", "node_id", (F.col("df_before") + F.col("place")).alias("df"), F.concat("far", "near").alias("all"))
    framed = framed.withColumn("mates", F.slice("all", F.greatest(F.lit(1), F.size("all") - fanout + 1), F.lit(fanout)))
    n = F.greatest(F.lit(1), F.col("seq"))
    counted = framed.filter((F.col("df") >= 2) & (F.col("df") <= F.greatest(F.lit(common_least), F.floor(n * common_share))))
    links = counted.select(F.col("node_id").alias("src"), F.explode("mates").alias("dst"), (0.5 * F.log(1 + n / F.col("df"))).alias("w"))
    best = links.groupBy("src", "dst").agg(F.max("w").alias("w"))
    order = Window.partitionBy("src").orderBy(F.round("w", 9).desc(), "dst")
    return best.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= 2 * fanout).drop("i")


def latest_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, etype), the one with the newest ``updated`` (then the larger ``w``); rows without
    a key or weight, and repeats, are left out."""
    rows = edges.filter("src is not null and dst is not null and etype is not null and w is not null and not isnan(w)")
    newest = F.max(F.struct("updated", "w")).alias("m")
    return rows.groupBy("src", "dst", "etype").agg(newest).select("src", "dst", "etype", "m.w", "m.updated")


def symmetric_links(edges: DataFrame) -> DataFrame:
    """Links in both directions; of a mutual pair the larger weight holds, once."""
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w"))


def adjacency(edges: DataFrame, now: float, decay: float = 0.9) -> DataFrame:
    """``etype, src, dst, p``: transition shares per type; co-access decays by the week, links go both ways,
    weights of 0 or less are left out."""
    weeks = F.greatest(F.lit(0.0), (F.lit(now) - F.col("updated")) / WEEK)
    co = edges.filter(F.col("etype") == COACCESS).select("etype", "src", "dst", (F.col("w") * F.pow(F.lit(decay), weeks)).alias("w"))
    link = symmetric_links(edges.filter(F.col("etype") == LINK)).select(F.lit(LINK).alias("etype"), "src", "dst", "w")
    rest = edges.filter(F.col("etype").isin(TAG, KNN)).select("etype", "src", "dst", "w")
    rows = link.unionByName(rest).unionByName(co).filter("w > 0")
    sums = rows.groupBy("etype", "src").agg(F.sum("w").alias("total"))
    return rows.join(sums, ["etype", "src"]).select("etype", "src", "dst", (F.col("w") / F.col("total")).alias("p"))


def _restart(seeds: DataFrame) -> DataFrame:
    total = Window.partitionBy("qid")
    return seeds.select("qid", "node_id", (F.col("score") / F.sum("score").over(total)).alias("v"))


def pagerank_loop(adj: DataFrame, seeds: DataFrame, alpha: float = 0.5, rounds: int = 20, tolerance: float | None = None, others: int | None = None) -> DataFrame:
    """``qid, etype, node_id, score`` by ``rounds`` joins and sums; for graphs of any size.

    ``seeds(qid, node_id, score)`` restarts each query; mass on nodes without edges goes back to the seeds. With a
    ``tolerance`` a query's walk over a type ends when a round moves less mass than that, as in :func:`pagerank`; ``others``
    is as in :func:`pagerank`. Types without edges give no rows.
    """
    types = adj.select("etype").distinct()
    restart = cut_lineage(_restart(seeds).join(F.broadcast(types)))  # at most a row per edge type
    out = cut_lineage(adj.select("etype", F.col("src").alias("node_id"), "dst", "p"))
    has_out = out.select("etype", "node_id").distinct()
    rank, ended = restart.withColumnRenamed("v", "score"), None
    for i in range(rounds):
        share = rank.withColumn("score", F.col("score") * (1 - alpha))
        moved = share.join(out, ["etype", "node_id"]).select("qid", "etype", F.col("dst").alias("node_id"), (F.col("score") * F.col("p")).alias("score"))
        lost = share.join(has_out, ["etype", "node_id"], "left_anti").groupBy("qid", "etype").agg(F.sum("score").alias("lost"))
        going = rank.select("qid", "etype").distinct()
        back = restart.join(going, ["qid", "etype"], "left_semi").join(lost, ["qid", "etype"], "left")
        back = back.select("qid", "etype", "node_id", (F.col("v") * (F.lit(alpha) + F.coalesce("lost", F.lit(0.0)))).alias("score"))
        new = moved.unionByName(back).groupBy("qid", "etype", "node_id").agg(F.sum("score").alias("score"))
        if tolerance is None:
            rank = cut_lineage(new) if i % 4 == 3 else new
            continue
        new = cut_lineage(new)
        change = new.unionByName(rank.withColumn("score", -F.col("score"))).groupBy("qid", "etype", "node_id").agg(F.sum("score").alias("d"))
        still = cut_lineage(change.groupBy("qid", "etype").agg(F.sum(F.abs("d")).alias("gap")).filter(F.col("gap") >= tolerance).select("qid", "etype"))
        done = new.join(still, ["qid", "etype"], "left_anti")
        ended = done if ended is None else ended.unionByName(done)
        rank = cut_lineage(new.join(still, ["qid", "etype"], "left_semi"))
        if rank.isEmpty():
            break
    rank = rank if ended is None else rank.unionByName(ended)
    if others is None:
        return rank
    pool = cut_lineage(rank.filter("score > 0"))
    best = expansion(pool, seeds, others).select("qid", "node_id")
    return pool.join(best.unionByName(seeds.select("qid", "node_id").distinct()), ["qid", "node_id"], "left_semi")


def _reach(starts, dst, w, slot, home, rounds: int, most: int):
    """The nodes that ``home`` reaches in so many rounds, by the round that reaches them first, the edges between them as numbers in
    that order, their ``w``, and the nodes that no edge leaves; then the numbers of nodes, edges and such ends up to each round. None
    if more than ``most`` edges are in reach. ``slot`` is a scratch array of -1."""
    levels, fresh, size, edges = [home], home, len(home), 0
    one, two, part, ends = [], [], [], []
    slot[home] = np.arange(size)
    try:
        for _ in range(rounds):
            many = starts[fresh + 1] - starts[fresh]
            count = int(many.sum())
            edges += count
            if edges > most:
                return None
            at = np.repeat(starts[fresh] - np.cumsum(many) + many, many) + np.arange(count)
            to = dst[at]
            new = to[slot[to] < 0]
            slot[new] = np.arange(len(new))
            new = new[slot[new] == np.arange(len(new))]
            slot[new] = size + np.arange(len(new))
            one.append(np.repeat(np.arange(size - len(fresh), size), many))
            two.append(slot[to])
            part.append(w[at])
            ends.append(np.flatnonzero(many == 0) + size - len(fresh))
            if not len(new):
                break
            levels.append(new)
            fresh, size = new, size + len(new)
    finally:
        for level in levels:
            slot[level] = -1
    counts = tuple(np.cumsum([len(x) for x in c]).tolist() for c in (levels, one, ends))
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in (levels, one, two, part, ends)), counts


def _walk_near(starts, dst, w, slot, home, restart, alone: float, alpha: float, rounds: int, tolerance: float | None, most: int):
    """Nodes and masses of one query's power iteration, by the edges in its reach alone, and the share that came back to
    the seeds last; None if more than ``most`` edges are. ``slot`` is a scratch array of -1, ``alone`` the restart of
    seeds outside the graph, ``w`` the shares times ``1 - alpha``."""
    # Nodes and edges by the round that reaches them first; only then are masses moved.
    found = _reach(starts, dst, w, slot, home, rounds, most)
    if found is None:
        return None
    (nodes, one, two, part, ends), (nodes_at, edges_at, ends_at) = found
    mass, back = restart, 1.0
    for i in range(rounds):
        e, n = edges_at[min(i, len(edges_at) - 1)], nodes_at[min(i + 1, len(nodes_at) - 1)]
        lost = (1 - alpha) * (mass[ends[: ends_at[min(i, len(ends_at) - 1)]]].sum() + alone * back)
        after = np.bincount(two[:e], weights=mass[one[:e]] * part[:e], minlength=n).astype(np.float64)
        after[: len(home)] += restart * (alpha + lost)
        gap = 0.0
        if tolerance is not None:
            gap = np.abs(after[: len(mass)] - mass).sum() + after[len(mass) :].sum() + alone * abs(alpha + lost - back)
        mass, back = after, alpha + lost
        if tolerance is not None and gap < tolerance:
            break
    return nodes[: len(mass)], mass, back


def _gathers(src, to, w, size: int):
    """Edges into the rows 0 .. ``size - 1``, which have ever fewer of them: a row's first, second, ... edge as lists of
    their own; rows with many come one by one. Weights that are all 1 are None."""
    by = np.argsort(to, kind="stable")
    src, to, w = src[by], to[by], w[by]
    first = np.searchsorted(to, np.arange(size + 1))
    hubs = int((np.diff(first) > HUB_EDGES).sum())
    single = [(src[first[i] : first[i + 1]], w[first[i] : first[i + 1]]) for i in range(hubs)]
    turn, src, w = (np.arange(len(to)) - first[to])[first[hubs] :], src[first[hubs] :], w[first[hubs] :]
    by = np.argsort(turn, kind="stable")
    cuts = np.searchsorted(turn[by], np.arange(int(turn.max(initial=-1)) + 2))
    lists = [(src[by[x:y]], None if (w[by[x:y]] == 1).all() else w[by[x:y], None]) for x, y in zip(cuts[:-1], cuts[1:])]
    return single, lists


def _gather(gathers, x, held, s: int, e: int):
    """Sums over the edges into the rows ``s`` to ``e``, none of which come one by one; a view of ``held``."""
    out, more = held[0, : e - s], held[1]
    reached = 0
    for k, (src, w) in enumerate(gathers[1]):
        n = min(e, len(src) + len(gathers[0])) - s
        if n <= 0:
            break
        at = s - len(gathers[0])
        part = out[:n] if k == 0 else more[:n]
        np.take(x, src[at : at + n], axis=0, out=part, mode="clip")
        if w is not None:
            part *= w[at : at + n]
        if k:
            out[:n] += part
        else:
            reached = n
    out[reached:] = 0.0
    return out


def _near_order(starts, dst):
    """A place for each node, so that the nodes next to one lie together: by rounds from the largest on."""
    size = len(starts) - 1
    place, first, fresh, count = np.full(size, size), np.empty(size, dtype=np.int64), np.array([np.argmax(np.diff(starts))]), 0
    while len(fresh):
        place[fresh] = count + np.arange(len(fresh))
        count += len(fresh)
        many = starts[fresh + 1] - starts[fresh]
        to = dst[np.repeat(starts[fresh] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        to = to[place[to] == size]
        first[to[::-1]] = np.arange(len(to))[::-1]
        fresh = to[first[to] == np.arange(len(to))]
    return place


class _Wide:
    """A graph for walks of many queries at once.

    Masses are moved between the nodes of a core only. Beside it are leaves (all their edges lead to one node and come
    from it: what they get returns two rounds later), sources (no edge reaches them) and sinks (no edge leaves them): their
    masses follow from the core's and are worked out in the last round. With ``whole``, all nodes are in the core. A node's mass is kept
    times the share of its first edge, so that edges of equal shares need no weights.
    """

    def __init__(self, starts, dst, w, whole: bool = False):
        size, leaving = len(starts) - 1, np.diff(starts)
        src, reached = np.repeat(np.arange(size), leaving), np.bincount(dst, minlength=size)
        self.starts, self.dst, self.w = starts, dst, w
        to, by = np.full(size, -1), np.full(size, -1)
        to[src], by[dst] = dst, src
        leaf = (leaving == 1) & (reached == 1) & (to == by) & (to != np.arange(size))
        leaf &= ~leaf[to]
        leaf &= not whole
        sink, source = ((leaving == 0) & (not whole), (reached == 0) & (leaving > 0) & (not whole))
        self.sink, core = sink, ~(leaf | sink | source)
        self.n = int(core.sum())
        inner = core[src] & core[dst]
        many = np.bincount(dst[inner], minlength=size)
        into = np.where(sink, np.bincount(dst[core[src]], minlength=size), 0)
        scale, returned, given = np.ones(size), np.zeros(size), np.zeros(size)
        has = leaving > 0
        scale[has] = w[starts[:-1][has]]
        given[dst] = w
        at = np.flatnonzero(leaf)
        np.add.at(returned, to[at], given[at] * w[starts[at]])
        # Rows: the core, the sinks, both with the most reached nodes first, then the rest. Nodes that are alike in what they
        # are multiplied by lie together if these are few kinds, and else neighbours near each other.
        alike = [c if len(np.unique(c[core])) <= ALIKE else np.zeros(size) for c in (scale, returned)]
        order = np.lexsort((_near_order(starts, dst), *alike, -into, -many, np.where(core, 0, np.where(sink, 1, 2))))
        self.row = np.empty(size, dtype=np.int64)
        self.row[order] = np.arange(size)
        rows, self.core = self.row, core
        ratio = w / scale[src]
        self.scale, returned = scale[order[: self.n], None], returned[order[: self.n], None]
        self.edges = _gathers(rows[src[inner]], rows[dst[inner]], ratio[inner], self.n)
        outer = core[src] & sink[dst]
        self.sinks = int(sink.sum())
        self.outer = _gathers(rows[src[outer]], rows[dst[outer]] - self.n, ratio[outer], self.sinks)
        #: What a core row loses to sinks, by the mass as it is kept; core rows that are sinks themselves.
        self.to_sinks = np.bincount(rows[src[outer]], weights=ratio[outer], minlength=self.n).astype(np.float64) if self.sinks else None
        self.ends = rows[np.flatnonzero(core & (leaving == 0))]
        self.leaves, self.stems = rows[at], rows[to[at]]
        self.given = (given[at] / scale[to[at]])[:, None]
        # What a core row is multiplied by, and what comes back from its leaves: one number for all rows of a block if it can be.
        one = lambda c: float(c[0, 0]) if (c == c[0, 0]).all() else c
        cuts = [*range(len(self.edges[0]), self.n, ROWS_AT_ONCE), self.n]
        self.blocks = [(s, e, one(self.scale[s:e]), one(returned[s:e])) for s, e in zip(cuts[:-1], cuts[1:])]
        self.returned = returned

    def _seeds(self, homes, restarts):
        """Rows, queries and restarts of the seeds, and where and to whom those outside the core pass theirs on."""
        width = len(homes)
        node = np.concatenate(homes).astype(np.int64)
        query, v = np.repeat(np.arange(width), [len(h) for h in homes]), np.concatenate(restarts)
        out = ~self.core[node]
        many = (self.starts[node + 1] - self.starts[node]) * out
        at = np.repeat(self.starts[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
        place, share = self.row[self.dst[at]] * width + np.repeat(query, many), np.repeat(v, many) * self.w[at]
        place, same = np.unique(place, return_inverse=True)
        share = np.bincount(same, weights=share, minlength=len(place)).astype(np.float64)
        return (self.row[node], query, v, out), (place // width, place % width, share)

    def walk(self, homes, restarts, alone, alpha: float, rounds: int, tolerance: float | None):
        """A matrix of masses with a row for each node and a column for each query, and what came back."""
        n, width, scale = self.n, len(homes), self.scale
        (row, query, v, out), (to, of, share) = self._seeds(homes, restarts)
        full, other = np.zeros((len(self.row), width)), np.zeros((n, width))
        x, old = (full[:n], other) if rounds % 2 == 0 else (other, full[:n])
        inner = ~out
        core, asked, given = row[inner], query[inner], v[inner]
        x[core, asked] = given * scale[core, 0]
        mine = to < n
        total = lambda q, values: np.bincount(q, weights=values, minlength=width)
        own_sinks = total(query[out & (row >= n) & (row < n + self.sinks)], v[out & (row >= n) & (row < n + self.sinks)])
        passed = total(of[~mine], share[~mine])
        into, into_of, into_share = to[mine], of[mine], share[mine]
        back, before, done = np.ones(width), np.zeros(width), np.zeros(width, dtype=bool)
        held = np.empty((2, ROWS_AT_ONCE, width))
        for _ in range(rounds):
            lost = own_sinks * back + passed * before + (x[self.ends].sum(axis=0) if len(self.ends) else 0.0)
            if self.to_sinks is not None:
                lost += self.to_sinks @ old
            new = alpha + (1 - alpha) * (lost + alone * back)
            for h, (src, w) in enumerate(self.edges[0]):
                old[h] = (w @ x[src]) * scale[h] + old[h] * self.returned[h]
            for s, e, factor, returned in self.blocks:
                part = _gather(self.edges, x, held, s, e)
                if isinstance(returned, float) and returned == 0.0:
                    np.multiply(part, factor, out=old[s:e])
                else:
                    part *= factor
                    old[s:e] *= returned
                    old[s:e] += part
            old[core, asked] += given * scale[core, 0] * new[asked]
            old[into, into_of] += into_share * scale[into, 0] * back[into_of]
            if tolerance is not None:
                gap = np.abs((old - x) / scale).sum(axis=0) + alone * np.abs(new - back)
                old[:, done], new[done] = x[:, done], back[done]
                done |= gap < tolerance
            x, old, back, before = old, x, new, back
            if done.all():
                break
        if not np.shares_memory(x, full):
            full[:n] = x
        if len(self.row) > n:
            # ``old`` holds the round before the last.
            for h, (src, w) in enumerate(self.outer[0]):
                full[n + h] = w @ old[src]
            for s in range(len(self.outer[0]), self.sinks, ROWS_AT_ONCE):
                e = min(s + ROWS_AT_ONCE, self.sinks)
                full[n + s : n + e] = _gather(self.outer, old, held, s, e)
            for s in range(0, len(self.leaves), ROWS_AT_ONCE):
                at = slice(s, s + ROWS_AT_ONCE)
                full[self.leaves[at]] = old[self.stems[at]] * self.given[at]
            full[row[out], query[out]] += v[out] * back[query[out]]
            full[to[~mine], of[~mine]] += share[~mine] * before[of[~mine]]
        for s, e in [(0, len(self.edges[0])), *(b[:2] for b in self.blocks)]:
            full[s:e] /= scale[s:e]
        return full, back


class _Moves:
    """Rounds of walks over edges ``src`` to ``to`` with ``w``, for columns of masses. Rows: the nodes that most edges reach first, then as ``near``."""

    def __init__(self, src, to, w, size: int, near):
        order = np.lexsort((near, -np.bincount(to, minlength=size)))
        self.row = np.empty(size, dtype=np.int64)
        self.row[order] = np.arange(size)
        self.edges = _gathers(self.row[src], self.row[to], w, size)

    def rounds(self, x, rounds: int):
        """The masses before the first and after each of the rounds; each is overwritten two rounds later."""
        yield x
        y, held, hubs = np.empty_like(x), np.empty((2, ROWS_AT_ONCE, x.shape[1])), self.edges[0]
        for _ in range(rounds):
            for h, (src, w) in enumerate(hubs):
                y[h] = w @ x[src]
            for s in range(len(hubs), len(x), ROWS_AT_ONCE):
                e = min(s + ROWS_AT_ONCE, len(x))
                y[s:e] = _gather(self.edges, x, held, s, e)
            x, y = y, x
            yield x


class _Hubs:
    """Walks of many queries over a graph of which most is reached through a few nodes, the hubs.

    What a query's seeds pass on stays near them until it comes to a hub, and what a hub passes on is the same for all queries. So masses move without the hubs,
    round by round, from the seeds forward and from the nodes asked for backward, until they meet half way; the hubs' masses follow from the ways to and between them, and
    what they pass on is added at the end. All walks of ``homes`` and ``restarts`` (as in :meth:`_Wide.walk`) are prepared at once. Nothing is left out: the masses are those of all rounds over all edges.
    """

    def __init__(self, starts, dst, w, slot, homes, restarts, alone, alpha: float, rounds: int):
        size, leaving = len(starts) - 1, np.diff(starts)
        degree = np.maximum(leaving, np.bincount(dst, minlength=size))
        hubs = np.argsort(-degree, kind="stable")[:HUBS]
        self.hubs = np.sort(hubs[degree[hubs] > HUB_REACH])
        self.place = np.full(size, -1)
        self.place[self.hubs] = np.arange(len(self.hubs))
        self.slot, self.alpha, self.total, self.half = slot, alpha, rounds, rounds // 2
        src = np.repeat(np.arange(size, dtype=np.int32), leaving)
        #: Edges that don't leave a hub; what each hub passes on.
        free = self.place[src] < 0
        free_src, free_dst, free_w = src[free], dst[free], w[free]
        self.given = [(dst[starts[h] : starts[h + 1]], w[starts[h] : starts[h + 1]]) for h in self.hubs]
        inner = self.place[free_dst] < 0
        s, d, p = free_src[inner], free_dst[inner], free_w[inner]
        self.out = (np.searchsorted(s, np.arange(size + 1)), d, p)
        by = np.argsort(d, kind="stable")
        self.into = (np.searchsorted(d[by], np.arange(size + 1)), s[by], p[by])
        self.most = int(len(dst) * HUB_SHARE)
        near = _near_order(starts, dst)
        self.homes, self.restarts = homes, restarts
        self._arrive(_Moves(free_dst, free_src, free_w, size, near), np.flatnonzero((leaving == 0) & (self.place < 0)), leaving[self.hubs] == 0, np.asarray(alone))
        self.moves = _Moves(free_src, free_dst, free_w, size, near)
        #: No walk gets more than this from the hubs at a node, at least without what rounding adds.
        x = np.zeros((size, 1))
        for (to, share), most in zip(self.given, self.mass[:rounds].max(axis=(0, 1))):
            x[self.moves.row[to], 0] += share * most
        bound = sum(y[:, 0] for y in self.moves.rounds(x, rounds - 1))[self.moves.row]
        bound[self.hubs] = 0.0
        self.bound, self.by_bound = bound, np.argsort(-bound)
        self.falling = -bound[self.by_bound]

    def _columns(self):
        step = max(1, BLOCK_BYTES // (16 * len(self.place)))
        return [slice(c, c + step) for c in range(0, len(self.hubs) + 1, step)]

    def _arrive(self, moves, ends, hub_ends, alone):
        """Per round and query the hubs' masses and what came back to the seeds, by walking backward from the hubs and from the nodes without edges."""
        size, many, rounds = len(self.place), len(self.hubs), self.total
        v, first = np.concatenate(self.restarts)[:, None], np.cumsum([0, *(len(h) for h in self.homes[:-1])])
        seeds = moves.row[np.concatenate(self.homes)]
        came, between = np.empty((rounds + 1, len(self.homes), many + 1)), np.empty((rounds + 1, many, many + 1))
        for columns in self._columns():
            x = np.zeros((size, len(range(*columns.indices(many + 1)))))
            own = self.hubs[columns]
            x[moves.row[own], np.arange(len(own))] = 1.0
            if x.shape[1] > len(own):
                x[moves.row[ends], len(own)] = 1.0
            for t, y in enumerate(moves.rounds(x, rounds)):
                came[t, :, columns] = np.add.reduceat(v * y[seeds], first, axis=0)
                for h, (to, share) in enumerate(self.given):
                    between[t, h, columns] = share @ y[moves.row[to]]
        self.mass, self.back = np.zeros((rounds + 1, len(self.homes), many)), np.ones((rounds + 1, len(self.homes)))
        for t in range(rounds + 1):
            now = sum(self.back[t - j][:, None] * came[j] for j in range(t + 1)) + sum(self.mass[j] @ between[t - 1 - j] for j in range(t))
            self.mass[t] = now[:, :many]
            if t < rounds:
                self.back[t + 1] = self.alpha + (1 - self.alpha) * (now[:, many] + self.mass[t] @ hub_ends + alone * self.back[t])

    def pool(self, j: int, others: int):
        """Nodes besides the seeds that may be among the ``others`` best of the ``j``-th walk, rounded to nine decimals, and the masses half way for :meth:`values`;
        None if these are too many."""
        hub = self.place[self.homes[j]] >= 0
        home, mass, back = self.homes[j][~hub], self.restarts[j][~hub], self.back[:, j]
        found = _reach(*self.out, self.slot, home, self.half, self.most)
        if found is None:
            return None
        (nodes, one, two, part, _), (nodes_at, edges_at, _) = found
        held = np.zeros(len(nodes))
        held[: len(home)] = back[self.total] * mass
        for i in range(self.half):
            e, n = edges_at[min(i, len(edges_at) - 1)], nodes_at[min(i + 1, len(nodes_at) - 1)]
            mass = np.bincount(two[:e], weights=mass[one[:e]] * part[:e], minlength=n).astype(np.float64)
            held[:n] += back[self.total - i - 1] * mass
        state = nodes, mass, held
        # What is still to come in the rounds after these, at most; hubs have all of theirs.
        rest = back[: self.total - self.half].max() * mass.sum() * sum((1 - self.alpha) ** i for i in range(1, self.total - self.half + 1))
        other = np.delete(np.arange(len(self.hubs)), self.place[self.homes[j][hub]])
        fresh, sure = nodes[len(home) :], held[len(home) :]
        known = np.concatenate([sure, self.mass[self.total, j, other]])
        cut = np.partition(known, len(known) - others)[len(known) - others] - 2e-9 if 0 < others <= len(known) else 0.0
        least = cut - rest * (1 + 1e-9)
        least -= 1e-9 * abs(least)
        far = self.by_bound[: np.searchsorted(self.falling, -least, side="right")]
        if len(far) > HUB_POOL:
            return None
        pool = np.concatenate([fresh[sure + self.bound[fresh] >= least], far, self.hubs[other][self.mass[self.total, j, other] >= cut]])
        pool = np.setdiff1d(pool, self.homes[j])
        return (pool, state) if len(pool) <= HUB_POOL else None

    def values(self, j: int, state, asked):
        """The masses at the nodes ``asked``, but for what hubs pass on to others (see :meth:`passed`); None if their reach is too far."""
        hub = self.place[asked]
        out = np.where(hub >= 0, self.mass[self.total, j, hub] if len(self.hubs) else 0.0, 0.0)
        home, back = asked[hub < 0], self.back[:, j]
        steps = self.total - self.half
        found = _reach(*self.into, self.slot, home, steps, self.most)
        if found is None:
            return None
        (nodes, one, two, part, _), (nodes_at, edges_at, _) = found
        reached, mass, held = state
        self.slot[reached] = np.arange(len(reached))
        at = self.slot[nodes]
        self.slot[reached] = -1
        value, mass = (np.where(at >= 0, x[at], 0.0) if len(x) else np.zeros(len(nodes)) for x in (held, mass))
        value = value[: len(home)]
        for i in range(steps - 1, -1, -1):
            e, n = edges_at[min(i, len(edges_at) - 1)], nodes_at[min(i, len(nodes_at) - 1)]
            mass = np.bincount(one[:e], weights=mass[two[:e]] * part[:e], minlength=n).astype(np.float64)
            value += back[i] * mass[: len(home)]
        out[hub < 0] = value
        return out

    def passed(self, walk, asked):
        """What hubs pass on to the nodes ``asked`` in the walks ``walk``, all rounds; 0 at hubs, whose masses are whole."""
        out, rows = np.zeros(len(asked)), self.moves.row[asked]
        for columns in self._columns():
            own = range(*columns.indices(len(self.hubs)))
            if not len(own):
                continue
            x = np.zeros((len(self.place), len(own)))
            for c, h in enumerate(own):
                x[self.moves.row[self.given[h][0]], c] = self.given[h][1]
            for i, y in enumerate(self.moves.rounds(x, self.total - 1)):
                for s in range(0, len(asked), 100_000):
                    at = slice(s, s + 100_000)
                    out[at] += (y[rows[at]] * self.mass[self.total - 1 - i][walk[at], columns]).sum(axis=1)
        return np.where(self.place[asked] < 0, out, 0.0)


def _largest(x, k: int):
    """Per column of ``x`` the rows that may be among its ``k`` largest positive values, rounded to nine decimals."""
    cuts = np.arange(0, len(x), GROUP_ROWS)
    most = np.maximum.reduceat(x, cuts, axis=0) if len(x) else x
    for j in range(x.shape[1]):
        # As many groups hold a value of this size, so the k-th largest is no smaller.
        least = np.partition(most[:, j], len(most) - k)[len(most) - k] - 2e-9 if 0 < k <= len(most) else 0.0
        rows = (cuts[most[:, j] >= least][:, None] + np.arange(GROUP_ROWS)).ravel()
        rows = rows[rows < len(x)]
        yield rows[(x[rows, j] >= least) & (x[rows, j] > 0)]


def pagerank(adj: DataFrame, seeds: DataFrame, alpha: float = 0.5, rounds: int = 20, tolerance: float | None = 1e-5, local_edges: int = LOCAL_EDGES, others: int | None = None, digits: int | None = None) -> DataFrame:
    """``qid, etype, node_id, score`` of every query and edge type.

    With ``others``, a query's rows may be limited to its seeds and the ``others`` best nodes besides (by the
    largest score over all types), which is what an expansion needs. With ``digits``, scores are rounded (half up).

    Up to ``local_edges`` edges of a type (counted first) travel to the tasks once, as integer arrays. There a query
    walks over the edges in its reach; if these are many, it walks over the whole type, a block of queries at once, or, with ``others``
    and without a ``tolerance``, by its hubs (:class:`_Hubs`).
    All rounds are made over all edges in both ways. A graph with a larger type is walked by :func:`pagerank_loop`.
    """
    adj = adj.filter("p > 0")
    nodes = numbered(adj.select(F.col("src").alias("node_id")).unionByName(adj.select(F.col("dst").alias("node_id"))).distinct(), "node_id", "code")
    nodes = cut_lineage(nodes.select("node_id", F.col("code").cast("int").alias("code")))
    coded = adj.join(nodes.select(F.col("node_id").alias("src"), F.col("code").alias("s")), "src").join(nodes.select(F.col("node_id").alias("dst"), F.col("code").alias("d")), "dst")
    coded = cut_lineage(coded.select("etype", "s", "d", "p"))
    sizes = {r["etype"]: r["count"] for r in coded.groupBy("etype").count().collect()}
    if any(n > local_edges for n in sizes.values()):
        ranked = pagerank_loop(adj, seeds, alpha, rounds, tolerance, others)
        return ranked if digits is None else ranked.withColumn("score", F.round("score", digits))
    spark = adj.sparkSession
    shared = {}
    for etype in sorted(sizes):
        rows = coded.filter(F.col("etype") == etype).select("s", "d", "p").toArrow()
        s, d, p = (rows.column(c).to_numpy() for c in ("s", "d", "p"))
        own = np.unique(np.concatenate([s, d]))
        s, d = np.searchsorted(own, s).astype(np.int32), np.searchsorted(own, d).astype(np.int32)
        order = np.lexsort((d, s))
        starts = np.searchsorted(s[order], np.arange(len(own) + 1))
        shared[etype] = spark.sparkContext.broadcast((own, starts, d[order], p[order] * (1 - alpha)))
    label = spark.sparkContext.broadcast(nodes.orderBy("code").select("node_id").toArrow().column("node_id").combine_chunks())
    kind = seeds.schema["node_id"].dataType.simpleString()
    key = seeds.schema["qid"].dataType.simpleString()

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches or not shared:
            return
        given = pa.Table.from_batches(batches)
        asked = given.column("qid").combine_chunks().dictionary_encode()
        order = np.argsort(asked.indices.to_numpy(), kind="stable")
        code, v = given.column("code").fill_null(-1).to_numpy()[order].astype(np.int64), given.column("v").to_numpy()[order]
        ids = given.column("node_id").combine_chunks().take(pa.array(order))
        cuts = np.searchsorted(asked.indices.to_numpy()[order], np.arange(len(asked.dictionary) + 1))
        names, graphs = label.value, {e: b.value for e, b in shared.items()}
        slots = {e: np.full(len(g[0]), -1, dtype=np.int64) for e, g in graphs.items()}
        layouts: dict = {}
        at_rows: dict = {}
        # Where the first queries all had too far a reach, later ones are given up sooner.
        met = {e: [0, 0] for e in graphs}
        block = int(np.clip(BLOCK_BYTES // (8 * max(len(g[0]) for g in graphs.values())), 1, 32))

        def rows(qid, etype, node, mass):
            if digits is not None:
                mass = np.floor(mass * 10.0**digits + 0.5) / 10.0**digits
            columns = [pa.repeat(qid, len(mass)), pa.repeat(pa.scalar(etype, pa.int32()), len(mass)), node, pa.array(mass)]
            return pa.RecordBatch.from_arrays(columns, names=["qid", "etype", "node_id", "score"])

        def alone_rows(q, etype, here, back):
            """Seeds that no edge of the type touches."""
            if not here.all():
                score = v[cuts[q] : cuts[q + 1]][~here] * back
                yield rows(asked.dictionary[q], etype, ids.slice(cuts[q], len(here)).filter(pa.array(~here)).filter(pa.array(score > 0)), score[score > 0])

        def seeds_in(q, own):
            mine, restart = code[cuts[q] : cuts[q + 1]], v[cuts[q] : cuts[q + 1]]
            at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
            here = own[at] == mine
            return at, here, restart, float(restart[~here].sum())

        by_hubs, walk_of, waiting = {}, {}, []
        if others is not None and tolerance is None and len(asked.dictionary) > FEW_QUERIES:
            for etype, (own, starts, dst, w) in graphs.items():
                given = {q: (at[here], restart[here], alone) for q in range(len(asked.dictionary)) for at, here, restart, alone in [seeds_in(q, own)] if here.any()}
                tried = [_walk_near(starts, dst, w, slots[etype], *x, alpha, rounds, tolerance, int(len(dst) * NEAR_SHARE)) for x in list(given.values())[:8]]
                if 2 * sum(x is None for x in tried) > len(tried) and len(given) > FEW_QUERIES:
                    by_hubs[etype] = _Hubs(starts, dst, w, slots[etype], *zip(*given.values()), alpha, rounds)
                    walk_of[etype] = {q: j for j, q in enumerate(given)}

        for low in range(0, len(asked.dictionary), block):
            queries = range(low, min(low + block, len(asked.dictionary)))
            found: dict = {q: {} for q in queries}
            # What a walk by hubs needs for its second half; queries that share a matrix instead.
            halves: dict = {}

            def wide_walks(etype, wide):
                own, starts, dst, w = graphs[etype]
                if etype not in layouts:
                    layouts[etype] = _Wide(starts, dst, w, whole=tolerance is not None)
                    at_rows[etype] = own[np.argsort(layouts[etype].row)]
                x, back = layouts[etype].walk([at[here] for _, at, here, _, _ in wide], [r[here] for _, _, here, r, _ in wide], np.array([a for *_, a in wide]), alpha, rounds, tolerance)
                best = list(_largest(x, others + max(len(here) for _, _, here, _, _ in wide))) if others is not None else [None] * len(wide)
                for j, (q, _, here, _, _) in enumerate(wide):
                    found[q][etype] = (at_rows[etype], x[:, j], best[j], here, back[j])

            for etype, (own, starts, dst, w) in graphs.items():
                wide = []
                for q in queries:
                    at, here, restart, alone = seeds_in(q, own)
                    walks = by_hubs.get(etype)
                    if walks is not None and here.any() and (half := walks.pool(walk_of[etype][q], others)) is not None:
                        halves[q, etype] = half[1]
                        found[q][etype] = (own[half[0]], None, None, here, walks.back[rounds, walk_of[etype][q]])
                        continue
                    most = int(len(dst) * NEAR_SHARE) // (16 if met[etype][0] >= 8 and not met[etype][1] else 1)
                    near = _walk_near(starts, dst, w, slots[etype], at[here], restart[here], alone, alpha, rounds, tolerance, most)
                    met[etype][near is not None] += 1
                    if near is None:
                        wide.append((q, at, here, restart, alone))
                        continue
                    place, mass, back = near
                    by = np.argsort(place)
                    found[q][etype] = (own[place[by]], mass[by], None, here, back)
                if wide:
                    wide_walks(etype, wide)
            for q in queries:
                qid, mine = asked.dictionary[q], code[cuts[q] : cuts[q + 1]]
                if others is None:
                    for etype, (codes, mass, _, here, back) in found[q].items():
                        there = np.flatnonzero(mass > 0)
                        yield rows(qid, etype, names.take(pa.array(codes[there])), mass[there])
                        yield from alone_rows(q, etype, here, back)
                    continue
                # Whoever is among the best over all types is so over the type of the largest score.
                pool = []
                for codes, mass, best, *_ in found[q].values():
                    if mass is None:
                        pool.append(codes)
                        continue
                    best = np.flatnonzero(mass > 0) if best is None else best
                    best = best[~np.isin(codes[best], mine)]
                    pool.append(codes[best[np.lexsort((codes[best], -np.round(mass[best], 9)))[:others]]])
                pool = np.setdiff1d(np.concatenate(pool), mine)
                values, by_hub = {}, {}
                for etype in list(found[q]):
                    own, here = graphs[etype][0], found[q][etype][3]
                    both = np.concatenate([pool, mine[here]])
                    if (q, etype) in halves:
                        at = np.minimum(np.searchsorted(own, both), len(own) - 1)
                        inside, j = np.flatnonzero(own[at] == both), walk_of[etype][q]
                        if (value := by_hubs[etype].values(j, halves[q, etype], at[inside])) is not None:
                            values[etype] = np.zeros(len(both))
                            values[etype][inside] = value
                            by_hub[etype] = (j, inside, at[inside])
                            continue
                        at, here, given_back, alone = seeds_in(q, own)
                        wide_walks(etype, [(q, at, here, given_back, alone)])
                    values[etype] = _values(found[q][etype], both, own, layouts.get(etype))
                waiting.append((q, pool, values, by_hub, {e: x[3:] for e, x in found[q].items()}))
            if by_hubs and low + block < len(asked.dictionary):
                continue
            for etype, walks in by_hubs.items():
                own = [(values[etype], *by_hub[etype]) for _, _, values, by_hub, _ in waiting if etype in by_hub]
                if own:
                    more = walks.passed(np.repeat([j for _, j, _, _ in own], [len(x[2]) for x in own]), np.concatenate([x[3] for x in own]))
                    for (value, _, inside, _), part in zip(own, np.split(more, np.cumsum([len(x[2]) for x in own])[:-1])):
                        value[inside] += part
            for q, pool, values, _, ends in waiting:
                qid, mine = asked.dictionary[q], code[cuts[q] : cuts[q + 1]]
                top = np.round(np.max([x[: len(pool)] for x in values.values()], axis=0), 9)
                kept = np.sort(np.lexsort((pool, -top))[:others])
                for etype, (here, back) in ends.items():
                    score = np.concatenate([values[etype][kept], values[etype][len(pool) :]])
                    there = np.flatnonzero(score > 0)
                    yield rows(qid, etype, names.take(pa.array(np.concatenate([pool[kept], mine[here]])[there])), score[there])
                    yield from alone_rows(q, etype, here, back)
            waiting.clear()

    # Hubs are prepared once in each task, so these are no more than there are cores.
    shared_work = others is not None and tolerance is None
    width = max((1 if shared_work else 4) * spark.sparkContext.defaultParallelism, pieces(seeds.count(), (5 if shared_work else 1) * SEEDS_AT_ONCE))
    return _restart(seeds).join(nodes, "node_id", "left").repartition(width, "qid").select("qid", "node_id", "v", "code").mapInArrow(run, f"qid {key}, etype int, node_id {kind}, score double")


def _values(found, asked, own, layout):
    """The masses of the nodes ``asked`` in a query's result for a type."""
    codes, mass, best, *_ = found
    if not len(codes):
        return np.zeros(len(asked))
    if best is None:
        at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
        return np.where(codes[at] == asked, mass[at], 0.0)
    at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
    return np.where(own[at] == asked, mass[layout.row[at]], 0.0)


def expansion(ppr: DataFrame, seeds: DataFrame, k: int = 16) -> DataFrame:
    """``qid, node_id``: the ``k`` nodes that are no seeds with the largest score over all types."""
    pool = ppr.join(seeds.select("qid", "node_id"), ["qid", "node_id"], "left_anti").groupBy("qid", "node_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "node_id")
    return pool.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k).select("qid", "node_id", "score")
