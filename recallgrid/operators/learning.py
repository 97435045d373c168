"""Folds over interaction logs: co-access edges and trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.features import DAY
from recallgrid.operators.graph import WEEK


SPAN = 4 * WEEK


def coaccess_edges(used: DataFrame, eta: float = 0.3, decay: float = 0.9, floor: float | None = None, now: float | None = None, block_items: int = 64, stored: DataFrame | None = None) -> DataFrame:
    """``src, dst, w, updated``: one edge each way per pair of nodes used by the same query.

    ``used(query, node_id, ts)``: a query's time is its earliest row. In time order, the weight decays by the
    weeks since its last update and then moves by ``eta`` towards 1. With ``floor`` and ``now``, edges whose
    decayed weight is below it are pruned. Null keys and repeated rows count for nothing. The nodes of a
    query are paired in blocks of about ``block_items``, so that no task pairs all of a huge query. Each
    update is an affine map of the weight; the maps of a span of time are composed first and only the
    spans' maps of a pair are brought together. ``stored(src, dst, w, updated)`` are edges to go on from, which
    come out too.
    """
    rows = used.filter("query is not null and node_id is not null and ts is not null").groupBy("query", "node_id").agg(F.min("ts").alias("ts"))
    sizes = rows.groupBy("query").agg(F.min("ts").alias("at"), F.ceil(F.count(F.lit(1)) / block_items).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.drop("ts").join(sizes.drop("n"), "query")
    left = rows.select("query", F.col("node_id").alias("src"), "at", F.pmod(F.xxhash64("node_id"), F.col("blocks")).cast("int").alias("block"))
    right = rows.select("query", F.col("node_id").alias("dst"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = left.join(right, ["query", "block"]).filter("src <> dst")
    spans = pairs.groupBy("src", "dst", F.floor(F.col("at") / SPAN).alias("span")).agg(F.array_sort(F.collect_list("at")).alias("times"))

    def update(state: Column, at: Column) -> Column:
        """The map w -> a w + b of the updates so far, seen from the span's first moment."""
        keep = (1 - eta) * F.pow(F.lit(decay), (at - state["last"]) / WEEK)
        return F.struct((state["a"] * keep).alias("a"), (state["b"] * keep + eta).alias("b"), state["first"].alias("first"), at.alias("last"))

    first = F.element_at("times", 1)
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), first.alias("first"), first.alias("last"))
    maps = spans.select("src", "dst", F.aggregate("times", start, update).alias("m"))
    if stored is not None:
        known = F.struct(F.lit(0.0).alias("a"), F.col("w").alias("b"), F.col("updated").alias("first"), F.col("updated").alias("last"))
        maps = maps.unionByName(stored.select("src", "dst", known.alias("m")))
    whole = maps.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("m.first", "m.last", "m.a", "m.b"))).alias("maps"))

    def follow(state: Column, m: Column) -> Column:
        gap = F.pow(F.lit(decay), (m["first"] - state["at"]) / WEEK)
        return F.struct((state["w"] * gap * m["a"] + m["b"]).alias("w"), m["last"].alias("at"))

    begin = F.struct(F.lit(0.0).alias("w"), F.element_at("maps", 1)["first"].alias("at"))
    out = whole.select("src", "dst", F.aggregate("maps", begin, follow).alias("s")).select("src", "dst", "s.w", F.col("s.at").alias("updated"))
    if floor is not None and now is not None:
        out = out.filter(F.col("w") * F.pow(F.lit(decay), (F.lit(now) - F.col("updated")) / WEEK) >= floor)
    return out


def trust_fold(events: DataFrame, gain: float = 0.05, loss: float = 0.10, half_life_days: float = 45.0, stored: DataFrame | None = None) -> DataFrame:
    """``node_id, trust, trust_updated`` after the events ``(node_id, ts, helpful, rid)`` in order of time and rid.

    Everyone starts neutral; before each event trust decays towards neutral, and it stays within 0 and 1. Rows
    with a null in ``node_id``, ``ts`` or ``helpful`` are left out. An event is a clamped affine map of the
    trust, and so is a sequence of them: the events of a span of time are composed first, and only the
    spans' maps of a node are brought together, so a hub's log isn't folded in one piece. ``stored(node_id,
    trust, trust_updated)`` is the state to go on from (time 0: never updated); its nodes come out too.
    """
    rows = events.filter("node_id is not null and ts is not null and helpful is not null")
    spans = rows.groupBy("node_id", F.floor(F.col("ts") / SPAN).alias("span")).agg(F.array_sort(F.collect_list(F.struct("ts", "rid", "helpful"))).alias("steps"))
    fade = lambda seconds: F.pow(F.lit(0.5), F.greatest(F.lit(0.0), seconds) / (DAY * half_life_days)) if half_life_days > 0 else F.lit(1.0)
    within = lambda x, low, high: F.least(high, F.greatest(low, x))

    def step(s: Column, e: Column) -> Column:
        """With x the trust less 0.5 at the span's first moment: x -> within(a x + b, low, high)."""
        keep, move = fade(e["ts"] - s["last"]), F.when(e["helpful"], gain).otherwise(-loss)
        after = lambda v: within(v * keep + move, F.lit(-0.5), F.lit(0.5))
        return F.struct(
            (s["a"] * keep).alias("a"), (s["b"] * keep + move).alias("b"), after(s["low"]).alias("low"), after(s["high"]).alias("high"), s["first"].alias("first"), e["ts"].alias("last")
        )

    first = F.element_at("steps", 1)["ts"]
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-0.5).alias("low"), F.lit(0.5).alias("high"), first.alias("first"), first.alias("last"))
    maps = spans.select("node_id", F.aggregate("steps", start, step).alias("m"))
    if stored is not None:
        x, at = F.coalesce("trust", F.lit(0.5)) - 0.5, F.coalesce("trust_updated", F.lit(0.0))
        known = F.struct(F.lit(0.0).alias("a"), x.alias("b"), F.lit(-0.5).alias("low"), F.lit(0.5).alias("high"), at.alias("first"), at.alias("last"))
        maps = maps.unionByName(stored.select("node_id", known.alias("m")))
    whole = maps.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("m.first", "m.last", "m.a", "m.b", "m.low", "m.high"))).alias("maps"))

    def follow(s: Column, m: Column) -> Column:
        x = s["x"] * F.when(s["at"] > 0, fade(m["first"] - s["at"])).otherwise(1.0)
        return F.struct(within(x * m["a"] + m["b"], m["low"], m["high"]).alias("x"), m["last"].alias("at"))

    begin = F.struct(F.lit(0.0).alias("x"), F.element_at("maps", 1)["first"].alias("at"))
    out = whole.select("node_id", F.aggregate("maps", begin, follow).alias("s"))
    return out.select("node_id", (F.col("s.x") + 0.5).alias("trust"), F.col("s.at").alias("trust_updated"))


def trust_step(trust: float, updated: float, helpful: bool, at: float, gain: float = 0.05, loss: float = 0.10, half_life_days: float = 45.0) -> float:
    """One event, for stateful streams."""
    keep = 0.5 ** (max(0.0, at - updated) / (DAY * half_life_days)) if half_life_days > 0 and updated > 0 else 1.0
    return min(1.0, max(0.0, 0.5 + (trust - 0.5) * keep + (gain if helpful else -loss)))
