"""The gated learner: a small network trained on pairs, and the test that lets it take part."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.features import CLIP, FEATURES, LINEAR_WEIGHTS

# Gate margin, confidence, least pairs, largest share; tanh approximation of GELU.
GATE_FLOOR, GATE_Z, GATE_PAIRS, GATE_MOST, GATE_SLOPE = 0.52, 3.0, 20, 0.7, 5.0
_C, _D = 0.7978845608, 0.044715


def wilson_lower(wins: Column, n: Column, z: float = GATE_Z) -> Column:
    p = wins / n
    root = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (p + z * z / (2 * n) - z * root) / (1 + z * z / n)).otherwise(0.0)


def blend_share(events: Column, wins: Column, losses: Column, least_events: int = 100) -> Column:
    """Share of the learned score: 0 until the held-out win rate is above the floor with confidence."""
    n = (wins + losses).cast("double")
    lower = wilson_lower(wins.cast("double"), n)
    closed = (events < least_events) | (n < GATE_PAIRS) | (lower <= GATE_FLOOR)
    return F.when(closed, 0.0).otherwise(F.least(F.lit(GATE_MOST), GATE_SLOPE * (lower - GATE_FLOOR)))


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope."""
    t = np.tanh(_C * (x + _D * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * _C * (1 + 3 * _D * x * x)


@dataclass
class Learner:
    """Network 14 -> hidden -> 1 with a smoothed copy that scores, its normaliser and gate counters."""

    hidden: int = 16
    rate: float = 0.05
    shrink: float = 1e-4
    smooth: float = 0.98
    seed: int = 13
    events: int = 0
    wins: int = 0
    losses: int = 0
    seen: int = 0
    pairs: int = 0
    loss: float = 0.0
    mu: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    var: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        first = rng.standard_normal((len(FEATURES), self.hidden)) * 0.15
        self.live = [first, np.zeros(self.hidden), rng.standard_normal(self.hidden) * 0.15, 0.0]
        self.calm = [np.copy(w) for w in self.live]

    def z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mu) / np.sqrt(self.var + 1e-6), -CLIP, CLIP)

    def learned(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.calm
        return _gelu(self.z(x) @ w1 + b1)[0] @ w2 + b2

    def linear(self, x: np.ndarray) -> np.ndarray:
        return self.z(x) @ np.array(LINEAR_WEIGHTS)

    def judge(self, better: np.ndarray, worse: np.ndarray) -> None:
        """Count a held-out pair on which learner and linear score disagree."""
        self.events += 1
        learner, linear = (bool(f(better) > f(worse)) for f in (self.learned, self.linear))
        self.wins += learner and not linear
        self.losses += linear and not learner

    def train(self, better: np.ndarray, worse: np.ndarray) -> float:
        """One step on the logistic loss of the pair's margin; returns the loss before it."""
        return self.train_pairs(self.z(better)[None, :], self.z(worse)[None, :])

    def train_pairs(self, better: np.ndarray, worse: np.ndarray) -> float:
        """The steps of some pairs of normalised rows, taken together at the weights before them; returns the summed loss.

        To first order in ``rate`` this equals one step per pair in turn.
        """
        n = len(better)
        self.events += n
        w1, b1, w2, b2 = self.live
        z = np.concatenate([better, worse])
        act, slope = _gelu(z @ w1 + b1)
        margin = (act[:n] - act[n:]) @ w2
        pull = 1 / (1 + np.exp(np.minimum(margin, 30.0)))
        pull = np.concatenate([-pull, pull])
        down = pull[:, None] * w2 * slope
        steps = [z.T @ down + n * self.shrink * w1, down.sum(axis=0), pull @ act + n * self.shrink * w2, pull.sum()]
        self.live = [w - self.rate * s for w, s in zip(self.live, steps)]
        keep = self.smooth**n
        self.calm = [keep * c + (1 - keep) * w for c, w in zip(self.calm, self.live)]
        return float(np.logaddexp(0.0, -margin).sum())


def usable_feedback(feedback: DataFrame) -> DataFrame:
    """``rid, ts, query_hash, features, used, held_out`` of the rows with label, query and all finite features."""
    from recallgrid.functions.text import is_held_out

    rows = feedback.filter("features is not null and used is not null and query_hash is not null and ts is not null")
    rows = rows.filter((F.size("features") == len(FEATURES)) & F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x)))
    return rows.select("rid", "ts", "query_hash", "features", "used", is_held_out(F.col("query_hash")).alias("held_out"))


def _flat(weights: list) -> list[float]:
    return np.concatenate([np.ravel(w) for w in weights]).tolist()


def train_on_log(feedback: DataFrame, hidden: int = 16, replay: int = 8, window: int = 256, seed: int = 13, shard_rows: int = 50_000, start: Learner | None = None, replayed: DataFrame | None = None, batch: int = 8) -> Learner:
    """A learner trained on an interaction log ``(rid, ts, query_hash, features, used)``.

    The three quarters of the queries that aren't held out are cut into shards of about ``shard_rows`` rows by
    their hash. A shard takes its queries in time order, pairs every used row with every unused one, and
    replays ``replay`` of the last ``window`` pairs after each query; the shards' weights are averaged by
    their number of steps. A log of one shard is thus a plain sequential fold. The normaliser is the exact
    mean and variance of all rows.

    With ``start`` that learner is trained on and its normaliser continued, by its number of rows ``seen``. Rows of
    ``replayed`` give no steps of their own; their pairs can be replayed, or met by a row of the log. The learner's ``pairs``
    and ``loss`` are the number of new pairs and their summed loss.
    """
    rows = usable_feedback(feedback)
    n = rows.count()
    start = Learner(hidden=hidden, seed=seed) if start is None else start
    if not n:
        return start
    hidden = start.hidden
    stats = rows.select(F.posexplode("features")).groupBy("pos").agg(F.avg("col").alias("mu"), F.var_pop("col").alias("var")).orderBy("pos").collect()
    mu, var = np.array([r["mu"] for r in stats]), np.array([r["var"] for r in stats])
    # The means and variances of both sets of rows, by their numbers.
    both = start.seen + n
    gap, old = mu - start.mu, start.seen / both
    mu, var = mu - old * gap, (1 - old) * var + old * start.var + old * (1 - old) * gap**2
    shards = max(1, -(-n // shard_rows))
    live, calm, rate, shrink = start.live, start.calm, start.rate, start.shrink

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "rid"]).reset_index(drop=True)
        learner, rng, loss = Learner(hidden=hidden, rate=rate, shrink=shrink, seed=seed, mu=mu, var=var), np.random.default_rng(seed), 0.0
        pairs = 0
        learner.live, learner.calm = list(live), list(calm)
        x, fresh, used = learner.z(np.stack(pdf["features"].to_numpy()).astype(np.float64)), pdf["fresh"].to_numpy(), pdf["used"].to_numpy(dtype=bool)
        recent = np.empty((0, 2), dtype=np.int64)
        # Queries in the order of their first rows.
        code = pd.factorize(pdf["query_hash"])[0]
        by_query = np.argsort(code, kind="stable")
        for rows in np.split(by_query, np.flatnonzero(np.diff(code[by_query])) + 1):
            better, worse = rows[used[rows]], rows[~used[rows]]
            total, met = len(better) * len(worse), False
            for s in range(0, total, batch):
                at = np.arange(s, min(total, s + batch))
                u, g = better[at // len(worse)], worse[at % len(worse)]
                new = fresh[u] | fresh[g]
                if new.any():
                    met = True
                    pairs += int(new.sum())
                    loss += learner.train_pairs(x[u[new]], x[g[new]])
            if total:
                at = np.arange(max(0, total - window), total)
                recent = np.concatenate([recent, np.stack([better[at // len(worse)], worse[at % len(worse)]], axis=1)])[-window:]
            if met and replay:
                again = recent[rng.integers(0, len(recent), replay)]
                learner.train_pairs(x[again[:, 0]], x[again[:, 1]])
        return pd.DataFrame({"events": [learner.events], "pairs": [pairs], "loss": [loss], "live": [_flat(learner.live)], "calm": [_flat(learner.calm)]})

    rows = rows.withColumn("fresh", F.lit(True))
    if replayed is not None:
        rows = rows.unionByName(usable_feedback(replayed).withColumn("fresh", F.lit(False)))
    trained = rows.filter("not held_out").withColumn("shard", F.pmod(F.xxhash64("query_hash"), F.lit(shards))).groupBy("shard").applyInPandas(fold, "events long, pairs long, loss double, live array<double>, calm array<double>")
    trained = trained.filter("events > 0").select("events", "pairs", "loss", F.posexplode(F.arrays_zip("live", "calm")))
    mean = lambda c: (F.sum(F.col(f"col.{c}") * F.col("events")) / F.sum("events")).alias(c)
    flat = trained.groupBy("pos").agg(F.sum("events").alias("events"), F.sum("pairs").alias("pairs"), F.sum("loss").alias("loss"), mean("live"), mean("calm")).orderBy("pos").collect()
    start.mu, start.var, start.seen = mu, var, both
    if flat:
        shapes = [np.shape(w) for w in start.live]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        for name in ("live", "calm"):
            parts = np.split(np.array([r[name] for r in flat]), cuts)
            setattr(start, name, [p.reshape(s) if s else float(p[0]) for p, s in zip(parts, shapes)])
        start.events += int(flat[0]["events"])
        start.pairs, start.loss = int(flat[0]["pairs"]), float(flat[0]["loss"])
    return start


def score_rows(rows: DataFrame, learner: Learner) -> DataFrame:
    """``rows`` (with ``features``) and their ``learned`` and ``linear`` scores, in Arrow batches."""
    kept = [c for c in rows.columns if c not in ("learned", "linear")]

    def run(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            scores = [pa.array(f(x)) if len(x) else pa.array([], pa.float64()) for f in (learner.learned, learner.linear)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *scores], names=[*kept, "learned", "linear"])

    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in kept)
    return rows.select(*kept).mapInArrow(run, f"{kinds}, learned double, linear double")


def gate(feedback: DataFrame, learner: Learner, least_events: int = 100) -> DataFrame:
    """One row ``events, wins, losses, share``: the learner against the linear score on held-out queries' pairs."""
    scored = score_rows(usable_feedback(feedback).filter("held_out").select("query_hash", "used", "features"), learner)
    good = scored.filter("used").select("query_hash", F.col("learned").alias("lu"), F.col("linear").alias("hu"))
    bad = scored.filter("not used").select("query_hash", F.col("learned").alias("lg"), F.col("linear").alias("hg"))
    counts = referee_counts(good.join(bad, "query_hash"), F.col("lu") > F.col("lg"), F.col("hu") > F.col("hg"))
    counts = counts.withColumn("events", F.col("events") + learner.events)
    return counts.withColumn("share", blend_share(F.col("events"), F.col("wins"), F.col("losses"), least_events))


def referee_counts(pairs: DataFrame, learner: Column, linear: Column) -> DataFrame:
    """``events, wins, losses`` over held-out pairs, given whether learner and linear score order each right."""
    return pairs.agg(F.count(F.lit(1)).alias("events"), F.count_if(learner & ~linear).alias("wins"), F.count_if(linear & ~learner).alias("losses"))
