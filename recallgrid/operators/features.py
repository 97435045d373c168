"""The fourteen features of a candidate, their normalisation, and the fixed linear score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.graph import COACCESS, KNN, LINK, TAG

# Feature order, weights of the linear score, priors of node kinds.
FEATURES = "bm25 cosine rrf ppr_link ppr_tag ppr_knn ppr_co recency freq importance pinned title_hit kind_prior len_norm".split()
LINEAR_WEIGHTS = [1.2, 0.6, 0.9, 0.45, 0.25, 0.35, 0.45, 0.30, 0.15, 0.40, 0.50, 0.35, 0.10, 0.05]
KIND_PRIORS = {"fact": 1.0, "insight": 0.8, "note": 0.5, "digest": 0.4, "turn": 0.2}
OTHER_KIND = 0.5
DAY = 86400.0
CLIP = 8.0


def age_days(at: Column, now: float) -> Column:
    """Days since an epoch time; unknown or zero means now, the future counts as now."""
    known = F.when(at.isNull() | (at == 0), F.lit(now)).otherwise(at)
    return F.greatest(F.lit(0.0), (F.lit(now) - known) / DAY)


def kind_prior(kind: Column) -> Column:
    out = None
    for name, prior in KIND_PRIORS.items():
        out = F.when(kind == name, F.lit(prior)) if out is None else out.when(kind == name, F.lit(prior))
    return out.otherwise(F.lit(OTHER_KIND))


def candidate_features(candidates: DataFrame, bm25: DataFrame, cosine: DataFrame, rrf: DataFrame, ppr: DataFrame, nodes: DataFrame, now: float, title_hit: Column | None = None) -> DataFrame:
    """Candidates ``(qid, node_id)`` with their features; candidates without a node are dropped.

    ``bm25`` and ``cosine`` are ``(qid, node_id, score)``, ``rrf`` has ``rrf``, ``ppr`` has ``etype, score``.
    ``title_hit`` is a condition over the candidate's and node's columns.
    """
    of_type = lambda etype, name: F.max(F.when(F.col("etype") == etype, F.col("score"))).alias(name)
    walks = ppr.groupBy("qid", "node_id").agg(of_type(LINK, "ppr_link"), of_type(TAG, "ppr_tag"), of_type(KNN, "ppr_knn"), of_type(COACCESS, "ppr_co"))
    key = ["qid", "node_id"]
    rows = candidates.join(bm25.select(*key, F.col("score").alias("bm25")), key, "left").join(cosine.select(*key, F.col("score").alias("cosine")), key, "left")
    rows = rows.join(rrf.select(*key, "rrf"), key, "left").join(walks, key, "left").join(nodes, "node_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return rows.select(
        *key, "kind", "title", "trust", "trust_updated",
        F.col("bm25").isNotNull().alias("by_bm25"),
        (F.coalesce("cosine", F.lit(0.0)) > 0).alias("by_vector"),
        F.col("rrf").isNull().alias("by_graph"),
        *[zero(c) for c in FEATURES[:7]],
        (1 / (1 + F.log1p(age_days(F.col("updated_at"), now)))).alias("recency"),
        F.log1p(F.coalesce("access_count", F.lit(0))).alias("freq"),
        F.coalesce("importance", F.lit(1.0)).alias("importance"),
        F.when(F.col("pinned"), 1.0).otherwise(0.0).alias("pinned"),
        F.when(title_hit if title_hit is not None else F.lit(False), 1.0).otherwise(0.0).alias("title_hit"),
        kind_prior(F.col("kind")).alias("kind_prior"),
        F.least(F.lit(1.0), F.coalesce("text_len", F.lit(0)) / 512.0).alias("len_norm"),
    )


def normaliser(features: DataFrame) -> DataFrame:
    """One row ``mu_<f>, var_<f>``: exact mean and population variance of each feature; 0 and 1 without rows."""
    stats = []
    for f in FEATURES:
        stats += [F.coalesce(F.avg(f), F.lit(0.0)).alias(f"mu_{f}"), F.coalesce(F.var_pop(f), F.lit(1.0)).alias(f"var_{f}")]
    return features.agg(*stats)


def z_score(feature: str) -> Column:
    z = (F.col(feature) - F.col(f"mu_{feature}")) / F.sqrt(F.col(f"var_{feature}") + 1e-6)
    return F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), z))


def linear_score(weights: list[float] = LINEAR_WEIGHTS) -> Column:
    total = F.lit(0.0)
    for f, w in zip(FEATURES, weights):
        total = total + F.lit(w) * z_score(f)
    return total


def effective_trust(trust: Column, updated: Column, now: float, half_life_days: float = 45.0) -> Column:
    """Trust decayed towards neutral; never updated or neutral trust stays as it is."""
    t = F.coalesce(trust, F.lit(0.5))
    if half_life_days <= 0:
        return t
    stamped = F.coalesce(updated, F.lit(0.0))
    days = F.greatest(F.lit(0.0), (F.lit(now) - stamped) / DAY)
    return F.when((t == 0.5) | (stamped <= 0), t).otherwise(0.5 + (t - 0.5) * F.pow(F.lit(0.5), days / half_life_days))


def trust_bonus(now: float, half_life_days: float = 45.0, weight: float = 2.0) -> Column:
    if weight <= 0:
        return F.lit(0.0)
    return (effective_trust(F.col("trust"), F.col("trust_updated"), now, half_life_days) - 0.5) * 2 * weight


def source_labels() -> Column:
    named = [F.when(F.col(f"by_{s}"), F.lit(s)) for s in ("bm25", "vector", "graph")]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def of_kinds(scored: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Keep candidates of these kinds; a filter after candidates are made, so fewer than k may remain."""
    return scored.filter(F.col("kind").isin(kinds)) if kinds else scored


def above(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    return scored.filter(F.col("score") >= threshold)
