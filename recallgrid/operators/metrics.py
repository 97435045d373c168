"""Retrieval quality: recall, reciprocal rank, nDCG with binary gains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``qid, r1, r5, r10, mrr, ndcg`` per query with relevant nodes; ``ranked(qid, node_id, rank)`` counts from 0."""
    gold = relevant.select("qid", "node_id").distinct()
    sizes = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.filter(F.col("rank") < k).join(gold, ["qid", "node_id"], "left_semi")
    seen = hits.groupBy("qid").agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 2)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(k)).cast("int") - 1), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(2.0)))
    found = lambda depth, name: F.when(F.col("first") < depth, 1.0).otherwise(0.0).alias(name)
    return sizes.join(seen, "qid", "left").select(
        "qid", found(1, "r1"), found(5, "r5"), found(10, "r10"),
        F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in ("r1", "r5", "r10", "mrr", "ndcg")])
