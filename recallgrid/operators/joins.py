"""Compositional joins: nodes related to all, or to any, of several entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOP_DISCOUNT = 0.8


def relatedness(bm25: DataFrame, ppr: DataFrame | None = None) -> DataFrame:
    """``entity, node_id, rel``: the larger of the entity's scaled lexical score and its discounted graph score.

    ``bm25(entity, node_id, score)``, ``ppr(entity, etype, node_id, score)``; each is scaled by its entity's maximum.
    """
    largest = Window.partitionBy("entity")
    scaled = lambda rows, by: rows.withColumn("m", F.max("score").over(largest)).filter("m > 0").select("entity", "node_id", (F.lit(by) * F.col("score") / F.col("m")).alias("rel"))
    rows = scaled(bm25, 1.0)
    if ppr is not None:
        rows = rows.unionByName(scaled(ppr.groupBy("entity", "node_id").agg(F.max("score").alias("score")), HOP_DISCOUNT))
    return rows.filter("rel > 0").groupBy("entity", "node_id").agg(F.max("rel").alias("rel"))


def related_to_all(rels: DataFrame, n_entities: int) -> DataFrame:
    """``node_id, score``: nodes related to every entity, by their weakest relation."""
    grouped = rels.groupBy("node_id").agg(F.min("rel").alias("score"), F.count(F.lit(1)).alias("n"))
    return grouped.filter(F.col("n") == n_entities).select("node_id", "score")


def related_to_any(rels: DataFrame, n_entities: int) -> DataFrame:
    """``node_id, score``: nodes related to any entity, by their mean relation."""
    return rels.groupBy("node_id").agg((F.sum("rel") / n_entities).alias("score"))
