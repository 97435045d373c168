"""Valid postings, shared by the term operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_postings(postings: DataFrame, node_map: DataFrame) -> DataFrame:
    """``tid, nid, tf`` with one row per term and record.

    Kept are rows with ``tf > 0`` (null, NaN, zero and negative are broken writes) whose ``nid`` is in
    ``node_map``; repeated rows count once, and of differing valid ``tf`` the largest holds. The one
    shuffle is by ``nid``, which no term can skew.
    """
    rows = postings.select("tid", "nid", F.col("tf").cast("double").alias("tf")).filter("tid is not null and nid is not null and tf > 0 and not isnan(tf)")
    known = node_map.select("nid").filter("nid is not null").distinct()
    return rows.join(known, "nid", "left_semi").groupBy("tid", "nid").agg(F.max("tf").alias("tf"))
