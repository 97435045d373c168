"""Items that appear together in a basket, with large baskets split into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.operators.skew import hot_split_join
from recallgrid.session import cut_lineage, pieces


def _bounded_baskets(rows: DataFrame, chunk_items: int) -> DataFrame:
    """``basket, chunks, chunk, items``: every basket as chunks of about ``chunk_items`` items.

    The items of a basket fall into chunks by their hash, so no task ever holds a whole huge basket.
    """
    sizes = rows.groupBy("basket").agg(F.count(F.lit(1)).alias("size")).withColumn("chunks", F.ceil(F.col("size") / chunk_items)).filter("size > 1")
    chunked = hot_split_join(rows, sizes.select("basket", "chunks"), "basket").withColumn("chunk", F.pmod(F.xxhash64("item"), F.col("chunks")))
    return chunked.groupBy("basket", "chunks", "chunk").agg(F.sort_array(F.collect_list(F.struct("item", "n"))).alias("items"))


def _pairs_of_baskets(baskets: DataFrame) -> DataFrame:
    """Every pair of items of a basket, once, as ``a, b``, each with its count ``n``."""
    after = "slice(items, i + 2, size(items))"
    inside = baskets.select("items", F.posexplode("items").alias("i", "x")).select("x", F.explode(F.expr(after)).alias("y"))
    parts = baskets.filter("chunks > 1")
    left = parts.filter(F.col("chunk") < F.col("chunks") - 1).withColumn("other", F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)))
    right = parts.filter("chunk > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)))
    blocks = left.select("basket", F.col("chunk").alias("p"), F.col("other").alias("q"), F.col("items").alias("xs")).join(
        right.select("basket", F.col("other").alias("p"), F.col("chunk").alias("q"), F.col("items").alias("ys")), ["basket", "p", "q"]
    )
    between = blocks.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
    first = F.col("x.item") < F.col("y.item")
    both = inside.unionByName(between)
    return both.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))


def pair_associations(
    baskets: DataFrame,
    basket: str,
    item: str,
    min_count: int = 1,
    min_lift: float = 0.0,
    chunk_items: int = 64,
) -> DataFrame:
    """``item_a, item_b, n_ab, n_a, n_b, lift`` of the pairs of items that share a basket.

    Counts are of distinct baskets; ``lift`` is ``n_ab * n / (n_a * n_b)`` with ``n`` the baskets that hold
    any item. Rows with a null basket or item, and repeated rows, count for nothing. Only pairs with
    ``n_ab >= min_count`` and ``lift >= min_lift`` come out; items that can't reach either bound (too few
    baskets, or so many that even full overlap falls short) are left out before pairing, which loses no
    pair. Baskets are cut into chunks; the pairs inside chunks and the products of chunk pairs are made
    by separate tasks and counted before they move.
    """
    rows = cut_lineage(baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).filter("basket is not null and item is not null").distinct())
    n = rows.select("basket").distinct().count()
    items = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    if min_lift > 0:
        items = items.filter(F.col("n") * min_lift <= n)
    kept = hot_split_join(rows, items, "item")
    pairs = _pairs_of_baskets(cut_lineage(_bounded_baskets(kept, chunk_items)))
    counted = (
        pairs.groupBy(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"))
        .agg(F.count(F.lit(1)).alias("n_ab"), F.first("a.n").alias("n_a"), F.first("b.n").alias("n_b"))
        .filter(F.col("n_ab") >= min_count)
    )
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))
    return counted.withColumn("lift", lift).filter(F.col("lift") >= min_lift)
