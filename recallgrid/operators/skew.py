"""Operators that keep per-key work even when a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.session import pieces


def heavy_codes(df: DataFrame, key: str, share: float = 1 / 256) -> tuple[int, dict[int, int]]:
    """The number of rows, and the hashes of the keys that hold more than about ``share`` of them with their counts.

    A frequent-items sketch of ``32 / share`` counters per task finds them in one pass without a shuffle of keys; its
    counts are off by at most a fifth of ``share``, so every key above ``share`` is there and no more than ``2 / share`` are.
    Null is no key.
    """
    code = F.xxhash64(key)
    kept = df.filter(F.col(key).isNotNull()).select(code.alias("h"))
    row = kept.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {int(2 / share)}, {int(32 / share)})").alias("top")).first()
    return row["n"], {x["item"]: x["count"] for x in row["top"] or [] if x["count"] > 0.75 * share * row["n"]}


def _one_of(code: Column, codes) -> Column:
    return code.isin(*codes) if codes else F.lit(False)


def hot_split_join(big: DataFrame, lookup: DataFrame, key: str, how: str = "inner", share: float = 1 / 256) -> DataFrame:
    """``big`` joined with ``lookup`` (unique in ``key``) without sending a hot key to one task.

    Rows of the at most ``2/share`` hot keys (see :func:`heavy_codes`) meet their lookup rows by a broadcast
    whose size that bound proves, whether ``lookup`` has them or not; all other rows are joined by a shuffle in which
    no key exceeds ``share`` of the rows. ``how`` is ``inner`` or ``left``. Null keys match nothing and are never
    shuffled. ``lookup`` is read by both parts: give it as a table or cut it first if it is costly.
    """
    _, heavy = heavy_codes(big, key, share)
    code = F.xxhash64(key)
    hot = _one_of(code, heavy)
    apart = F.col(key).isNull() | hot if how == "left" else hot
    by_shuffle = big.filter(F.col(key).isNotNull() & ~hot).join(lookup, key, how)
    if not heavy and how != "left":
        return by_shuffle
    return big.filter(apart).join(F.broadcast(lookup.filter(hot)), key, how).unionByName(by_shuffle)


def _rounds(states: DataFrame, levels: int, fan_in: int, *merged: Column) -> DataFrame:
    """States of (k, c) merged ``fan_in`` at a time until one is left per key."""
    for _ in range(levels):
        states = states.withColumn("c", F.floor(F.col("c") / fan_in)).groupBy("k", "c").agg(*merged)
    return states


def _levels(chunks: int, fan_in: int) -> int:
    levels = 0
    while fan_in**levels < chunks:
        levels += 1
    return levels


def tree_aggregate(rows: DataFrame, key: str, record: str, value: str, top_k: int = 3, chunk_rows: int = 200_000, fan_in: int = 16, share: float = 1 / 256) -> DataFrame:
    """Per-key rows, distinct records, value sum and top values by a multi-level aggregation tree.

    Repeated rows count once among the records (the largest valid value stands for the record; values that
    are null, NaN or not above zero are broken writes and give none) but all of them among the rows, so
    the rows of a record must meet: rows move once, by key and, for the keys above ``share`` only, by chunk of about
    ``chunk_rows`` rows, as many as the key's own count asks for. Where they meet, a chunk is combined locally into one
    state. A key of one chunk is finished with that; the states of the heavy keys, a handful for each chunk, merge in
    rounds of ``fan_in`` until one is left. No task reads more than a few chunks or ``fan_in`` states of a key.

    Returns ``key, n_rows long, n_records long, value_sum double, top array<struct<value, record>>`` with
    the ``top_k`` largest values (ties: smaller record first). A null key is no key: its rows are left
    out. Null records count as rows only. An empty input gives an empty result. Other columns of ``rows``
    are ignored.
    """
    base = rows.select(F.col(key).alias("k"), F.col(record).alias("r"), F.col(value).cast("double").alias("v")).filter(F.col("k").isNotNull())
    base = base.withColumn("v", F.when(~F.isnan("v") & (F.col("v") > 0), F.col("v")))
    _, heavy = heavy_codes(base, "k", share)
    levels = {h: _levels(pieces(n, chunk_rows), fan_in) for h, n in heavy.items()}
    code = F.xxhash64("k")

    def states(part: DataFrame, chunk: Column) -> DataFrame:
        met = part.withColumn("c", chunk).repartition("k", "c")
        per_record = met.groupBy("k", "c", "r").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v")).withColumn("v", F.when(F.col("r").isNotNull(), F.col("v")))
        in_chunk = Window.partitionBy("k", "c").orderBy(F.col("v").desc_nulls_last(), F.col("r").asc_nulls_last())
        best = F.when((F.col("i") <= top_k) & F.col("v").isNotNull(), F.struct((-F.col("v")).alias("neg"), F.col("r").alias("record")))
        return per_record.withColumn("i", F.row_number().over(in_chunk)).groupBy("k", "c").agg(
            F.sum("n").alias("n_rows"), F.count("v").alias("n_records"), F.sum("v").alias("value_sum"), F.collect_list(best).alias("top")
        )

    merged = [F.sum(c).alias(c) for c in ("n_rows", "n_records", "value_sum")] + [F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, top_k).alias("top")]
    out = states(base.filter(~_one_of(code, [h for h, n in levels.items() if n])), F.lit(0))
    # Heavy keys with as many levels go through their rounds together; a key's chunks are a power of the fan-in.
    for depth in sorted({n for n in levels.values() if n}):
        part = base.filter(code.isin(*[h for h, n in levels.items() if n == depth]))
        out = out.unionByName(_rounds(states(part, F.pmod(F.xxhash64("r"), F.lit(fan_in**depth)).cast("int")), depth, fan_in, *merged))
    top = F.transform(F.array_sort("top"), lambda x: F.struct((-x["neg"]).alias("value"), x["record"].alias("record")))
    return out.select(F.col("k").alias(key), "n_rows", "n_records", F.coalesce("value_sum", F.lit(0.0)).alias("value_sum"), top.alias("top"))


def dominant_keys(rows: DataFrame, key: str, share: float, fan_in: int = 16) -> DataFrame:
    """``key, n_rows`` of the keys with more than ``share`` of all rows (rows with a null key count among all).

    The input's own pieces are counted locally, and the counts of the candidates (see :func:`heavy_codes`) merge in
    rounds of ``fan_in`` pieces; no other key moves. An empty input gives an empty result.
    """
    n, heavy = heavy_codes(rows, key, share)
    total = rows.count()
    counted = rows.select(F.col(key).alias("k")).filter(F.col("k").isNotNull() & _one_of(F.xxhash64("k"), heavy)).withColumn("c", F.spark_partition_id()).withColumn("n_rows", F.lit(1).cast("long"))
    levels = max(1, _levels(rows.rdd.getNumPartitions(), fan_in))
    counted = _rounds(counted, levels, fan_in, F.sum("n_rows").alias("n_rows"))
    return counted.filter(F.col("n_rows") > share * total).select(F.col("k").alias(key), "n_rows")
