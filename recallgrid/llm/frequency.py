"""Frequency of every distinct word over all its spellings, by last-seen counters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from recallgrid.llm.postings import valid_postings
from recallgrid.operators.skew import heavy_codes, hot_split_join
from recallgrid.session import cut_lineage, pieces


def fold_word(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold().strip()


@F.pandas_udf(StringType())
def _fold(words: pd.Series) -> pd.Series:
    return words.map(fold_word, na_action="ignore")


def distinct_words(terms: DataFrame) -> DataFrame:
    """``tid, word, word_tid``: each tid with its folded word and the smallest tid of that word.

    Words are equal after NFKC, case folding and trimming; a null term is no word.
    """
    folded = terms.select("tid", _fold("term").alias("word")).filter("tid is not null and word is not null")
    return folded.withColumn("word_tid", F.min("tid").over(Window.partitionBy("word")))


def word_frequencies(postings: DataFrame, terms: DataFrame, node_map: DataFrame, rare_below: int = 3, common_above: float = 0.3, bucket_rows: int = 500_000) -> DataFrame:
    """``tid, word, n_postings, occurrences, n_nodes, mark`` for every distinct word of ``terms``.

    ``n_postings`` counts the word's valid postings, ``occurrences`` sums their ``tf``, ``n_nodes`` counts
    the nodes holding any of its spellings once. ``mark`` is ``rare`` below ``rare_below`` nodes,
    ``common`` above the share ``common_above`` of all nodes, else ``''``. Tokens are hashed by word, and
    each bucket is read in record order: a counter keeps occurrences, records and the last record seen, so no
    set of records is ever held. Only the words of heavy tids (see :func:`heavy_codes`) are cut into buckets of about
    ``bucket_rows`` tokens, by a hash of the record and by their own counts; all others are one bucket each.
    Words without postings come out with zeros.
    """
    words = cut_lineage(distinct_words(terms))
    valid = cut_lineage(valid_postings(postings, node_map))
    tokens = hot_split_join(valid, words.select("tid", "word_tid"), "tid").withColumn("salt", F.lit(0).cast("long"))
    _, heavy = heavy_codes(valid, "tid")
    sizes: dict[int, int] = {}
    # At most as many rows as there are heavy tids.
    for r in words.withColumn("h", F.xxhash64("tid")).filter(F.col("h").isin(*heavy)).collect() if heavy else []:
        sizes[r["word_tid"]] = sizes.get(r["word_tid"], 0) + heavy[r["h"]]
    buckets = [(word, pieces(n, bucket_rows)) for word, n in sizes.items() if n > bucket_rows]
    if buckets:
        buckets = terms.sparkSession.createDataFrame(buckets, f"word_tid {terms.schema['tid'].dataType.simpleString()}, buckets int")
        tokens = tokens.join(F.broadcast(buckets), "word_tid", "left").withColumn("salt", F.pmod(F.xxhash64("nid"), F.coalesce("buckets", F.lit(1)))).drop("buckets")
    last_seen = F.lag("nid").over(Window.partitionBy("word_tid", "salt").orderBy("nid"))
    counted = (
        tokens.withColumn("fresh", F.when(last_seen == F.col("nid"), 0).otherwise(1))
        .groupBy("word_tid", "salt")
        .agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("occurrences"), F.sum("fresh").alias("n_nodes"))
        .groupBy("word_tid")
        .agg(F.sum("n_postings").alias("n_postings"), F.sum("occurrences").alias("occurrences"), F.sum("n_nodes").alias("n_nodes"))
    )
    all_nodes = node_map.count()
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    out = words.filter("tid = word_tid").select("tid", "word").join(counted.withColumnRenamed("word_tid", "tid"), "tid", "left")
    out = out.select("tid", "word", zero("n_postings", "long"), zero("occurrences", "double"), zero("n_nodes", "long"))
    return out.withColumn("mark", F.when(F.col("n_nodes") < rare_below, "rare").when(F.col("n_nodes") > common_above * all_nodes, "common").otherwise(""))
