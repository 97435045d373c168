"""Mixing sources to target weights, by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.tokens import DEFAULT_VOCABULARY, count_tokens
from recallgrid.session import cut_lineage, pieces

_EPS = 1e-9


def plain_source(source) -> Column:
    """Sources are equal up to blanks around, letter case, and ``_`` or blanks for ``-``."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[_\s]+", "-")


def pivotal(shares: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Shares in [0, 1] made integral but for at most one, keeping each expectation and the total size.

    The current fractional item is paired with the next; size moves from one to the other, in the direction
    drawn so that neither expectation changes, until one of the two is 0 or 1.
    """
    out, draws, open_at = shares.astype(np.float64).copy(), rng.random(len(shares)), -1
    for i in range(len(out)):
        if out[i] <= _EPS or out[i] >= 1 - _EPS:
            out[i] = round(out[i])
            continue
        if open_at < 0:
            open_at = i
            continue
        j, p, q, v, w = open_at, out[open_at], out[i], sizes[open_at], sizes[i]
        up, down = min((1 - p) * v, q * w), min(p * v, (1 - q) * w)
        move = up if draws[i] * (up + down) < down else -down
        p, q = p + move / v, q - move / w
        first, second = p <= _EPS or p >= 1 - _EPS, q <= _EPS or q >= 1 - _EPS
        out[j], out[i] = (round(p) if first else p), (round(q) if second else q)
        open_at = -1 if first and second else i if first else j
    return out


def _round_group(seed: int, level: int, last: bool):
    def run(key, rows):
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending")])
        name = "|".join(str(k.as_py()) for k in key)
        rng = np.random.default_rng([seed, level, zlib.crc32(name.encode())])
        share = pivotal(rows.column("share").to_numpy(), rows.column("n_tokens").to_numpy().astype(np.float64), rng)
        if last:
            share = np.where(share >= 0.5, 1.0, 0.0)
        return rows.set_column(rows.schema.get_field_index("share"), "share", pa.array(share))

    return run


def source_sizes(documents: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents whose source is named; sources in their plain form."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), plain_source(F.col("source")).alias("source"), "text")
    return count_tokens(rows.filter("doc_id is not null and source is not null"), ["doc_id", "source"], path=path)


def plan_shares(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> list[dict]:
    """Copies per document of each target source; ``targets`` is configuration and read to the driver.

    A source without tokens can't have its share; the others divide the whole in the ratio of their targets.
    Without ``total_tokens`` the mixture is as large as it can be with every other source at its share, that
    is, until the first source needs ``max_repeats`` copies of all its documents.
    """
    named = targets.select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null and target_share > 0")
    named = named.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    rows = [r.asDict() for r in named.join(have, "source", "left").orderBy("source").collect()]
    whole = sum(r["target_share"] for r in rows if r["tokens"])
    for r in rows:
        r["share"] = r["target_share"] / whole if r["tokens"] else 0.0
        r["most"] = (r["max_repeats"] or 1) * (r["tokens"] or 0)
    if total_tokens is None:
        total_tokens = min((r["most"] / r["share"] for r in rows if r["share"]), default=0.0)
    for r in rows:
        r["copies"] = min(r["max_repeats"] or 1, r["share"] * total_tokens / r["tokens"]) if r["tokens"] else 0.0
    return rows


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: float | None = None,
    chunk_rows: int = 20_000,
    fan_in: int = 16,
    seed: int = 17,
    path: str = DEFAULT_VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """The mixture ``doc_id, source, n_tokens, copies`` and the report per target source.

    Every document of a source has the same expected number of copies (see :func:`plan_shares`), at most
    ``max_repeats``. Its fraction is rounded by the pivotal method, weighted by tokens: chunks of a source,
    cut by the hash of ``doc_id``, each leave at most one fraction; rounds of ``fan_in`` of these are paired
    again, and the last one of a source goes to the nearer side. A source's tokens thus differ from the plan
    by at most half of one document; longer documents are rounded first, so it is mostly a short one. Null or unlisted sources and documents without tokens are left out; a null ``max_repeats``
    counts as 1. The report has the target, the planned and the actual share.
    """
    sizes = cut_lineage(source_sizes(documents, path))
    plan = plan_shares(sizes, targets, total_tokens)
    spark = documents.sparkSession
    fields = "source string, target_share double, max_repeats int, n_docs long, available_tokens long, planned_share double, copies double"
    listed = [(r["source"], float(r["target_share"]), int(r["max_repeats"] or 1), int(r["n_docs"] or 0), int(r["tokens"] or 0), float(r["share"]), float(r["copies"])) for r in plan]
    planned = spark.createDataFrame(listed, fields)
    levels, chunks = 0, 1
    while chunks < pieces(sizes.count(), chunk_rows):
        levels, chunks = levels + 1, chunks * fan_in
    # One row per target source, which is configuration.
    rows = sizes.filter("n_tokens > 0").join(F.broadcast(planned.select("source", "copies")), "source")
    rows = rows.withColumn("base", F.floor(F.col("copies") + _EPS)).select(
        "doc_id", "source", "n_tokens", "base", F.greatest(F.lit(0.0), F.col("copies") - F.col("base")).alias("share"), F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk")
    )
    done = None
    for level in range(levels + 1):
        schema = "doc_id long, source string, n_tokens long, base long, share double, chunk long"
        rounded = cut_lineage(rows.groupBy("source", "chunk").applyInArrow(_round_group(seed, level, level == levels), schema))
        whole = rounded.filter("share in (0, 1)")
        done = whole if done is None else done.unionByName(whole)
        rows = rounded.filter("share not in (0, 1)").withColumn("chunk", F.floor(F.col("chunk") / fan_in))
    mixture = done.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("share")).cast("int").alias("copies")).filter("copies > 0")
    actual = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixture_tokens"), F.max("copies").alias("most_copies"))
    total = actual.agg(F.sum("mixture_tokens").alias("total_tokens"))
    report = planned.join(actual, "source", "left").join(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "n_docs", "available_tokens",
        F.round("planned_share", 6).alias("planned_share"),
        F.coalesce("mixture_tokens", F.lit(0)).alias("mixture_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(F.coalesce(F.col("mixture_tokens") / F.col("total_tokens"), F.lit(0.0)), 6).alias("actual_share"),
    )
    return mixture, report
