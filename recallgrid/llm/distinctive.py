"""How distinctive a term is per record: a two-Poisson mixture per term, fitted by EM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.llm.postings import valid_postings
from recallgrid.operators.skew import hot_split_join
from recallgrid.session import cut_lineage

#: Occurrences that the component of the other records has in any case, so that no count rules it out.
REST_MASS = 0.5
_MODEL = "tid long, elite_share double, elite_rate double, rest_rate double, mean_rate double, n_records long"


def fit_two_poisson(counts: np.ndarray, freqs: np.ndarray, starts: np.ndarray, n_all: float, rounds: int = 60):
    """Expectation-maximisation for many histograms at once.

    ``counts``/``freqs`` hold the histograms one after the other, ``starts`` where each begins; the records
    that lack a term (``n_all`` less those in its histogram) are its count 0. Returns the elite share and
    the rates of the elite and the other component.
    """
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(counts))))
    total = lambda x: np.add.reduceat(x, starts)
    df, mass = total(freqs), total(freqs * counts)
    zeros = np.maximum(n_all - df, 0.0)
    n = df + zeros
    tiny = 1e-12
    share = np.clip(df / n, 1e-9, 0.5)
    elite = mass / df * 1.2
    rest = np.minimum((mass * 0.2 + REST_MASS) / n, elite * 0.9)
    for _ in range(rounds):
        odds = np.log(share / (1 - share))
        gap = elite - rest
        ratio = np.log(elite / rest)
        p = 1 / (1 + np.exp(-np.clip(odds[which] - gap[which] + counts * ratio[which], -700, 700)))
        p0 = 1 / (1 + np.exp(-np.clip(odds - gap, -700, 700)))
        in_elite = total(p * freqs) + p0 * zeros
        elite_mass = total(p * freqs * counts)
        share = np.clip(in_elite / n, 1e-12, 1 - 1e-9)
        elite = np.maximum(elite_mass / np.maximum(in_elite, tiny), tiny)
        rest = (np.maximum(mass - elite_mass, 0.0) + REST_MASS) / np.maximum(n - in_elite, 1.0)
    swap = rest > elite
    return np.where(swap, 1 - share, share), np.where(swap, rest, elite), np.where(swap, elite, rest), mass / n, df


def term_models(valid: DataFrame, n_records: int) -> DataFrame:
    """The fitted mixture of each term; one histogram per term is all that moves."""
    bins = valid.groupBy("tid", "tf").agg(F.count(F.lit(1)).alias("n"))
    histograms = bins.groupBy("tid").agg(F.collect_list("tf").alias("k"), F.collect_list(F.col("n").cast("double")).alias("n"))

    def fit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            k, n = batch.column("k"), batch.column("n")
            starts = np.concatenate([[0], np.cumsum(k.value_lengths().to_numpy())[:-1]]).astype(np.int64)
            share, elite, rest, mean, df = fit_two_poisson(k.flatten().to_numpy(), n.flatten().to_numpy(), starts, float(n_records))
            yield pa.RecordBatch.from_arrays(
                [batch.column("tid").cast(pa.int64()), pa.array(share), pa.array(elite), pa.array(rest), pa.array(mean), pa.array(df.astype(np.int64))],
                names=["tid", "elite_share", "elite_rate", "rest_rate", "mean_rate", "n_records"],
            )

    return histograms.mapInArrow(fit, _MODEL)


def _weigh(rows: DataFrame) -> DataFrame:
    """The posterior of the elite component, and for each occurrence the gain of its log over its mean in the collection."""
    log_odds = F.log(F.col("elite_share") / (1 - F.col("elite_share"))) + F.col("tf") * F.log(F.col("elite_rate") / F.col("rest_rate")) - (F.col("elite_rate") - F.col("rest_rate"))
    posterior = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), log_odds))))
    gain = F.greatest(F.lit(0.0), F.log(posterior / F.col("elite_share")))
    return rows.withColumn("elite", posterior).withColumn("weight", F.col("tf") * gain)


def term_weights(postings: DataFrame, node_map: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``tid, nid, tf, elite, weight`` of every valid posting (see :func:`valid_postings`).

    ``elite`` is the posterior probability that a record with this count belongs to the term's elite
    component. Its mean over all records is the elite share. ``weight`` gives each occurrence the log of the
    posterior over that mean (0 at the least): a term found everywhere counts little, as a high share of records is
    elite, a count that is no sign of eliteness gives nothing, and a rare term that a record repeats counts most. The mixtures are fitted on all records, those without the
    term included. ``only`` (a column ``nid``) restricts the records that come out, not the fit. Empty
    tables give no rows; other columns are ignored.
    """
    valid = cut_lineage(valid_postings(postings, node_map))
    models = cut_lineage(term_models(valid, node_map.count()).drop("n_records"))
    wanted = valid
    if only is not None:
        wanted = valid.join(only.select("nid").filter("nid is not null").distinct(), "nid", "left_semi")
    return _weigh(hot_split_join(wanted, models, "tid")).select("tid", "nid", "tf", "elite", "weight")


def most_distinctive(weights: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` terms of each record with the largest weight; of equal ones the smaller tid."""
    order = Window.partitionBy("nid").orderBy(F.col("weight").desc(), F.col("tid"))
    return weights.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
