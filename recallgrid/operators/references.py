"""Orphan references: references whose target is missing, deleted, or arrived later."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import bitmaps
from recallgrid.session import pieces

STATES = ("never", "removed", "later")


@dataclass(frozen=True)
class ReferenceField:
    """One referring column: its table's name, the column, and the column with the epoch seconds."""

    table: str
    field: str
    time: str
    rows: DataFrame


def _month(seconds):
    """Months since year 0 in UTC, whatever the session's time zone."""
    day = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(seconds / 86400).cast("int"))
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def _month_start(months: np.ndarray) -> np.ndarray:
    return (months.astype("int64") - 1970 * 12).astype("datetime64[M]").astype("datetime64[s]").astype("int64").astype("float64")


def _orphans_of_range(rows: pa.Table) -> pa.Table:
    """The orphans of one key range; ``what`` is -1 for parents, -2 for removals, else the reference field."""
    ids = rows.column("id").combine_chunks().dictionary_encode()
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    code = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    what = rows.column("what").to_numpy()
    time = rows.column("t").to_numpy(zero_copy_only=False).astype(np.float64)
    month = pc.fill_null(rows.column("month"), -1).to_numpy()
    size = len(ids.dictionary)
    indexed_at = np.full(size, np.nan)
    is_parent = what == -1
    known = np.zeros(size, dtype=bool)
    known[code[is_parent]] = True
    indexed_at[code[is_parent]] = time[is_parent]
    removed = np.zeros(size, dtype=bool)
    removed[code[what == -2]] = True
    parents_by_month: dict[int, dict] = {}
    out_code, out_what, out_month, out_state = [], [], [], []
    refs = np.flatnonzero(what >= 0)
    refs = refs[np.lexsort((code[refs], month[refs], what[refs]))]
    cuts = np.flatnonzero(np.diff(what[refs]) | np.diff(month[refs])) + 1
    for part in np.split(refs, cuts) if len(refs) else []:
        w, m = int(what[part[0]]), int(month[part[0]])
        if m not in parents_by_month:
            # Parents indexed before the period began hold for all of its references; later ones are compared below.
            there = known if m < 0 else known & ~(indexed_at > _month_start(np.array([m]))[0])
            parents_by_month[m] = bitmaps.build(np.flatnonzero(there))
        left = bitmaps.decode(bitmaps.and_not(bitmaps.build(code[part]), parents_by_month[m]))
        if not len(left):
            continue
        at = time[part[np.searchsorted(code[part], left)]]
        late = known[left] & (indexed_at[left] > at)
        state = np.where(~known[left], np.where(removed[left], 1, 0), np.where(late, 2, -1))
        keep = state >= 0
        out_code.append(left[keep])
        out_state.append(state[keep])
        out_what.append(np.full(keep.sum(), w))
        out_month.append(np.full(keep.sum(), m))
    take = lambda x: np.concatenate(x) if x else np.empty(0, dtype=np.int64)
    months = take(out_month)
    return pa.table(
        {
            "id": ids.dictionary.take(pa.array(take(out_code))),
            "what": pa.array(take(out_what), pa.int32()),
            "month": pa.array(months, pa.int32(), mask=months < 0),
            "state": pa.array(take(out_state), pa.int32()),
        }
    )


def orphan_references(
    references: list[ReferenceField],
    parents: DataFrame,
    removals: DataFrame,
    parent_id: str = "id",
    indexed_at: str = "indexed_at",
    removed_id: str = "node_id",
    range_rows: int = 200_000,
) -> DataFrame:
    """One row per referring table, field, UTC month and id with an orphan reference in that month.

    A reference is an orphan with state ``never`` if its id is neither a parent nor removed, ``removed``
    if it is removed and no parent, ``later`` if it is a parent that was indexed after the reference.
    References are combined per field, month and id (the earliest decides) before they move, so a hub that
    a third of all rows refer to costs a task no more than any other id. Ids are hashed to key ranges of
    about ``range_rows`` rows; each range encodes its ids as integers, holds references and parents as
    compressed bitmaps per period, subtracts, and decodes the bits that survive.

    Null ids are no references. A reference without a time has a null month and can't be ``later``. A
    parent without ``indexed_at`` counts as always there. Repeated parents (the latest index time holds)
    and removals are allowed; empty tables give empty or all-orphan results; further columns are ignored.
    """
    total = parents.count() + removals.count()
    parts = []
    for i, ref in enumerate(references):
        total += ref.rows.count()
        parts.append(ref.rows.select(F.lit(i).alias("what"), F.col(ref.field).alias("id"), F.col(ref.time).cast("double").alias("t")).filter("id is not null"))
    refs = parts[0]
    for part in parts[1:]:
        refs = refs.unionByName(part)
    refs = refs.withColumn("t", F.when(~F.isnan("t"), F.col("t"))).withColumn("month", _month(F.col("t")))
    refs = refs.groupBy("what", "month", "id").agg(F.min("t").alias("t"))
    known = parents.filter(F.col(parent_id).isNotNull()).select(F.col(parent_id).alias("id"), F.col(indexed_at).cast("double").alias("t")).groupBy("id").agg(F.max("t").alias("t"))
    gone = removals.select(F.col(removed_id).alias("id")).filter("id is not null").distinct()
    no_month = F.lit(None).cast("int")
    rows = refs.select("what", "month", "id", "t")
    rows = rows.unionByName(known.select(F.lit(-1).alias("what"), no_month.alias("month"), "id", "t"))
    rows = rows.unionByName(gone.select(F.lit(-2).alias("what"), no_month.alias("month"), "id", F.lit(None).cast("double").alias("t")))
    ranges = pieces(total, range_rows)
    found = (
        rows.withColumn("range", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
        .groupBy("range")
        .applyInArrow(lambda t: _orphans_of_range(t), "id string, what int, month int, state int")
    )
    names = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("what") + 1)
    return found.select(
        names([r.table for r in references]).alias("ref_table"),
        names([r.field for r in references]).alias("ref_field"),
        F.format_string("%04d-%02d", F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1)).alias("ref_month"),
        F.col("id").alias("ref_id"),
        F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("state") + 1).alias("state"),
    ).withColumn("ref_month", F.when(~F.col("ref_month").contains("null"), F.col("ref_month")))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan ids per table, field, month and state."""
    return orphans.groupBy("ref_table", "ref_field", "ref_month", "state").agg(F.count(F.lit(1)).alias("n_ids"))
