"""Interaction events as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from recallgrid.operators.learning import trust_step
from recallgrid.session import ensure_checkpoint_dir


def trust_stream(events: DataFrame, **rates) -> DataFrame:
    """A stream of ``node_id, trust, trust_updated`` from the stream ``events(node_id, ts, helpful, rid)``.

    The state per node is its trust and time; within a micro-batch a node's events are taken in order of time
    and rid. Rows with nulls are left out.
    """
    rows = events.filter("node_id is not null and ts is not null and helpful is not null").select("node_id", "ts", "helpful", "rid")

    def update(key, frames, state):
        trust, at = state.get if state.exists else (0.5, 0.0)
        batch = pd.concat(list(frames)).sort_values(["ts", "rid"])
        for ts, helpful in zip(batch["ts"], batch["helpful"]):
            trust, at = trust_step(trust, at, bool(helpful), float(ts), **rates), float(ts)
        state.update((trust, at))
        yield pd.DataFrame({"node_id": [key[0]], "trust": [trust], "trust_updated": [at]})

    schema = "node_id string, trust double, trust_updated double"
    return rows.groupBy("node_id").applyInPandasWithState(update, schema, "trust double, at double", "update", GroupStateTimeout.NoTimeout)


def usage_per_window(events: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Shown and used events per window of event time; events later than ``late`` are left out of a stream."""
    rows = events.filter("ts is not null").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    counts = rows.groupBy(F.window("at", window).alias("w")).agg(F.count_if("shown").alias("n_shown"), F.count_if("used").alias("n_used"))
    return counts.select(F.col("w.start").alias("window_start"), "n_shown", "n_used")


def run_available(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Process what is there and stop; progress is kept in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def learn_from_stream(engine, events: DataFrame, checkpoint: str):
    """Feed a stream of feedback events to the engine, a micro-batch at a time; returns the running query."""

    def learn(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.feedback(batch)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(learn).start()
