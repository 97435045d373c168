"""Session helpers: table reading, the shared checkpoint folder, sizing."""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint`` usable and return the folder.

    The cluster names a folder every executor can reach in ``spark.checkpoint.dir``; it is used as it
    is. Only a session on one machine (``local[...]``) that names none gets a folder of its own.
    """
    sc = spark.sparkContext
    # Checkpoints go when nothing refers to them any more, unless the session says otherwise.
    sc._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "recallgrid-checkpoints")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later reads survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, by: str, name: str = "seq") -> DataFrame:
    """``df`` with the rank of each row by ``by`` (unique, not null) from 0, without a task that sees all rows.

    Rows are range-partitioned; only one count per partition is read on to place the partitions.
    """
    parts = cut_lineage(df.repartitionByRange(shuffle_width(df.sparkSession), by).withColumn("__p", F.spark_partition_id()))
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).select("__p", "__before")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(by)) - 1
    # One row per partition.
    return parts.join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + place).drop("__p", "__before")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame, by: str) -> DataFrame:
    """``df`` on at least as many partitions as there are cores, for costly work on each row.

    Only input in fewer partitions (a small file) is moved, by the hash of ``by``; larger input stays as read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, by)


def pieces(rows: int, per_piece: int) -> int:
    """Number of pieces of about ``per_piece`` rows."""
    return max(1, math.ceil(rows / per_piece))
