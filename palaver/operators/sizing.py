"""Measured sizes: broadcast only what is small, split only what is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_once

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def pin_small_checked(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate a table once, into the shared folder, and mark it for broadcast if it is small; and whether it is.

    Rows are counted, and bytes taken, from the files that all tasks have written; no rows meet in one task for it. A
    larger table is read from there without a hint, and Spark joins it by shuffling.
    """
    table = write_once(df)
    small = table.count() <= max_rows and estimated_bytes(table) <= MAX_BROADCAST_BYTES
    return (F.broadcast(table) if small else table), small


def pin_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    return pin_small_checked(df, max_rows)[0]


# A frame below this planner estimate cannot hold a partition worth splitting.
SALT_ABOVE_BYTES = 256 * 1024 * 1024
# A part of a split key has at most a sixteenth of the rows that a task has on average, but is not smaller than this.
PARTS_PER_TASK = 16
MIN_PART_ROWS = 100_000


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size estimate (file sizes for scans, an upper bound for most operators)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hot_keys(df: DataFrame, key: str, n_parts: str = "_parts") -> DataFrame | None:
    """Keys holding more than their share of a task's rows, with the number of parts to split each into.

    The limit follows the mean number of rows of a shuffle partition, so there are at most PARTS_PER_TASK hot keys per
    partition, and their parts add up to at most twice that. None when the frame is small or evenly spread.
    """
    if estimated_bytes(df) < SALT_ABOVE_BYTES:
        return None
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = F.greatest(df.select(F.count("*")).scalar() / F.lit(float(PARTS_PER_TASK * partitions)), F.lit(float(MIN_PART_ROWS)))
    hot = counts.filter(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias(n_parts))
    table = write_once(hot)
    return F.broadcast(table) if not table.isEmpty() else None
