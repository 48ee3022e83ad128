"""What the corpus operators share: word rules, stored tables, checked broadcasts, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_once

# A word is a run of anything but these blanks.
WORD = r"[^\x20\x09-\x0D]+"
# A stored table of at most so many rows (of a few numbers each) may be broadcast.
BROADCAST_ROWS = 1_000_000
FILE_ROWS = 500_000  # rows of a file of a narrow table


def tables(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_batches(spark, most: int = 4 << 20) -> None:
    """Read whole texts, and hand them to Python, in small batches, unless the session names bounds of its own."""
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096":  # default
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "2147483647b"):  # defaults
        spark.conf.set(name, f"{most}b")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows, written once to the shared folder and read from there.

    rows: a bound on their number, if known; a table is then written in no more files than that calls for.
    """
    return write_once(df if rows is None else df.coalesce(8 + rows // FILE_ROWS))


def checked_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Mark a stored table for broadcast if it has at most max_rows rows; otherwise leave it to a shuffle join.

    rows: how many it has, if that is known already.
    """
    return F.broadcast(table) if (table.count() if rows is None else rows) <= max_rows else table


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph with the edges (a, b): rows (node, component) of every node with an edge.

    component is the smallest node reachable. Each round sends every node to the smallest of its neighbours and
    itself, and contracts the edges; as at least half of the nodes vanish in a round, the number of rounds is
    logarithmic, and one or two where most edges lead to a common node. Nothing but the number of edges left reaches
    the driver. Nulls have no edges; repeated edges, both directions and loops change nothing; no edges give no rows.
    """
    def tidy(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
        df = df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = stored(df.filter(F.col("a") < F.col("b")).distinct(), rows)
        return out, out.count()

    left, n = tidy(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()))
    steps = []
    while n or not steps:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        up = stored(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), 2 * n)
        steps.append(up)
        one = left.join(up.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a").select("ra", "b")
        two = one.join(up.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b")
        left, n = tidy(two.select(F.col("ra").alias("a"), F.col("rb").alias("b")), n)
    labels = steps[0].withColumnRenamed("to", "component")
    for up in steps[1:]:
        jump = up.select(F.col("node").alias("component"), "to")
        labels = labels.join(jump, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return labels
