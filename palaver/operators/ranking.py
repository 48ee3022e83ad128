"""Orderings that hold up when one key, or one score, covers a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..session import write_once
from .sizing import pin_small


def with_global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Number all rows 1, 2, ... in the given total order.

    Range partitioning on the whole order (hot leading values are split by the tiebreak),
    a local sort, then per-partition counts turn local positions into global ones. The rows
    are written once with their local position, so that both uses see the same partitions.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = write_once(placed.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", POSITION_BITS)
    local = F.col("_id").bitwiseAND((1 << POSITION_BITS) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition: small enough for a single ordered window
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_part", part).join(pin_small(offsets), "_part")
    return ranked.withColumn(rank, F.col("_before") + local + 1).drop("_id", "_part", "_before")


POSITION_BITS = 33  # monotonically_increasing_id keeps the position in a partition in the low 33 bits
SHORT_LIST = 1000  # up to here Spark's own top-k and window limits keep only the best per task


def _position() -> Column:
    return F.monotonically_increasing_id().bitwiseAND((1 << POSITION_BITS) - 1)


def _best_of_each_task(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.sortWithinPartitions(*order).withColumn("_pos", _position()).filter(F.col("_pos") < n).drop("_pos")


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows of a total order.

    A short list is a plain top-k. For a long one, n rows from every scan task would all meet in
    the last task; they are cut down in one more round of parallel tasks before.
    """
    if n > SHORT_LIST:
        fan = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = _best_of_each_task(_best_of_each_task(df, order, n).repartition(fan), order, n)
    return df.orderBy(*order).limit(n)


def with_bounded_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Row numbers over a frame already cut to a bounded size (a top-n, a bucket table)."""
    return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group.

    Up to SHORT_LIST, Spark keeps only n rows per group and task before the shuffle. Beyond, each
    group is first ranked in parts, so that a hot group is never sorted by one task.
    """
    def best(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)

    if n > SHORT_LIST:
        fan = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.xxhash64(*df.columns), F.lit(fan))
        df = best(df.withColumn("_part", part), [*group, "_part"]).drop("_part", rank)
    return best(df, group).withColumn(rank, F.col(rank).cast("long"))


def draw_n(df: DataFrame, n: int, key: Column, tiebreak: str) -> DataFrame:
    """Stable random draw of n rows: the n smallest keyed uniforms."""
    return top_n(df.withColumn("_u", nm.keyed_uniform(key)), [F.asc("_u"), F.asc(tiebreak)], n).drop("_u")


def score_bands(df: DataFrame, score: str, tiebreak: str, edges: list[int], label: str = "band") -> DataFrame:
    """The best max(edges) rows by score, tagged with the band (0, 1, ...) of their rank."""
    top = with_bounded_rank(top_n(df, [F.desc(score), F.asc(tiebreak)], max(edges)), [F.desc(score), F.asc(tiebreak)])
    band = F.lit(0)
    for edge in edges[:-1]:
        band = band + (F.col("rank") > edge).cast("int")
    return top.withColumn(label, band.cast("long"))


def hold_out(df: DataFrame, order: list[Column], keep: int = 9, out_of: int = 10) -> DataFrame:
    """Out of every `out_of` consecutive rows keep the first `keep`."""
    ranked = with_global_rank(df, order)
    return ranked.filter((F.col("rank") - 1) % out_of < keep)


def prefix_until_missing(df: DataFrame, pos: str, value: str) -> DataFrame:
    """Rows before the first row (by pos) whose value is missing."""
    first = df.filter(F.col(value).isNull()).select(F.min(pos)).scalar()
    return df.filter(first.isNull() | (F.col(pos) < first))


def page(df: DataFrame, order: list[Column], skip: int, take: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(take)


def first_places(df: DataFrame, key: str, major: str, minor: str, span: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """(key, major, minor): the smallest pair of each key, a null major before all others.

    The pair, a long and a non-negative int, is packed into one number: tasks keep it per key in a hash map, where a
    struct would have all rows sorted by key first. With a span, the smallest and largest major, of less than 32 bits that is a long, else a
    slower decimal.
    """
    low, high = span if None not in span and span[1] - span[0] < 2**32 - 2 else (-2**63, None)
    kind = "decimal(38,0)" if high is None else "long"
    wide, size = "decimal(20,0)" if high is None else "long", F.lit(str(2**31)).cast("decimal(10,0)" if high is None else "long")
    place = F.coalesce(F.col(major).cast(wide) - F.lit(str(low - 1)).cast(wide), F.lit("0").cast(wide))  # 0: null
    best = df.groupBy(key).agg(F.min((place * size + F.col(minor)).cast(kind)).alias("_c"))
    rest = F.pmod("_c", size.cast(kind))
    number = F.floor((F.col("_c") - rest) / size) if high is None else F.shiftright("_c", 31)
    number = F.when(number > 0, (number.cast(kind) + F.lit(str(low - 1)).cast(kind)).cast("long"))
    return best.select(key, number.alias(major), rest.cast("long").alias(minor))


def keep_smallest_rank(df: DataFrame, key: str, rank: str, payload: list[str]) -> DataFrame:
    """One row per key: the one of smallest rank (partial aggregation before the shuffle)."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*payload), F.col(rank)).alias("_p"), F.min(rank).alias(rank))
    return best.select(key, rank, *[F.col("_p")[p].alias(p) for p in payload])
