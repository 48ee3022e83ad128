"""Mixing sources to target weights by hash-threshold histograms.

Every row has a place on a line, a hash of its id. A source is taken whole floor(target / size) times; of the rest of
its budget a prefix of the line is taken. Where the prefix ends is found in a histogram of tokens by source and hash
bucket; only the bucket in which the budget runs out is looked at again, in finer buckets, until no bucket is left to
split. Rows are then filtered by comparing hashes: nothing is sorted, and a smaller budget takes a subset of what a
larger one takes. A source that holds most rows only makes its buckets heavier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, stored, word_count

WEIGHTS = (3, 1, 2)  # by rank of the source, repeating
SHARE_PERCENT = 150  # of all tokens
MOST_TIMES = 2  # of the tokens of a source
HASH_HEX = 15  # 60 bits of the hash, a positive long
LEVEL_HEX = 3  # 12 bits, 4096 buckets per source and level


def place(key: Column, seed: str = "mix") -> Column:
    """Place on the line: 60 bits of a hash of seed and key. Rows without a key share one place."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, HASH_HEX), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """Rows (source, source_size) with the target of each source added.

    Sources by code point, null last, weigh `weights` in turn. Targets proportional to the weights that would exceed
    `most` times the source's size stop there, and the excess is shared again by weight, until none is above. The
    fixed point is found at once: in the order of size / weight the first k sources are at their limit, the others
    get a common amount per unit of weight. One row per source meets in one task here; no sources give no rows.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    ranked = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).cast("double").alias("limit"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole) * share_percent / F.lit(100.0)
    # what a unit of weight gets if all sources before this one are at their limit
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after)
    leveled = ranked.withColumn("level", level)
    free = F.col("level") < F.col("limit") / F.col("w")
    common = F.min(F.when(free, F.struct(F.col("limit") / F.col("w"), "level"))).over(whole)["level"]
    return leveled.select("source", "source_size", F.coalesce(F.least("limit", common * F.col("w")), F.col("limit")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, budget) to (source, cut): rows with at < cut fit in the budget, and the row at cut does not.

    rows: (source, at, size). Each level adds up the tokens by bucket inside what is still open and keeps for each
    source the bucket in which the budget runs out. A source whose rows all fit has a cut beyond the line.
    """
    end = 1 << (4 * HASH_HEX)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    open_ = budgets.select("source", "budget", F.lit(0).cast("long").alias("bucket"), F.lit(False).alias("fits"))
    depth = 0
    while depth < HASH_HEX:
        below = 4 * (HASH_HEX - depth)
        depth += LEVEL_HEX
        shift = 4 * (HASH_HEX - depth)
        todo = checked_broadcast(stored(open_))
        inside = rows.join(todo, same(rows, todo) & ~todo["fits"] & (F.shiftright(rows["at"], below) == todo["bucket"]))
        sums = inside.groupBy(rows["source"].alias("source"), F.shiftright("at", shift).alias("b")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("b"))
        over = sums.withColumn("upto", upto).join(todo.select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s")))
        over = over.filter(F.col("upto") > F.col("budget"))
        first = over.groupBy("source").agg(F.min_by(F.struct("b", F.col("upto") - F.col("n")), "b").alias("x"))
        first = first.select(F.col("source").alias("s"), F.col("x")["b"].alias("b"), F.col("x")["col2"].alias("spent"))
        joined = todo.join(first, todo["source"].eqNullSafe(first["s"]), "left")
        fits = F.col("fits") | F.col("b").isNull()
        open_ = joined.select(
            "source", (F.col("budget") - F.when(fits, 0).otherwise(F.col("spent"))).alias("budget"),
            F.when(fits, F.lit(end)).otherwise(F.col("b")).alias("bucket"), fits.alias("fits"))
    return open_.select("source", F.col("bucket").alias("cut"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES, seed: str = "mix", keep: list[str] = ()) -> DataFrame:
    """(id, source, size, source_size, target, taken, copies) and the columns of `keep` for every row of docs.

    size counts words (null text: 0); taken is a multiple of size, at most `most` times. Each source's taken words
    fall short of its target by less than its largest document (ids shared by several rows are taken together). A
    null source is a source of its own, null ids share one place on the line; no documents give no rows. Of other
    columns none is read, whatever their names.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *keep)
    src = src.withColumn("at", place(F.col("id"), seed))
    rows = stored(src.select("id", "source", "size", "at"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stored(targets(sizes, weights, share_percent, most))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = goal.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    cut = thresholds(rows, plan.select("source", "budget")).withColumnRenamed("source", "s")
    plan = checked_broadcast(stored(plan.join(cut, plan["source"].eqNullSafe(cut["s"])).drop("s").withColumnRenamed("source", "s")))
    every = src if keep else rows
    taken = every.join(plan, every["source"].eqNullSafe(plan["s"]))
    copies = F.least(F.lit(most), F.col("times") + F.when(F.col("at") < F.col("cut"), 1).otherwise(0))
    return taken.select("id", *keep, "source", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"))
