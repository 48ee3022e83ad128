"""Sharding by Karmarkar-Karp differencing: equal bytes per shard although groups of rows cannot be divided.

Rows of equal text form a group. Partial partitions are combined, always the two of largest spread and in opposite
order, until one is left. The items that are differenced are the groups themselves while there are at most ITEMS; of
more groups, those heavier than a share of 1 / ITEMS of everything stay items of their own, and the others are bundled
by hash, so that the list has at most 2 ITEMS sums however large the data.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, stored

SHARDS = 40
ITEMS = 16_384  # bundles of light groups; also most heavy groups
SLOT_ROWS = 50_000  # rows numbered by one task, about
OVERHEAD = 16  # bytes of a row besides its text


def differencing(items: list[tuple[list[float], list]], k: int) -> list[tuple[float, list]]:
    """Combine partial partitions into one.

    items: partial partitions, each a list of up to k (sum, members) pairs. Returns k (sum, members) pairs, largest
    first. Ties go by the order given. No items give k empty parts.
    """
    heap = []
    for n, parts in enumerate(items):
        parts = sorted(parts, key=lambda x: -x[0]) + [(0, [])] * (k - len(parts))
        heap.append((parts[-1][0] - parts[0][0], n, parts))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = []
        for (x, p), (y, q) in zip(a, reversed(b)):
            if len(p) < len(q):
                p, q = q, p
            if q:
                p.extend(q)
            both.append((x + y, p))
        both.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (both[-1][0] - both[0][0], n, both))
        n += 1
    return heap[0][2] if heap else [(0, [])] * k


def balance(groups: DataFrame, k: int, items: int = ITEMS) -> DataFrame:
    """(key, weight), one row per group, to (key, shard) with near equal weights of the shards 0 to k - 1."""
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    alone = F.lit(True) if n <= items else F.col("weight") * items >= total
    bundle = F.concat(F.lit("bundle "), F.pmod(F.xxhash64("key"), F.lit(items)).cast("string"))
    named = groups.select("key", "weight", F.when(alone, F.col("key")).otherwise(bundle).alias("item"))

    def difference(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "item"], ascending=[False, True])
        parts = differencing([[(int(w), [item])] for item, w in zip(pdf["item"], pdf["weight"])], k)
        rows = [(item, shard) for shard, (_, members) in enumerate(parts) for item in members]
        return pd.DataFrame(rows, columns=["item", "shard"])

    sums = named.groupBy("item").agg(F.sum("weight").alias("weight"))
    sums = sums.withColumn("all", F.lit(0))  # at most 2 * items rows
    placed = stored(sums.groupBy("all").applyInPandas(difference, "item string, shard int"))
    return named.join(checked_broadcast(placed), "item").select("key", "shard")


def group_key(text: Column) -> Column:
    """Equal for equal texts; null texts are a group of their own."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))


def shard(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] = (), items: int = ITEMS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) and the columns of `keep` for every row of docs.

    size is the text's UTF-8 bytes plus 16 (null: 16, checksum 0). Rows of equal text, empty ones and null ones each
    too, share a shard, so one huge group sets the size of the largest shard; the others stay near equal. slot
    numbers the rows of a shard from 0 without gaps, in buckets by hash, so that a shard is never sorted by one task.
    Repeated rows get slots of their own. No rows give no rows. Reruns give the same result.
    """
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    base = docs.select(F.col(id_col).alias("id"), *keep, size.alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), group_key(text).alias("key"))
    light = base.select("id", "size", "text_crc32", "key") if keep else base
    rows = stored(light)
    placed = stored(balance(stored(rows.groupBy("key").agg(F.sum("size").alias("weight"))), n_shards, items))
    n = max(64, rows.count() // (n_shards * SLOT_ROWS))
    source = base if keep else rows
    sub = F.pmod(F.xxhash64("id", "key", F.lit("slot")), F.lit(n))
    placed_rows = source.join(placed, "key").withColumn("sub", sub)
    counts = rows.join(placed, "key").groupBy("shard", sub.alias("sub")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = checked_broadcast(stored(counts.select("shard", "sub", before.alias("start"))))
    nth = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("id", "key")) - 1
    out = placed_rows.join(starts, ["shard", "sub"]).withColumn("slot", (F.col("start") + nth).cast("long"))
    return out.select("id", *keep, "size", "text_crc32", "shard", "slot")
