"""Comments and posts stored side by side by thread, so that joining them moves no rows.

Both tables are bucketed and sorted by thread and part. A thread with more than `part_rows` comments has several parts,
each with a copy of its post, so that no bucket has to hold a hot thread; comments without a thread are spread by their own name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import pin_small
from ..operators.threads import NO_KEY, one_per_key
from ..session import write_once

PLACE = ["_thread", "_part"]
PART_ROWS = 1_000_000


@dataclass(frozen=True)
class Store:
    """The two tables of a folder, known to the session's catalog by names made from the folder's."""

    spark: SparkSession
    path: str

    def name(self, table: str) -> str:
        return f"threads_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{table}"

    @property
    def comments(self) -> DataFrame:
        return self.spark.table(self.name("comments"))

    @property
    def posts(self) -> DataFrame:
        return self.spark.table(self.name("posts"))


def write(comments: DataFrame, posts: DataFrame, path: str, n_buckets: int = 64, part_rows: int = PART_ROWS) -> Store:
    """Store comments (name, link_id, ...) and posts (name, ...; the first of several with one name) by thread.

    Both sides are shuffled here, once, for all joins to come. Choose n_buckets so that a bucket is a task's work.
    """
    if taken := set(PLACE) & {*comments.columns, *posts.columns}:
        raise ValueError(f"columns {sorted(taken)} are the store's own")
    store = Store(comments.sparkSession, path.rstrip("/"))
    sizes = comments.filter("link_id IS NOT NULL").groupBy("link_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > part_rows)
    hot = pin_small(sizes.select(F.col("link_id").alias("_thread"), F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    thread = F.coalesce("link_id", F.concat(F.lit(NO_KEY), "name"))
    placed = comments.withColumn("_thread", thread).join(hot, "_thread", "left")
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("name", F.lit("part")), parts).cast("int")).select(*comments.columns, *PLACE)
    heads = one_per_key(posts.filter("name IS NOT NULL"), "name").withColumn("_thread", F.col("name")).join(hot, "_thread", "left")
    heads = heads.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*posts.columns, *PLACE)
    for table, rows in (("comments", placed), ("posts", heads)):
        # the same hash places rows here and in the buckets: one file for each
        rows = rows.repartition(n_buckets, *PLACE)
        rows.write.bucketBy(n_buckets, *PLACE).sortBy(*PLACE).option("path", f"{store.path}/{table}").saveAsTable(store.name(table))
    store.spark.createDataFrame([(n_buckets,)], "n_buckets int").coalesce(1).write.json(f"{store.path}/about")
    return store


def open_store(spark: SparkSession, path: str) -> Store:
    """A store written by another session: its tables are named in this session's catalog."""
    store = Store(spark, path.rstrip("/"))
    n = spark.read.schema("n_buckets int").json(f"{store.path}/about").first()[0]
    for table in ("comments", "posts"):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{store.path}/{table}").schema)
        place = ", ".join(PLACE)
        location = f"{store.path}/{table}".replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {store.name(table)} ({fields}) USING parquet CLUSTERED BY ({place}) SORTED BY ({place}) INTO {n} BUCKETS LOCATION '{location}'")
    return store


def enriched(store: Store, into: str, fields: list[str]) -> DataFrame:
    """Comments with the listed fields of their post as struct `into`, null where the post is unknown. No exchange."""
    posts = store.posts.select(*PLACE, F.struct(*fields).alias(into))
    return store.comments.hint("merge").join(posts, PLACE, "left").drop(*PLACE)


def co_group(store: Store, fields: list[str]) -> DataFrame:
    """Posts with their comments, one row for each pair; comments without a post are dropped, a silent post has one row with a null `cmt`.

    No exchange. Only the first part of a thread can say that it is silent, so parts without comments of a hot thread are dropped.
    """
    cmts = store.comments.filter("link_id IS NOT NULL").select(*PLACE, F.struct(*fields).alias("cmt"))
    out = store.posts.hint("merge").join(cmts, PLACE, "left").filter((F.col("_part") == 0) | F.col("cmt").isNotNull())
    split = write_once(store.posts.groupBy("_thread").agg(F.max("_part").alias("_last")).filter("_last > 0"))
    if not split.isEmpty():  # the first part of a hot thread may have no comments by chance
        busy = pin_small(store.comments.filter("link_id IS NOT NULL").select("_thread").distinct().join(F.broadcast(split.select("_thread")), "_thread", "left_semi"))
        silent = F.col("cmt").isNull()
        out = out.filter(~silent).unionByName(out.filter(silent).join(busy, "_thread", "left_anti"))
    return out.drop(*PLACE).withColumnRenamed("name", "subm_name")


def bundles(store: Store, fields: list[str]) -> DataFrame:
    """(name, part, items): the comments of each part of a thread as a list, grouped where they lie; silent posts have an empty one. No exchange.

    A list is at most about part_rows long, whatever the size of the thread.
    """
    lists = store.comments.filter("link_id IS NOT NULL").groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    joined = store.posts.hint("merge").join(lists, PLACE, "left")
    none = F.array().cast(lists.schema["items"].dataType)
    return joined.withColumn("items", F.coalesce("items", none)).withColumn("part", F.col("_part").cast("long")).drop(*PLACE)
