"""Joins between posts, comments and their parents.

The "one" side of each join is reduced to one row per key first; the "many" side may hold
any number of rows per key (a single thread can hold a third of all comments). Nothing here
groups a thread into one row or task: joins stay row-wise, hot keys are measured and salted,
and rows without a key are spread instead of meeting in one partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as nm
from .sizing import hot_keys, pin_small

NO_KEY = "\x00"


def one_per_key(df: DataFrame, key: str, prefer: str | None = None) -> DataFrame:
    """One row per key: the first by `prefer` (created_utc where there is one), then by a hash of the row.

    Which row stays does not depend on partitions or retries.
    """
    others = [c for c in df.columns if c != key]
    if not others:
        return df.distinct()
    first = prefer or ("created_utc" if "created_utc" in others else None)
    order = F.struct(*([F.col(first)] if first else []), F.xxhash64(*others))
    best = df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_best"))
    return best.select(key, *[F.col("_best")[c].alias(c) for c in others]).select(*df.columns)


def lookup(many: DataFrame, one: DataFrame, key: str, row_id: str, found: str | None = None) -> DataFrame:
    """Left join `many` with `one` (unique on `key`); null keys never meet.

    Hot keys of `many` are split into parts by a hash of the row id, and their single rows in
    `one` are repeated once per part, at most a few hundred rows more in all. (Adaptive
    skew handling does not apply when one side comes straight out of an aggregation.)
    `found` names a boolean column telling whether a partner exists.
    """
    right = one.filter(F.col(key).isNotNull())
    if found:
        right = right.withColumn(found, F.lit(True))
    spread = F.coalesce(F.col(key), F.concat(F.lit(NO_KEY), F.col(row_id).cast("string")))
    left = many.withColumn("_lk", spread)
    right = right.withColumnRenamed(key, "_lk")
    on = ["_lk"]
    hot = hot_keys(many, key)
    if hot is not None:
        parts = hot.withColumnRenamed(key, "_lk")
        left = left.join(parts, "_lk", "left").withColumn(
            "_salt", F.pmod(F.xxhash64(row_id), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        right = right.join(parts, "_lk", "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        on = ["_lk", "_salt"]
    out = left.join(right, on, "left").drop(*on)
    return out.withColumn(found, F.coalesce(F.col(found), F.lit(False))) if found else out


def lookup_inner(many: DataFrame, one: DataFrame, key: str, row_id: str) -> DataFrame:
    """As lookup, but rows without a partner are dropped."""
    return lookup(many, one, key, row_id, "_hit").filter("_hit").drop("_hit")


def enrich_with_submission(comments: DataFrame, subm: DataFrame, into: str, fields: list[str]) -> DataFrame:
    """Attach the listed submission fields as struct `into` (null when the post is unknown)."""
    when = [c for c in ("created_utc",) if c in subm.columns]
    data = one_per_key(subm.select(*dict.fromkeys(["name", *fields, *when])), "name")
    data = data.select(F.col("name").alias("link_id"), F.struct(*fields).alias(into))
    return lookup(comments, data, "link_id", "name")


def flow_parent_value(
    nodes: DataFrame,
    value: Column,
    merge: Callable[[Column, Column], Column],
    into: str,
    id_col: str = "name",
    parent_col: str = "parent_id",
) -> DataFrame:
    """Propagate a parent's value one hop to its children.

    `merge(own, parent)` gives the child's new `into`; roots and orphans keep theirs.
    Duplicate ids collapse to one node.
    """
    nodes = one_per_key(nodes, id_col)
    parents = nodes.select(F.col(id_col).alias(parent_col), value.alias("_flow"))
    joined = lookup(nodes, parents.filter(F.col("_flow").isNotNull()), parent_col, id_col)
    merged = F.when(F.col("_flow").isNotNull(), merge(F.col(into), F.col("_flow"))).otherwise(F.col(into))
    return joined.withColumn(into, merged).drop("_flow")


def enrich_with_parents(everything: DataFrame, selected: DataFrame, into: str, fields: list[str]) -> DataFrame:
    """Attach the parent comment record to a selected subset.

    The parents are first cut down to those that are asked for.
    """
    wanted = selected.select(F.col("parent_id").alias("name")).filter("name IS NOT NULL").distinct()
    parents = everything.join(pin_small(wanted), "name", "left_semi")
    parents = one_per_key(parents.select(*dict.fromkeys(["name", *fields])), "name")
    parents = parents.select(F.col("name").alias("parent_id"), F.struct(*fields).alias(into))
    return lookup(selected, parents, "parent_id", "name")


def submissions_of_sample(sample: DataFrame, subm: DataFrame, into: str, fields: list[str]) -> DataFrame:
    """Attach submission records to a sample of comments, pruning submissions to those needed."""
    wanted = sample.select(F.col("link_id").alias("name")).filter("name IS NOT NULL").distinct()
    return enrich_with_submission(sample, subm.join(pin_small(wanted), "name", "left_semi"), into, fields)


def co_group(subm: DataFrame, comments: DataFrame, fields: list[str]) -> DataFrame:
    """Threads with their comments, one row per (submission, comment).

    Comments without a post are dropped; a post without comments gives one row whose
    `cmt` is null. Kept flat, so a thread of any size stays spread over tasks.
    """
    posts = one_per_key(subm, "name").withColumnRenamed("name", "subm_name")
    cmts = comments.filter("link_id IS NOT NULL").select(
        F.col("link_id").alias("subm_name"), F.struct(*fields).alias("cmt"))
    # The comments look up their post (a hot thread is split); silent posts come from an anti join.
    answered = lookup_inner(cmts, posts, "subm_name", "cmt").select(*posts.columns, "cmt")
    silent = posts.join(cmts.select("subm_name").distinct(), "subm_name", "left_anti")
    return answered.unionByName(silent.withColumn("cmt", F.lit(None).cast(answered.schema["cmt"].dataType)))


def chunked_lists(df: DataFrame, key: str, item: str, row_id: str, per_row: int = 1000) -> DataFrame:
    """Items per key as arrays of about `per_row`: (key, chunk, n_chunks, items).

    The number of chunks of a key grows with its size, and a stable hash of the row id
    picks the chunk, so no single task or row has to hold a whole hot key.
    """
    sizes = df.groupBy(key).agg(F.ceil(F.count("*") / per_row).cast("long").alias("n_chunks"))
    u = nm.keyed_uniform(F.col(row_id).cast("string"))
    placed = lookup_inner(df, sizes, key, row_id).withColumn("chunk", F.floor(u * F.col("n_chunks")).cast("long"))
    return placed.groupBy(key, "n_chunks", "chunk").agg(F.array_sort(F.collect_list(item)).alias("items"))


def bundle_threads(subm: DataFrame, comments: DataFrame, fields: list[str], per_row: int = 1000) -> DataFrame:
    """Submission bundles with their comments as lists, a huge thread in several chunks.

    A post without comments has one row with an empty list.
    """
    posts = one_per_key(subm, "name")
    cmts = comments.filter("link_id IS NOT NULL").select(
        "link_id", F.col("name").alias("_id"), F.struct(*fields).alias("_item"))
    lists = chunked_lists(cmts, "link_id", "_item", "_id", per_row).withColumnRenamed("link_id", "name")
    # The chunks look up their post, so those of a hot thread stay in many tasks; silent posts come from an anti join.
    lists = lists.withColumn("_chunk_id", F.concat_ws("/", "name", F.col("chunk").cast("string")))
    answered = lookup_inner(lists, posts, "name", "_chunk_id")
    silent = posts.join(cmts.select(F.col("link_id").alias("name")).distinct(), "name", "left_anti")
    shown = [*posts.columns, "chunk", "n_chunks", "items"]
    empty = F.array().cast(answered.schema["items"].dataType)
    silent = silent.select(*posts.columns, F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("n_chunks"), empty.alias("items"))
    return answered.select(*shown).unionByName(silent).withColumnRenamed("items", "dgms_submdb_comments_list")


def children_of(nodes: DataFrame) -> DataFrame:
    """One row per (parent, child) for parents that are present."""
    parents = nodes.select(F.col("name").alias("parent_name")).distinct()
    children = nodes.filter("parent_id IS NOT NULL").select(
        F.col("parent_id").alias("parent_name"), F.col("name").alias("child_name"))
    return lookup_inner(children, parents, "parent_name", "child_name").select("parent_name", "child_name")


def thing_by_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Point lookup of nodes by a frame of names."""
    return nodes.join(names.select("name").distinct(), "name", "left_semi")
