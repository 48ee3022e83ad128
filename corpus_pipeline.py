"""Corpus pipeline: toxicity, near duplicates, decontamination, source mixing, sharding.

Each stage gets all that the one before kept, and its decisions take effect: rows that it rejects are gone from what
it returns. run() writes what a stage returns to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import decontam, jaccard, mixing, sharding, toxicity
from palaver.llm.common import checked_broadcast, stored, tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDED = ["size", "text_crc32", "shard", "slot"]


def row_key() -> Column:
    """A number for each pair of id and text. Ids and texts are hashed together: rows without an id, or with one that others have,
    are told apart by their texts, and no id can be taken for the hash of a text."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def carried(docs: DataFrame) -> DataFrame:
    """What the operators read, and the whole row as one column, so that no name in it can clash with theirs."""
    return docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted to be toxic."""
    scored = toxicity.score(carried(docs), tables(spark, sf_dir, "labels"), keep=["_row"])
    return scored.filter("predicted = 0").select("_row.*")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, one without id if no other is there.

    Of rows that share an id, and of repeated rows, one stays as well if they are in one group. Documents without words
    are in no group and stay.
    """
    keyed = docs.select(row_key().alias("_key"), "text")
    groups = stored(jaccard.near_duplicates(keyed, id_col="_key"))
    member = groups.filter("n_shingles > 0").groupBy("id", "component_id").agg(F.count("*").alias("n"))
    member = stored(member)
    several = stored(member.filter("id <> component_id").select("component_id").distinct())
    others = member.join(checked_broadcast(several), "component_id", "left_semi").select("id", "component_id")
    ids = docs.select(row_key().alias("id"), "doc_id")
    others = stored(others.join(ids, "id").groupBy("id", "component_id").agg(F.min("doc_id").alias("doc_id")))
    first = others.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id"))["id"].alias("first"))
    gone = stored(others.join(checked_broadcast(stored(first)), "component_id").filter("id <> first").select("id"))
    rows = docs.select(row_key().alias("id"), F.struct("*").alias("_row"))
    kept = rows.join(checked_broadcast(gone), "id", "left_anti")
    repeated = stored(member.filter("n > 1").select("id"))
    n = repeated.count()
    if n:
        again = checked_broadcast(repeated, rows=n)
        one = kept.join(again, "id", "left_semi").groupBy("id").agg(F.first("_row").alias("_row"))
        kept = kept.join(again, "id", "left_anti").union(one)
    return kept.select("_row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    found = decontam.find(docs.select(row_key().alias("_key"), "text"), tables(spark, sf_dir, "benchmark"), id_col="_key")
    gone = checked_broadcast(stored(decontam.contaminated_ids(found)))
    rows = docs.select(row_key().alias("id"), F.struct("*").alias("_row"))
    return rows.join(gone, "id", "left_anti").select("_row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents without words count nothing and stay once."""
    mixed = mixing.mix(carried(docs), keep=["_row"])
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    return mixed.filter(times > 0).select("_row", F.explode(F.sequence(F.lit(1), times))).select("_row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, checksum, shard and slot; columns of their own with these names are called doc_<name>."""
    out = sharding.shard(carried(docs), keep=["_row"])
    own = [F.col("_row")[c].alias(f"doc_{c}" if c in SHARDED else c) for c in docs.columns]
    return out.select(*own, *SHARDED)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing_sources", mixing_stage),
    ("sharding", sharding_stage),
]

# Classifiers and similarity groups cannot be said in SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
