"""JSON dumps of comments and submissions, and the named datasets built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import backfill_name

COMMENT_SCHEMA = """id string, name string, link_id string, parent_id string, body string, author string,
subreddit string, subreddit_id string, created_utc string, score bigint, gilded bigint, controversiality bigint,
ups bigint, downs bigint, permalink string, edited string, stickied string, archived string, is_submitter string,
distinguished string, author_flair_text string"""
SUBMISSION_SCHEMA = """id string, name string, title string, selftext string, url string, permalink string,
link_flair_text string, link_flair_type string, subreddit string, created_utc string, banned_at_utc string,
score bigint, ups bigint, downs bigint, num_comments bigint, num_crossposts bigint, num_reports bigint, gilded bigint,
is_self boolean, media struct<type:string>"""
CORRUPT = "_corrupt_record"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text files, one row per line (column `value`)."""
    return spark.read.text(path)


def decode_json(lines: DataFrame, schema: str, keep_raw: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Decode one JSON object per line, beside the columns of `keep`; undecodable lines come out with only `_corrupt_record` set."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", options).alias("r")
    cols = [*keep, "r.*"] + ([F.col("value").alias("raw_json")] if keep_raw else [])
    return lines.select(*keep, parsed, "value").select(*cols)


def read_dump(spark: SparkSession, path: str | list[str], schema: str, community: str | None = None) -> DataFrame:
    """Scan JSON-lines files (compressed ones too) with a fixed schema.

    The community test goes into the JSON reader, which skips the other rows early.
    """
    df = spark.read.schema(schema).json(path)
    return df.filter(F.col("subreddit") == community) if community else df


def ingest_dump(spark: SparkSession, source: str | list[str], target: str, schema: str, community: str) -> None:
    """Keep the rows of one community and store them as gzipped JSON lines."""
    read_dump(spark, source, schema, community).write.option("compression", "gzip").json(target)


def comments_all(spark: SparkSession, root: str) -> DataFrame:
    """All comments under a root folder, names filled in."""
    return backfill_name(spark.read.parquet(f"{root}/comments"), "t1_")


def submissions_all(spark: SparkSession, root: str) -> DataFrame:
    return backfill_name(spark.read.parquet(f"{root}/submissions"), "t3_")


def raw_content(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """Key-value rows (reddit_name, reddit_doc__json) of all original records."""
    def rows(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), "id").alias("reddit_name"), F.to_json(F.struct("*")).alias("reddit_doc__json"))

    return rows(comments, "t1_").unionByName(rows(submissions, "t3_"))
