"""Projection and frame helpers shared by the other operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import wordlists as wl

SUBMISSION_FIELDS = [
    "banned_at_utc", "created_utc", "gilded", "is_self", "link_flair_text", "media", "name",
    "num_comments", "num_crossposts", "permalink", "score", "title", "url",
]


def backfill_name(df: DataFrame, prefix: str, name: str = "name", id_col: str = "id") -> DataFrame:
    """Fill a missing name with prefix + id."""
    return df.withColumn(name, F.coalesce(F.col(name), F.concat(F.lit(prefix), F.col(id_col))))


def keep_fields(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Project on the listed fields that exist."""
    have = set(df.columns)
    return df.select(*[f for f in fields if f in have])


def basic_submission_data(df: DataFrame) -> DataFrame:
    return keep_fields(df, SUBMISSION_FIELDS)


def add_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Add columns computed from the input row; all at once, none sees another."""
    return df.withColumns(new)


def extract_column(df: DataFrame, name: str) -> DataFrame:
    return df.select(name)


def rename_keys(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Rename columns; names that are absent are ignored."""
    return df.withColumnsRenamed(renames)


def json_without_nulls(*cols: Column | str) -> Column:
    """JSON object of the non-null fields."""
    return F.to_json(F.struct(*cols))


def map_without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


def vote_numbers(score="score", ups="ups", downs="downs") -> Column:
    return F.array(F.col(score), F.col(ups), F.col(downs))


def is_post(name: Column) -> Column:
    return F.coalesce(F.startswith(name, F.lit("t3_")), F.lit(False))


def common_search_fields() -> list[Column]:
    return [
        F.col("name").alias("reddit_name"),
        tx.iso_instant(tx.instant_from_utc(F.col("created_utc"))).alias("reddit_created"),
        F.col("ups").alias("reddit_n_ups"),
        F.col("downs").alias("reddit_n_downs"),
        F.col("score").alias("reddit_score"),
    ]


# Predicates -----------------------------------------------------------------------------

def is_comment_of_interest(flair: Column, body: Column, flairs=wl.SOCIOPOLITICAL_FLAIRS) -> Column:
    """Live comment in a thread of one of the chosen flairs."""
    return flair.isin(flairs) & (body != "[deleted]")


def long_enough(c: Column, n: int = 100) -> Column:
    return F.length(c) >= n


def contents_long_enough(xs: Column, n: int = 100) -> Column:
    return F.aggregate(F.transform(xs, F.length), F.lit(0), lambda a, x: a + x) >= n


def created_since(epoch: Column, since: int = 1_536_192_000) -> Column:
    """Created at or after an instant (default 2018-09-06); a missing date is excluded."""
    return epoch.cast("long") >= since


def short_and_live(body: Column, n: int = 500) -> Column:
    return (body != "[deleted]") & (F.length(body) <= n)


def missing_permalink(permalink: Column, body: Column) -> Column:
    return permalink.isNull() & (body != "[deleted]")


def heuristic_positive(raw: Column, literals=wl.PRAISE_LITERALS, patterns=wl.PRAISE_PATTERNS) -> Column:
    """Short text holding any of the phrases or patterns, accents and case folded."""
    folded = [_fold_literal(x) for x in literals]

    def test(text: Column) -> Column:
        return (F.length(text) < 2000) & (tx.contains_any(text, folded) | tx.matches_any(text, patterns))

    return F.coalesce(tx.bind(tx.fold(raw), test), F.lit(False))


def _fold_literal(word: str) -> str:
    return word.lower().translate(str.maketrans(tx.ACCENTED, tx.PLAIN))


def asks_source_only(raw: Column) -> Column:
    return F.coalesce(F.lower(raw).rlike(r"^\s*source\s*\?\s*$"), F.lit(False))


def removal_notice(raw: Column) -> Column:
    return F.coalesce(F.lower(raw).contains("ce commentaire a été supprimé"), F.lit(False))
