"""Feature sets of posts and comments, for censuses and diversified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

COMMENT_COUNTS = ["score"]
SUBMISSION_COUNTS = ["score", "ups", "downs", "num_comments", "num_crossposts", "num_reports"]
SUBMISSION_VALUES = ["link_flair_text", "link_flair_type"]


def schema_keys(df: DataFrame, keys: list[str] | None = None) -> Column:
    """Which of the fields a row has: all columns of the frame, or those named; booleans with their value."""
    kinds = dict(df.dtypes)
    return tx.key_features({c: (F.col(c), kinds[c] == "boolean") for c in (keys or df.columns)})


def comment_features(df: DataFrame, keys: list[str] | None = None) -> Column:
    """Feature set of a comment row."""
    return tx.feature_set(
        schema_keys(df, keys),
        *[tx.integer_features(f, F.col(f)) for f in COMMENT_COUNTS],
        tx.timestamp_features("created_utc", F.col("created_utc")),
        tx.textual_features("body", F.col("body")),
    )


def submission_features(df: DataFrame, keys: list[str] | None = None) -> Column:
    """Feature set of a submission row; fields that the frame lacks give no features."""
    return tx.feature_set(
        schema_keys(df, keys),
        *[tx.value_feature(f, F.col(f)) for f in SUBMISSION_VALUES if f in df.columns],
        tx.textual_features("title", F.col("title")),
        tx.textual_features("selftext", F.col("selftext")),
        tx.timestamp_features("created_utc", F.col("created_utc")),
        *[tx.integer_features(f, F.col(f)) for f in SUBMISSION_COUNTS if f in df.columns],
    )
