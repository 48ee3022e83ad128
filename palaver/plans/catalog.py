"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import class_queries, retrieval_queries, sample_queries, search_queries, source_queries, stat_queries, text_queries, thread_queries, topic_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["join2_flow_parent_value"](spark, folder)
