"""A label table keyed by (dataset_id, datapoint_id), as pure DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["dataset_id", "datapoint_id"]
LABEL_SCHEMA = "dataset_id string, datapoint_id string, payload string, label double, label_time bigint"


def save_labels(table: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by key: the latest label wins (`new` wins a tie).

    One aggregation with map-side partial results, so a key labelled very often is no hot spot.
    """
    rows = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c not in KEY]
    latest = F.max_by(F.struct(*rest), F.struct("label_time", "_new")).alias("_r")
    return rows.groupBy(*KEY).agg(latest).select(*KEY, *[F.col("_r")[c].alias(c) for c in rest]).select(*table.columns)


def already_labelled(table: DataFrame, dataset: str, items: DataFrame, id_col: str = "datapoint_id") -> DataFrame:
    """Items tagged with whether the dataset holds a label for them."""
    known = table.filter(F.col("dataset_id") == dataset).select(F.col("datapoint_id").alias(id_col)).distinct()
    joined = items.join(known.withColumn("labelled", F.lit(True)), id_col, "left")
    return joined.withColumn("labelled", F.coalesce("labelled", F.lit(False)))


def labels_of(table: DataFrame, dataset: str) -> DataFrame:
    return table.filter(F.col("dataset_id") == dataset)


def count_labelled(table: DataFrame, dataset: str) -> DataFrame:
    return labels_of(table, dataset).agg(F.count("*").alias("n"))


def clear_labels(table: DataFrame, dataset: str) -> DataFrame:
    return table.filter(F.col("dataset_id") != dataset)


def correct_labels(table: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replace the label of the listed keys; all other rows stay. Of several corrections the last by label_time
    counts where there is one, then the larger label."""
    when = [F.col(c) for c in ("label_time",) if c in corrections.columns]
    fix = corrections.groupBy(*KEY).agg(F.max_by("label", F.struct(*when, "label")).alias("_fixed"))
    return table.join(fix, KEY, "left").withColumn("label", F.coalesce("_fixed", "label")).drop("_fixed").select(*table.columns)


def replace_payload(table: DataFrame, payload: Column) -> DataFrame:
    return table.withColumn("payload", payload)


def false_negatives(scored: DataFrame, threshold: float) -> DataFrame:
    """Positive rows scored below the threshold, lowest score first."""
    return scored.filter((F.col("label") > 0.5) & (F.col("score") < threshold)).orderBy("score", "datapoint_id")
