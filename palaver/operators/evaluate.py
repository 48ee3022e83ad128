"""Evaluation measures as conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as nm
from . import stats as st


def binary_metrics(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, precision, recall and accuracy, overall or per group."""
    counts = [
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"),
    ]
    return rates(df.groupBy(*(by or [])).agg(*counts))


def rates(counts: DataFrame) -> DataFrame:
    """Add precision, recall and accuracy to confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0),
        "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0),
        "accuracy": F.when(tp + fp + fn + tn > 0, (tp + tn) / (tp + fp + fn + tn)),
    })


def recall_below(counts: DataFrame, threshold: float, true_pos: str = "tp", false_neg: str = "fn") -> DataFrame:
    """Add the probability that recall lies below the threshold (counts of hand-labelled rows)."""
    return counts.withColumn("p_recall_below", nm.beta_tail(F.lit(threshold), F.col(true_pos), F.col(false_neg)))


def heuristic_counts(interest: DataFrame, uniform: DataFrame, heuristic_sample: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of the counts behind the heuristic's quality.

    `interest` and `uniform` hold (name, h); `labels` holds (name, label). Rows of the
    heuristic sample already labelled in the uniform sample are left out there.
    """
    total = interest.agg(F.count_if("h").alias("n_hpos"), F.count_if(~F.col("h")).alias("n_hneg"))
    marked = labels.select("name", (F.col("label") > 0.5).alias("r"))
    table = st.contingency(uniform.join(marked, "name"), "h", "r")
    seen = uniform.join(marked, "name", "left_semi")
    fresh = heuristic_sample.join(seen.select("name"), "name", "left_anti").join(marked, "name")
    drawn = fresh.agg(F.count_if("r").alias("n1_h_r"), F.count_if(~F.col("r")).alias("n1_h_notr"))
    # three one-row frames, put side by side
    names = [c for d in (total, table, drawn) for c in d.columns]
    union = total.unionByName(table, allowMissingColumns=True).unionByName(drawn, allowMissingColumns=True)
    return union.agg(*[F.max(c).alias(c) for c in names])


def top_coefficients(coefs: DataFrame, n: int) -> DataFrame:
    """The n coefficients of largest absolute value."""
    return coefs.orderBy(F.desc(F.abs("coef")), "side", "block", "feature").limit(n)
