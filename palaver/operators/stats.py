"""Counts, censuses, histograms, running totals, contingency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions import text as tx
from ..functions import vectors as vc
from . import ranking as rk


def count_by(df: DataFrame, **keys: Column) -> DataFrame:
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count("*").alias("n"))


def feature_census(df: DataFrame, features: Column) -> DataFrame:
    """Number of rows holding each feature."""
    exploded = df.select(F.explode(features).alias("feature"))
    return exploded.groupBy("feature").agg(F.count("*").alias("n"))


def length_buckets(df: DataFrame, text: Column) -> DataFrame:
    """Documents, characters and words per word-count bucket."""
    sized = df.select(F.length(text).cast("long").alias("chars"), F.size(tx.split_words(text)).cast("long").alias("words"))
    return sized.groupBy(tx.high_one_bit(F.col("words")).alias("bucket")).agg(
        F.count("*").alias("n_docs"), F.sum("chars").alias("n_chars"), F.sum("words").alias("n_words"))


def running_totals(buckets: DataFrame, bucket: str, measures: list[str]) -> DataFrame:
    """Cumulative measures from the largest bucket down.

    The input is an aggregate over power-of-two buckets, at most 65 rows.
    """
    w = Window.orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return buckets.withColumns({f"cum_{m}": F.sum(m).over(w) for m in measures})


def term_statistics(docs: DataFrame, tokens: str) -> tuple[DataFrame, DataFrame]:
    """Per-term totals, and one row with the corpus total and the number of documents.

    The corpus row comes from array sizes, so it needs no shuffle of the tokens.
    """
    bags = docs.select(F.explode(tx.bag_of_words(F.col(tokens))).alias("b"))
    per_term = bags.groupBy(F.col("b.term").alias("term")).agg(F.sum("b.tf").alias("n_term"))
    overall = docs.agg(F.sum(F.size(tokens).cast("long")).alias("n_total"), F.count("*").alias("n_docs"))
    return per_term, overall


def document_frequency(df: DataFrame, grams: Column, vocab_size: int) -> DataFrame:
    """The vocab_size grams found in most rows; ties go to the smaller gram."""
    counts = df.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n_docs_with"))
    return rk.top_n(counts, [F.desc("n_docs_with"), F.asc("gram")], vocab_size)


def contingency(df: DataFrame, heuristic: str, label: str) -> DataFrame:
    """2 x 2 counts with zero defaults."""
    h, r = F.col(heuristic), F.col(label)
    return df.agg(
        F.count_if(h & r).alias("n_h_r"), F.count_if(~h & r).alias("n_noth_r"),
        F.count_if(h & ~r).alias("n_h_notr"), F.count_if(~h & ~r).alias("n_noth_notr"))


def score_histogram(df: DataFrame, score: Column) -> DataFrame:
    return df.groupBy(nm.decimal_bucket(score).alias("bucket")).agg(F.count("*").alias("n"))


def mean_pairwise_cosine(a: DataFrame, b: DataFrame, vec: str, dim: int) -> DataFrame:
    """Mean cosine over all pairs of two vector sets, without forming the pairs.

    The mean over pairs equals the dot product of the two mean unit vectors; a zero
    vector has similarity 0 with everything, as its unit vector is zero.
    """
    units = [df.select(F.lit(side).alias("side"), vc.unit(F.col(vec)).alias("u")) for side, df in enumerate((a, b))]
    sums = units[0].unionByName(units[1]).groupBy("side").agg(
        vc.sum_per_dim(F.col("u"), dim).alias("s"), F.count("*").alias("n"))
    means = sums.select("side", vc.scale(F.col("s"), F.lit(1.0) / F.col("n")).alias("m"))
    both = means.agg(*[F.max(F.when(F.col("side") == i, F.col("m"))).alias(f"m{i}") for i in (0, 1)])
    return both.select(vc.dot(F.col("m0"), F.col("m1")).alias("mean_sim"))
