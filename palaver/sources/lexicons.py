"""Word vectors, stop-word lists and fitted vocabularies on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as rk

STOP_LINE = r"^([^\s\|]+).*"
VECTOR_LINE = r"^(\S+)((?: -?[0-9.eE+-]+)+)\s*$"


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Words at the start of a line; lines starting with a bar or a blank are comments."""
    word = F.regexp_extract("value", STOP_LINE, 1)
    return spark.read.text(path).select(word.alias("word")).filter("word <> ''").distinct()


def read_word_vectors(
    spark: SparkSession, path: str, n_first: int | None = None,
    normalize: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Vectors in the text format `token x x x ...` -> (idx, token, vec).

    idx follows the order of the lines (frequency order in published models). With n_first, only
    that many lines are taken. `normalize` maps tokens, null drops one; of lines with the same
    token the first wins. A header line "N dim" has no vector and is left out.
    """
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", order.alias("pos")).filter(~F.col("value").rlike(r"^\d+ \d+\s*$"))
    if n_first is not None:
        lines = rk.top_n(lines, [F.asc("pos")], n_first)
    token = F.regexp_extract("value", VECTOR_LINE, 1)
    numbers = F.split(F.trim(F.regexp_extract("value", VECTOR_LINE, 2)), " ").cast("array<float>")
    token = normalize(token) if normalize else token
    parsed = lines.filter(F.col("value").rlike(VECTOR_LINE)).select("pos", token.alias("token"), numbers.alias("vec"))
    first = rk.keep_smallest_rank(parsed.filter("token IS NOT NULL"), "token", "pos", ["vec"])
    return rk.with_global_rank(first, [F.asc("pos")], "idx").select((F.col("idx") - 1).alias("idx"), "token", "vec")


def write_word_vectors(df: DataFrame, token: str, vec: str, order: str, path: str) -> None:
    """Vectors as text lines in a given order."""
    line = F.concat_ws(" ", F.col(token), F.array_join(F.col(vec).cast("array<string>"), " "))
    df.orderBy(order).select(line.alias("value")).write.text(path)


def save_vectorizer(model: CountVectorizerModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_vectorizer(path: str) -> CountVectorizerModel:
    return CountVectorizerModel.load(path)
