"""Record stores: Parquet by default, sequence files for older data, JSON documents, keyed sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = "org.apache.hadoop.io.Text"
BYTES = "org.apache.hadoop.io.BytesWritable"


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store nested records as Parquet."""
    df.write.mode(mode).parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_text_sequence(df: DataFrame, col: str, path: str) -> None:
    """Text column -> sequence file of ("", text) pairs."""
    df.select(col).rdd.map(lambda r: ("", r[0])).saveAsSequenceFile(path)


def read_text_sequence(spark: SparkSession, path: str) -> DataFrame:
    """Values of a text sequence file; keys are dropped."""
    return spark.sparkContext.sequenceFile(path, TEXT, TEXT).values().map(lambda v: (v,)).toDF("value string")


def write_bytes_sequence(df: DataFrame, key: str, value: str, path: str) -> None:
    """(text key, binary value) -> sequence file."""
    pairs = df.select(F.col(key).cast("string"), F.col(value).cast("binary")).rdd.map(lambda r: (r[0], bytearray(r[1])))
    pairs.saveAsNewAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat", keyClass=TEXT, valueClass=BYTES)


def read_bytes_sequence(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) rows of a text/bytes sequence file."""
    pairs = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.SequenceFileInputFormat", TEXT, BYTES)
    return pairs.map(lambda kv: (kv[0], bytes(kv[1]))).toDF("key string, value binary")


def write_json_documents(df: DataFrame, path: str) -> None:
    """Gzipped JSON documents, one per line."""
    df.write.option("compression", "gzip").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: str, pretty: bool = False) -> DataFrame:
    """JSON documents, compressed or not; `pretty` for files holding one multi-line document."""
    return spark.read.schema(schema).option("multiLine", pretty).json(path)


def latest_per_key(df: DataFrame, key: str, version: Column | None = None) -> DataFrame:
    """One row per key, as an upsert by id would leave it: largest version, then largest hash of the row."""
    others = [c for c in df.columns if c != key]
    if not others:
        return df.distinct()
    order = F.struct(*([version] if version is not None else []), F.xxhash64(*others))
    best = df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in others]).select(*df.columns)


def write_index(
    df: DataFrame, key: str, path: str, fmt: str = "parquet", version: Column | None = None,
    mode: str = "errorifexists", **options,
) -> None:
    """Keyed document sink: one document per key in any Spark output format.

    `options` go to the writer, so a search-store connector on the class path is a format name away.
    """
    latest_per_key(df, key, version).write.format(fmt).options(**options).mode(mode).save(path)
