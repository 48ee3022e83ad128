"""Keyed tables that exist already: merged by rewriting the buckets that a change touches, and no others.

A table is a folder of Parquet files, one folder for each bucket of keys and each time that bucket was written, and a
log. A change writes the buckets it touches anew, beside the old ones, and then appends one file to the log that names them; readers follow
the log's latest row of each bucket. A change that fails, or loses executors, before its log file is there has not happened.
One writer at a time; any number of readers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_once

LOG_SCHEMA = "version long, part string, bucket int, folder string, n long"
OWN = ["_part", "_bucket"]


@dataclass(frozen=True)
class Table:
    """A keyed table. Rows whose `within` columns differ are in different buckets, so that they can go as a whole."""

    path: str
    keys: list[str]
    within: list[str]
    n_buckets: int
    schema: T.StructType

    def placed(self, df: DataFrame) -> DataFrame:
        """The rows with the bucket that their key belongs to; null keys are equal to each other."""
        rest = [k for k in self.keys if k not in self.within] or self.keys
        part = F.sha2(F.to_json(F.struct(*self.within)), 256).substr(1, 16) if self.within else F.lit("all")
        return df.withColumns({"_part": part, "_bucket": F.pmod(F.xxhash64(*rest), F.lit(self.n_buckets)).cast("int")})

    def log(self, spark: SparkSession) -> DataFrame:
        """The latest row of each bucket: its folder (null: empty) and number of rows."""
        rows = spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/log")
        last = rows.groupBy("part", "bucket").agg(F.max_by(F.struct("version", "folder", "n"), "version").alias("r"))
        return last.select("part", "bucket", "r.*")

    def rows(self, spark: SparkSession, buckets: set[tuple[str, int]] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        log = self.log(spark).filter("folder IS NOT NULL").collect()  # one row a bucket
        folders = sorted(f"{self.path}/{r['folder']}" for r in log if buckets is None or (r["part"], r["bucket"]) in buckets)
        return spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)

    def append_log(self, spark: SparkSession, entries: list[tuple[str, int, str | None, int]]) -> None:
        """One file names all buckets of a change at once."""
        version = (spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/log").agg(F.max("version")).first()[0] or 0) + 1
        spark.createDataFrame([(version, *e) for e in entries], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def write(self, rows: DataFrame, touched: set[tuple[str, int]]) -> None:
        """Put these rows in place of all rows of the touched buckets."""
        spark, name = rows.sparkSession, f"data/{uuid.uuid4().hex}"
        placed = self.placed(rows.select(*self.schema.names)).repartition(*OWN)
        placed.write.partitionBy(*OWN).parquet(f"{self.path}/{name}")
        written = spark.read.schema(T.StructType([*self.schema, T.StructField("_part", T.StringType()), T.StructField("_bucket", T.IntegerType())]))
        counts = {(r["_part"], r["_bucket"]): r["count"] for r in written.parquet(f"{self.path}/{name}").groupBy(*OWN).count().collect()}
        entries = [(p, b, f"{name}/_part={p}/_bucket={b}" if (p, b) in counts else None, counts.get((p, b), 0)) for p, b in sorted(touched | set(counts))]
        if entries:
            self.append_log(spark, entries)


def create(df: DataFrame, keys: list[str], path: str, n_buckets: int = 64, within: list[str] = (), order: Column | None = None) -> Table:
    """A new keyed table of the rows, of several with one key the last by `order`, then by a hash of the row."""
    if taken := set(OWN) & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} are the table's own")
    table = Table(path.rstrip("/"), list(keys), list(within), n_buckets, df.schema)
    spark = df.sparkSession
    spark.createDataFrame([(df.schema.json(), table.keys, table.within, n_buckets)], "schema string, keys array<string>, within array<string>, n_buckets int").coalesce(1).write.json(f"{path}/about")
    spark.createDataFrame([], LOG_SCHEMA).write.parquet(f"{path}/log")
    table.write(last_per_key(df, table.keys, order), set())
    return table


def open_table(spark: SparkSession, path: str) -> Table:
    r = spark.read.schema("schema string, keys array<string>, within array<string>, n_buckets int").json(f"{path.rstrip('/')}/about").first()
    return Table(path.rstrip("/"), list(r["keys"]), list(r["within"]), r["n_buckets"], T.StructType.fromJson(json.loads(r["schema"])))


def last_per_key(df: DataFrame, keys: list[str], order: Column | None) -> DataFrame:
    """One row per key by an aggregate that combines in each task first, so that a key written very often is no hot spot."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    rank = F.struct(*([order] if order is not None else []), F.xxhash64(*others))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in others]).select(*df.columns)


def change(table: Table, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> set[tuple[str, int]]:
    """Replace the buckets that the changes' keys fall into by combine(their rows, the changes); the buckets touched.

    No changes touch nothing. Only the names of buckets reach the driver.
    """
    spark = changes.sparkSession
    stored = write_once(table.placed(changes))
    touched = {(r["_part"], r["_bucket"]) for r in stored.select(*OWN).distinct().collect()}
    if touched:
        table.write(combine(table.rows(spark, touched), stored.drop(*OWN)), touched)
    return touched


def upsert(table: Table, rows: DataFrame, order: str | None = None) -> set[tuple[str, int]]:
    """Insert the rows, or replace those of equal key.

    With `order`, a column, the larger value stays, and the new row of two equal ones; without, the new row. Of several
    new rows with one key the last by `order` counts, then that of largest hash.
    """
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*table.schema.names).withColumn("_new", F.lit(1)))
        rank = F.struct(F.col(order), F.col("_new")) if order else F.col("_new")
        return last_per_key(both, table.keys, rank).drop("_new")

    return change(table, rows, combine)


def update(table: Table, values: DataFrame, column: str, order: str | None = None) -> set[tuple[str, int]]:
    """Set one column of the rows whose keys are listed; keys that the table lacks are not added.

    Of several values of a key the last by `order` counts, then the larger; null values change nothing.
    """
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        rank = F.struct(*([F.col(order)] if order else []), F.col("_set"))
        fix = new.withColumnRenamed(column, "_set").filter("_set IS NOT NULL").groupBy(*table.keys).agg(F.max_by("_set", rank).alias("_set"))
        fix = fix.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(table.keys)], "_set")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(table.keys)]
        joined = old.join(fix, same, "left")
        return joined.withColumn(column, F.coalesce("_set", column)).select(*old.columns)

    return change(table, values, combine)


def delete(table: Table, keys: DataFrame) -> set[tuple[str, int]]:
    """Remove the rows whose keys are listed."""
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        gone = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(table.keys)]).distinct()
        return old.join(gone, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(table.keys)], "left_anti")

    return change(table, keys, combine)


def clear(table: Table, spark: SparkSession, **values) -> set[tuple[str, int]]:
    """Remove all rows with these values of the `within` columns: an entry of the log for each bucket, no data is read."""
    if set(values) != set(table.within):
        raise ValueError(f"give a value for each of {table.within}")
    one = spark.range(1).select(*[F.lit(v).cast(table.schema[k].dataType).alias(k) for k, v in values.items()])
    rest = [F.lit(None).cast(table.schema[k].dataType).alias(k) for k in table.keys if k not in values]
    part = table.placed(one.select("*", *rest)).first()["_part"]
    held = [(r["part"], r["bucket"]) for r in table.log(spark).filter((F.col("part") == part) & F.col("folder").isNotNull()).collect()]
    if held:
        table.append_log(spark, [(p, b, None, 0) for p, b in held])
    return set(held)
