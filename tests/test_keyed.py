"""Keyed tables: merges replace and add by key, and leave the files of other buckets as they are."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from palaver.sources import keyed as kt

SCHEMA = "dataset string, id string, label double, at long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return {f: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def content(table, spark):
    return sorted((tuple(r) for r in table.rows(spark).collect()), key=str)


@pytest.fixture
def made(spark, tmp_path):
    path = str(tmp_path / "labels")
    rows = [("a", f"k{i}", float(i % 2), i) for i in range(60)] + [("b", f"k{i}", 1.0, i) for i in range(20)] + [(None, None, 0.5, 1)]
    kt.create(frame(spark, [*rows, ("a", "k3", 9.0, 0)]), ["dataset", "id"], path, n_buckets=8, within=["dataset"], order=F.col("at"))
    return kt.open_table(spark, path), rows


def test_create_and_read(spark, made):
    table, rows = made
    assert content(table, spark) == sorted(rows, key=str) and table.schema == table.rows(spark).schema
    assert table.rows(spark).inputFiles() and table.keys == ["dataset", "id"]


def test_upsert_touches_its_buckets_alone(spark, made):
    table, rows = made
    before = files(table.path)
    new = [("a", "k1", 7.0, 100), ("a", "k1", 6.0, 99), ("a", "k2", 7.0, 1), ("a", "new", 1.0, 5), (None, None, 0.7, 1)]
    touched = kt.upsert(table, frame(spark, new), "at")
    want = {r[:2]: r for r in rows} | {("a", "k1"): new[0], ("a", "new"): new[3], (None, None): new[4]}  # k2 is older than the label held
    assert content(table, spark) == sorted(want.values(), key=str) and 2 <= len(touched) <= 4
    after = files(table.path)
    assert before.items() <= after.items()  # nothing is overwritten
    live = {"/" + f.removeprefix("file:").lstrip("/") for f in table.rows(spark).inputFiles()}
    assert live & set(before) and len(live - set(before)) == len(touched)
    assert kt.upsert(table, frame(spark, []), "at") == set() and files(table.path) == after
    assert kt.upsert(table, frame(spark, new), "at") == touched and content(table, spark) == sorted(want.values(), key=str)


def test_update_delete_clear(spark, made):
    table, rows = made
    kt.update(table, frame(spark, [("b", "k1", 3.0, 1), ("b", "k1", 2.0, 2), ("b", "none", 3.0, 1), ("b", "k2", None, 9), (None, None, 4.0, 0)]), "label", "at")
    want = {r[:2]: r for r in rows}
    want[("b", "k1")] = ("b", "k1", 2.0, 1)
    want[(None, None)] = (None, None, 4.0, 1)
    assert content(table, spark) == sorted(want.values(), key=str)
    kt.delete(table, frame(spark, [("a", "k5", None, None), (None, None, None, None), ("c", "k5", None, None)]))
    want = {k: r for k, r in want.items() if k not in (("a", "k5"), (None, None))}
    assert content(table, spark) == sorted(want.values(), key=str)
    before = files(table.path)
    assert kt.clear(table, spark, dataset="a") and kt.clear(table, spark, dataset="a") == set() and files(table.path) == before
    assert content(table, spark) == sorted((r for r in want.values() if r[0] == "b"), key=str)
    kt.upsert(table, frame(spark, [("a", "k1", 1.0, 1)]))
    assert table.rows(spark).filter("dataset = 'a'").count() == 1
    with pytest.raises(ValueError):
        kt.clear(table, spark)


def test_a_failed_change_has_not_happened(spark, made):
    table, rows = made

    def fails(old, new):
        return old.unionByName(new.withColumn("label", F.raise_error(F.lit("lost")).cast("double")))

    with pytest.raises(Exception, match="lost"):
        kt.change(table, frame(spark, [("a", "k1", 0.0, 1)]), fails)
    assert content(table, spark) == sorted(rows, key=str)


def test_edges(spark, tmp_path):
    table = kt.create(frame(spark, []), ["id"], str(tmp_path / "t"), 4)
    assert content(table, spark) == [] and kt.delete(table, frame(spark, [("x", "y", 1.0, 1)])) and content(table, spark) == []
    kt.upsert(table, frame(spark, [("x", "y", 1.0, 1)] * 500))
    assert content(table, spark) == [("x", "y", 1.0, 1)] and os.path.isdir(f"{table.path}/log")
    with pytest.raises(ValueError):
        kt.create(spark.range(1).withColumn("_bucket", F.lit(1)), ["id"], str(tmp_path / "u"))
