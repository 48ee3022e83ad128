"""Joins of co-located stores: same rows as the shuffled joins, no exchange in their plans, hot threads in parts."""

import pytest
from pyspark.sql import functions as F

from palaver.operators import threads as th
from palaver.sources import threadstore as ts


@pytest.fixture(scope="module")
def rows(spark):
    hot = [(f"c{i}", "hot", "hot", i) for i in range(500)]
    some = [(f"d{i}", f"p{i % 30}", f"p{i % 30}", i) for i in range(200)]
    odd = [("x1", None, None, 1), ("x2", None, None, 2), ("x3", "unknown", "unknown", 3), ("x3", "unknown", "unknown", 3)]
    comments = spark.createDataFrame(hot + some + odd, "name string, link_id string, parent_id string, score long")
    posts = spark.createDataFrame([("hot", "Hot", 1), *[(f"p{i}", f"T{i}", i) for i in range(40)], ("p1", "again", 0), (None, "none", 9)], "name string, title string, created_utc long")
    return comments, posts


@pytest.fixture(scope="module")
def store(spark, rows, tmp_path_factory):
    return ts.write(*rows, str(tmp_path_factory.mktemp("threads") / "store"), n_buckets=8, part_rows=60)


def moved(df):
    """Exchanges in the plan as executed."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def content(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_enriched(spark, rows, store):
    comments, posts = rows
    out = ts.enriched(store, "subm", ["title"])
    assert content(out) == content(th.enrich_with_submission(comments, posts.filter("name IS NOT NULL"), "subm", ["title"]))
    assert moved(out) == 0


def test_hot_threads_are_in_parts(store):
    sizes = store.comments.groupBy(*ts.PLACE).count().collect()
    assert max(r["count"] for r in sizes) < 120 and sum(r["_thread"] == "hot" for r in sizes) == 9
    assert store.posts.filter("name = 'hot'").count() == 9


def test_co_group_and_bundles(spark, rows, store):
    comments, posts = rows
    out = ts.co_group(store, ["name", "score"])
    assert content(out) == content(th.co_group(posts.filter("name IS NOT NULL"), comments, ["name", "score"]))
    lists = ts.bundles(store, ["name"])
    assert moved(lists) == 0
    per = {}
    for r in lists.collect():
        per.setdefault(r["name"], []).append(sorted(i["name"] for i in r["items"]))
        assert len(r["items"]) < 120
    want = {}
    for r in comments.collect():
        want.setdefault(r["link_id"], []).append(r["name"])
    assert {n: sorted(sum(p, [])) for n, p in per.items()} == {r["name"]: sorted(want.get(r["name"], [])) for r in posts.filter("name IS NOT NULL").collect()}


def test_opened_by_another_session(spark, store):
    spark.sql(f"DROP TABLE {store.name('comments')}")
    spark.sql(f"DROP TABLE {store.name('posts')}")  # the files stay
    again = ts.open_store(spark, store.path)
    out = ts.enriched(again, "subm", ["title"])
    assert out.count() == 704 and moved(out) == 0


def test_edges(spark, rows, tmp_path):
    comments, posts = rows
    none = ts.write(comments.filter("false"), posts, str(tmp_path / "a"), 4)
    assert ts.enriched(none, "subm", ["title"]).count() == 0 and ts.co_group(none, ["name"]).count() == 41
    with pytest.raises(ValueError):
        ts.write(comments.withColumn("_part", F.lit(0)), posts, str(tmp_path / "b"))
