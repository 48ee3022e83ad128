"""The inverted index gives what a scan gives, and reads less for it."""

import pytest
from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.operators import postings as ps
from palaver.operators import search as se

QUERIES = ["Réponse the in oder für para qui l'ouier mentoi ?", "erhaan", "zzzz nothing like this", "", "le la les", "thtion thtion Erreti tistre"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = [(-1, None, "fr"), (-2, "", "fr"), (-3, "erhaan " * 40, "xx"), (-4, "erhaan " * 40, "xx")]
    return rows.union(spark.createDataFrame(extra, rows.schema)).cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "documents")
    ps.write_index(docs, "doc_id", "text", path, {"lang": F.col("lang"), "n_words": tx.n_words(F.col("text"))}, block_docs=8)
    return path


@pytest.mark.parametrize("k", [1, 5, 20, 1000])
@pytest.mark.parametrize("text", QUERIES)
def test_same_as_scan(spark, docs, index, text, k):
    got = [tuple(r) for r in ps.search(spark, index, text, k=k).collect()]
    assert got == [tuple(r) for r in se.text_search(docs, "doc_id", "text", text, k=k).collect()]


def test_filters_restrict_the_answer_alone(spark, docs, index):
    got = ps.search(spark, index, QUERIES[0], [F.col("lang").isin("fr", "de"), F.col("n_words") >= 50]).collect()
    want = se.text_search(docs, "doc_id", "text", QUERIES[0], [F.col("lang").isin("fr", "de"), tx.n_words(F.col("text")) >= 50]).collect()
    assert list(map(tuple, got)) == list(map(tuple, want)) and got


def test_blocks_are_skipped(spark, index):
    bounds, idf = ps.block_bounds(spark, index, ["erhaan"])
    all_blocks = bounds.count()
    best = ps.search(spark, index, "erhaan", k=2).collect()
    left = bounds.filter(F.col("bound") >= best[1]["score"] - 1e-5).count()
    assert {r["doc"] for r in best} == {-3, -4} and left <= 2 < all_blocks and len(idf) == 1
    plan = ps.search(spark, index, "erhaan", k=2)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,erhaan)" in plan and "block" in plan.split("PushedFilters")[1].split("]")[0] and "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_many_blocks_are_joined(spark, index, monkeypatch):
    want = [tuple(r) for r in ps.search(spark, index, QUERIES[0], k=30).collect()]
    monkeypatch.setattr(ps, "LISTED_BLOCKS", 1)
    assert [tuple(r) for r in ps.search(spark, index, QUERIES[0], k=30).collect()] == want


def test_edges(spark, docs, tmp_path):
    ps.write_index(docs.filter("false"), "doc_id", "text", str(tmp_path / "none"))
    assert ps.search(spark, str(tmp_path / "none"), "erhaan").collect() == []
    with pytest.raises(ValueError):
        ps.write_index(docs, "doc_id", "text", str(tmp_path / "clash"), {"tf": F.col("lang")})
