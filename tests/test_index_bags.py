"""The index is written from bags that are made once."""

from pyspark.sql import functions as F

from palaver.operators import postings as ps
from palaver.session import write_once


def test_index_is_written_from_stored_bags(spark, monkeypatch, tmp_path):
    """Dealing postings out by range reads its input twice; what it reads holds no text."""
    seen = []
    monkeypatch.setattr(ps, "write_once", lambda df: seen.append(write_once(df)) or seen[-1])
    docs = spark.createDataFrame([(1, "chevaux bureaux chevaux"), (2, None)], "doc_id long, text string")
    ps.write_index(docs, "doc_id", "text", str(tmp_path / "index"))
    assert len(seen) == 1 and seen[0].columns == ["doc", "block", "_bag"] and "text" not in seen[0]._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "index" / "postings")).select("doc", "term", "tf").collect()) == [(1, "bureau", 1), (1, "cheval", 2)]


def test_files_follow_the_postings(spark, monkeypatch, tmp_path):
    """As many files as the rows ask for, however many terms a document has."""
    monkeypatch.setattr(ps, "FILE_ROWS", 50)
    docs = spark.range(4).selectExpr("id as doc_id", "array_join(transform(sequence(1, 100), x -> concat('w', id, '_', x)), ' ') as text")
    ps.write_index(docs, "doc_id", "text", str(tmp_path / "index"))
    postings = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert postings.count() == 400 and postings.select(F.input_file_name()).distinct().count() == 8
