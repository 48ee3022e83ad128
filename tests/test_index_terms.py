"""Index terms are looked up per distinct word, and vectors are made once for all passes over them."""

from pyspark.sql import functions as F

from palaver.functions import text as tx
from palaver.plans import topic_queries as tq
from palaver.plans.registry import Tables


def test_each_distinct_word_once(spark):
    """The chain of rules over every token is gone from the plan."""
    df = spark.createDataFrame([(1, "L'écologie des chevaux"), (2, None), (3, ""), (4, "²²²²²² aaaaaa de ' bureaux")], "id int, text string")
    out = df.select("id", tx.analyze_french(F.col("text")).alias("terms"))
    assert {r["id"]: r["terms"] for r in out.collect()} == {1: ["ecolog", "cheval"], 2: None, 3: [], 4: ["²²²²²²", "a", "bureau"]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "transform(" not in plan


def test_passes_read_vectors_only(spark):
    _, out = tq.stored_vectors(Tables(spark, "/root/testdata/sf0.001"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "tokens" not in plan and out.filter("bow IS NOT NULL").count() == 200
