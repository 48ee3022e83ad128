"""The vectors that a fit, its scores and its loss read are made once."""

from palaver.operators import classify as cl
from palaver.plans import catalog


def test_training_reads_stored_vectors(spark, monkeypatch):
    plans, joins = [], []
    fit, score, loss = cl.train_linear, cl.linear_scores, cl.hinge_loss

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    monkeypatch.setattr(cl, "train_linear", lambda m: plans.append(plan(m)) or fit(m))
    monkeypatch.setattr(cl, "hinge_loss", lambda m, svc: plans.append(plan(m)) or loss(m, svc))
    monkeypatch.setattr(cl, "linear_scores", lambda df, *a: joins.append(plan(df)) or score(df, *a))
    out = catalog.QUERIES["cls4_train_linear"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("UDF" in p for p in plans)  # a counted vector is the result of a function
    assert "Join" not in plan(out) and joins[0].count("Relation") == 1
    row = out.first()
    assert row["n_rows"] > 0 and row["n_other_scores"] == 0 and row["better_than_zero"]
