"""Many boundaries at once against plain gradient descent and against each other."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from palaver.operators import linear as ln

D = 12


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(1)
    truth = rng.normal(0, 1, D)
    rows = []
    for k in range(400):
        x = rng.normal(0, 1, D) * (rng.random(D) < 0.6)
        y = float(x @ truth + 0.3 + rng.normal(0, 0.7) > 0)
        rows.append((f"r{k}", Vectors.dense(x) if k % 3 else SparseVector(D, np.flatnonzero(x).tolist(), x[x != 0].tolist()), y, 5.0 if y else 1.0))
    rows += [("null label", Vectors.dense([1.0] * D), None, 1.0), ("no weight", Vectors.dense([9.0] * D), 1.0, None)]
    return spark.createDataFrame(rows, ["name", "features", "label", "weight"]).repartition(4).cache()


def arrays(matrix):
    rows = matrix.filter("label IS NOT NULL AND weight IS NOT NULL").collect()
    return [r["name"] for r in rows], np.array([r["features"].toArray() for r in rows]), np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows])


def plain(x, y, w, reg, steps=6000):
    """Accelerated gradient descent on the same loss, the intercept unpenalised."""
    x1, sign = np.hstack([x, np.ones((len(x), 1))]), 2 * y - 1
    b = ahead = np.zeros(D + 1)
    free = np.append(np.ones(D), 0)
    for k in range(steps):
        _, slope = ln.hinge(sign * (x1 @ ahead))
        new = ahead - 0.01 * (x1.T @ (w * slope * sign) / w.sum() + reg * free * ahead)
        b, ahead = new, new + k / (k + 3) * (new - b)
    loss, _ = ln.hinge(sign * (x1 @ b))
    return b, (w * loss).sum() / w.sum() + reg / 2 * (b[:-1] ** 2).sum()


def test_one_model_reaches_the_optimum(matrix):
    rows = ln.training_table(matrix, "name")
    assert rows.count() == 401 and ln.n_features(matrix) == D
    models = ln.fit(rows, D, reg=0.01, passes=80)
    b, loss = plain(*arrays(matrix)[1:], 0.01)
    got, grad = ln.losses(rows, models, 0.01)
    assert got[0] <= loss + 1e-4 and np.abs(grad).max() < 5e-3 and np.abs(models.coefs[:, 0] - b).max() < 0.05


def test_as_good_as_the_library_trainer(matrix):
    clean = matrix.filter("label IS NOT NULL AND weight IS NOT NULL")
    svc = LinearSVC(weightCol="weight", regParam=0.01, maxIter=100, standardization=False).fit(clean)
    _, x, y, w = arrays(matrix)
    ours = ln.fit(ln.training_table(matrix, "name"), D, reg=0.01, passes=80).coefs[:, 0]

    def true_hinge(b, c):
        return (w * np.maximum(0, 1 - (2 * y - 1) * (x @ b + c))).sum() / w.sum() + 0.005 * (b ** 2).sum()

    assert true_hinge(ours[:-1], ours[-1]) < true_hinge(svc.coefficients.toArray(), svc.intercept) + 0.01


def test_models_of_a_pass_do_not_touch_each_other(matrix):
    rows = ln.training_table(matrix, "name", n_repeat=3, keep=0.7, k_folds=4)
    both = ln.fit(rows, D, folds=[-1, 2], repeats=[-1, 0, 2], reg=0.01, passes=60)
    assert list(zip(both.folds, both.repeats)) == [(f, r) for f in (-1, 2) for r in (-1, 0, 2)]
    names, x, y, w = arrays(matrix)
    about = {r["id"]: r for r in rows.collect()}
    for k, (f, r) in enumerate(zip(both.folds, both.repeats)):
        mine = np.array([(f < 0 or about[n]["fold"] != f) and (r < 0 or about[n]["picked"][r]) for n in names])
        assert 100 < mine.sum() <= len(names)
        b, _ = plain(x[mine], y[mine], w[mine], 0.01)
        assert np.abs(both.coefs[:, k] - b).max() < 0.08, (f, r)


def test_sums_of_many_tasks_are_added_before(matrix, monkeypatch):
    rows = ln.training_table(matrix, "name", n_repeat=2, keep=0.7).repartition(5)
    some = ln.Boundaries(np.linspace(-1, 1, 2 * D + 2).reshape(D + 1, 2), np.array([-1, -1]), np.array([0, 1]))
    loss, grad = ln.losses(rows, some, 0.1)
    monkeypatch.setattr(ln, "DIRECT_BYTES", 0)
    monkeypatch.setattr(ln, "BLOCK_FEATURES", 5)
    again, same = ln.losses(rows, some, 0.1)
    assert np.allclose(loss, again) and np.allclose(grad, same)


def test_counts_and_scores(matrix):
    rows = ln.training_table(matrix, "name", n_repeat=2, keep=0.8, k_folds=3)
    models = ln.fit(rows, D, folds=[-1, 0, 1, 2], repeats=[0, 1], passes=10)
    found = ln.counts(rows, models)
    raw = {r["id"]: r for r in ln.scores(rows, models).collect()}
    about = {r["id"]: r for r in rows.collect()}
    for k, c in found.iterrows():
        held = {i for i, r in about.items() if r["fold"] == models.folds[k]}
        said = {i: (raw[i]["raw"][k] > 0, about[i]["y"] > 0.5) for i in about}
        assert c["seen"] == len(about) - len(held) and c["hits"] == sum(p == t for i, (p, t) in said.items() if i not in held)
        assert [c["tp"], c["fp"], c["fn"], c["tn"]] == [sum(said[i] == s for i in held) for s in ((True, True), (True, False), (False, True), (False, False))]


def test_edges(spark, matrix):
    none = ln.training_table(matrix.filter("false"), "name", 2, 0.5, 3)
    models = ln.fit(none, D, folds=[0, 1], repeats=[0])
    assert not models.coefs.any() and ln.counts(none, models)[["seen", "hits", "tp"]].to_numpy().sum() == 0
    assert ln.scores(none, models).count() == 0 and (ln.training_accuracy(ln.counts(none, models)) == 0).all()
    one_class = ln.training_table(matrix.filter("label = 1").withColumn("y", F.lit("clash")).withColumn("fold", F.lit("x")), "name", k_folds=2)
    models = ln.fit(one_class, D, folds=[0, 1, 5], passes=10)
    assert (ln.counts(one_class, models)["fn"] == 0).all()
