"""Many linear boundaries at once: their coefficients are the columns of one matrix, and every pass over the rows serves them all.

Repeats and folds differ only in the weight they give to a row, so one pass takes a block of rows times that matrix, and its
transpose times the hinge's slopes is the gradient of each model. Rows stay where they are; tasks send one sum of
slopes each, in blocks of features that are added up in parallel before they reach the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..session import write_once

BLOCK_ROWS = 32  # rows multiplied at once, over the features that occur in them: more rows have more features, most of them zero in a row
TASK_ROWS = 2048  # rows of a task, at least
BLOCK_FEATURES = 256  # features whose slopes travel together
DIRECT_BYTES = 16 << 20  # sums of slopes that the driver takes from the tasks at most in each of some 30 passes
SMOOTH = 0.1  # the hinge's corner is rounded over this width below 1
MEMORY = 6  # steps that shape the next direction
ROW_SCHEMA = "id string, idx array<int>, val array<double>, y double, weight double, fold int, picked array<boolean>"


@dataclass(frozen=True)
class Boundaries:
    """Columns of coefficients, the intercept last. A model learns from rows outside its fold (-1: from all) that its repeat (-1: any) picked."""

    coefs: np.ndarray
    folds: np.ndarray
    repeats: np.ndarray

    @property
    def n(self) -> int:
        return len(self.folds)

    def one(self, k: int) -> Boundaries:
        return Boundaries(self.coefs[:, k:k + 1], self.folds[k:k + 1], self.repeats[k:k + 1])


def fold_of(row_id: Column, k: int) -> Column:
    return F.floor(nm.keyed_uniform(row_id) * k).cast("int")


def training_table(matrix: DataFrame, row_id: str, n_repeat: int = 0, keep: float = 1.0, k_folds: int = 0, features: str = "features") -> DataFrame:
    """Rows of an assembled matrix (label, weight, features) in the form that all passes read, written once.

    A repeat picks a row if a number drawn from the row's id and the repeat is below `keep`; folds come from the id's
    own number. Neither depends on partitions. Null labels and features teach nothing and are left out.
    """
    v = F.unwrap_udt(features)
    idx = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    picks = [nm.keyed_uniform(F.concat(F.col(row_id).cast("string"), F.lit(f"_{i}"))) < keep for i in range(n_repeat)]
    weight = F.col("weight") if "weight" in matrix.columns else F.lit(1.0)
    fold = fold_of(F.col(row_id).cast("string"), k_folds) if k_folds else F.lit(-1)
    rows = matrix.filter(F.col("label").isNotNull() & F.col(features).isNotNull()).select(
        F.col(row_id).cast("string").alias("id"), idx.alias("idx"), v["values"].alias("val"), F.col("label").cast("double").alias("y"),
        F.coalesce(weight.cast("double"), F.lit(0.0)).alias("weight"), F.coalesce(fold, F.lit(0)).alias("fold"),
        F.array(*[F.coalesce(p, F.lit(False)) for p in picks]).cast("array<boolean>").alias("picked"))
    table = write_once(rows)
    return table.coalesce(max(1, table.count() // TASK_ROWS))  # every pass starts these tasks anew


def n_features(matrix: DataFrame, features: str = "features") -> int:
    """Width of the matrix, from its metadata or else its first row."""
    attrs = matrix.schema[features].metadata.get("ml_attr", {})
    if "num_attrs" in attrs:
        return attrs["num_attrs"]
    first = matrix.filter(F.col(features).isNotNull()).select(features).first()
    return len(first[0]) if first else 0


@dataclass(frozen=True)
class Rows:
    """Rows of the stored table side by side: the features of one after another, and what is known of each."""

    idx: np.ndarray
    val: np.ndarray
    ends: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    picked: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        flat = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("idx", "val", "picked")}
        about = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "weight", "fold")]
        ends = np.append(0, np.cumsum(pc.list_value_length(batch.column("idx"))))
        return Rows(flat["idx"], flat["val"], ends, *about, flat["picked"].astype(bool).reshape(batch.num_rows, -1 if len(flat["picked"]) else 0))

    def blocks(self, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Which rows, the features that occur in them (the constant one last), and the values of those."""
        for at in range(0, len(self.y), BLOCK_ROWS):
            ends = self.ends[at:at + BLOCK_ROWS + 1]
            used, place = np.unique(self.idx[ends[0]:ends[-1]], return_inverse=True)
            x = np.zeros((len(ends) - 1, len(used) + 1))
            np.add.at(x, (np.repeat(np.arange(len(x)), np.diff(ends)), place), self.val[ends[0]:ends[-1]])
            x[:, -1] = 1.0
            yield slice(at, at + len(x)), np.append(used, width), x

    def weights(self, some: slice, models: Boundaries) -> np.ndarray:
        """Weight of each row in each model."""
        outside = (self.fold[some, None] != models.folds) | (models.folds < 0)
        for_all = np.ones((len(outside), 1), bool)
        return self.weight[some, None] * (np.hstack([for_all, self.picked[some]])[:, models.repeats + 1] & outside)


def hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hinge, its corner rounded, and its slope."""
    gap = 1 - margin
    bent = np.clip(gap / SMOOTH, 0, 1)
    return np.where(gap > SMOOTH, gap - SMOOTH / 2, SMOOTH / 2 * bent * bent), -bent


def losses(rows: DataFrame, models: Boundaries, reg: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean weighted loss with its L2 penalty, and gradient, of all models: one pass.

    The sums of a few tasks go to the driver as they are; those of many are first added up by block of features.
    """
    spark, width = rows.sparkSession, len(models.coefs) - 1
    sent = spark.sparkContext.broadcast(models)

    def packed(block, values):
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "sums": pa.array([values.tobytes()], pa.binary())})

    def slopes(batches):
        at = sent.value
        grad, sums = np.zeros_like(at.coefs), np.zeros((2, at.n))
        for read in map(Rows.of, batches):
            for some, used, x in read.blocks(width):
                sign = read.y[some, None] * 2 - 1
                w = read.weights(some, at)
                loss, slope = hinge(sign * (x @ at.coefs[used]))
                sums += [(w * loss).sum(0), w.sum(0)]
                grad[used] += x.T @ (w * slope * sign)
        yield packed(-1, sums)
        for k in range(0, len(grad), BLOCK_FEATURES):
            part = grad[k:k + BLOCK_FEATURES]
            if part.any():
                yield packed(k, part)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in sorted(pdf["sums"]))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "sums": [total.tobytes()]})

    parts = rows.drop("id").mapInArrow(slopes, "block int, sums binary")
    if rows.rdd.getNumPartitions() * models.coefs.nbytes > DIRECT_BYTES:
        parts = parts.groupBy("block").applyInPandas(add, "block int, sums binary")
    grad, sums = np.zeros_like(models.coefs), np.zeros((2, models.n))
    for r in parts.collect():
        values = np.frombuffer(r["sums"]).reshape(-1, models.n)
        if r["block"] < 0:
            sums += values
        else:
            grad[r["block"]:r["block"] + BLOCK_FEATURES] += values
    sent.unpersist()
    total = np.maximum(sums[1], 1e-300)
    free = models.coefs * np.append(np.ones(width), 0)[:, None]  # the intercept is not penalised
    return sums[0] / total + reg / 2 * (free * free).sum(0), grad / total + reg * free


def direction(grad: np.ndarray, steps: deque, scale: np.ndarray) -> np.ndarray:
    """Limited-memory quasi-Newton direction of every column; pairs that say nothing about a column have rate 0."""
    q, alphas = grad.copy(), []
    for s, y, rate in reversed(steps):
        a = rate * (s * q).sum(0)
        q -= a * y
        alphas.append(a)
    q *= scale
    for (s, y, rate), a in zip(steps, reversed(alphas)):
        q += s * (a - rate * (y * q).sum(0))
    return -q


def fit(rows: DataFrame, width: int, folds: list[int] = (-1,), repeats: list[int] = (-1,), reg: float = 1e-4, passes: int = 30,
        tolerance: float = 1e-4) -> Boundaries:
    """One model for each pair of a fold and a repeat, all of them improved by every pass over the rows.

    A pass tries one step of each model; a model that did not gain enough tries a shorter one in the next pass, while the others
    go on. Models whose rows are missing or all weigh nothing stay at zero.
    """
    at = Boundaries(np.zeros((width + 1, len(folds) * len(repeats))), np.repeat(np.array(folds, int), len(repeats)), np.tile(np.array(repeats, int), len(folds)))
    loss, grad = losses(rows, at, reg)
    steps: deque = deque(maxlen=MEMORY)
    scale = 1 / np.maximum(np.sqrt((grad * grad).sum(0)), 1e-12)
    go, length = -grad * scale, np.ones(at.n)
    for _ in range(passes - 1):
        if (np.abs(grad).max(0, initial=0) < tolerance).all():
            break
        tried = Boundaries(at.coefs + length * go, at.folds, at.repeats)
        new_loss, new_grad = losses(rows, tried, reg)
        better = new_loss <= loss + 1e-4 * length * (grad * go).sum(0)
        s, y = (tried.coefs - at.coefs) * better, (new_grad - grad) * better
        sy, yy = (s * y).sum(0), (y * y).sum(0)
        curved = sy > 1e-12 * np.maximum(yy, 1e-12)
        steps.append((s, y, np.where(curved, 1 / np.where(curved, sy, 1), 0)))
        scale = np.where(curved, sy / np.where(curved, yy, 1), scale)
        at = Boundaries(np.where(better, tried.coefs, at.coefs), at.folds, at.repeats)
        loss, grad = np.where(better, new_loss, loss), np.where(better, new_grad, grad)
        fresh = direction(grad, steps, scale)
        down = (fresh * grad).sum(0) < 0
        go = np.where(better & down, fresh, np.where(better, -grad * scale, go))
        length = np.where(better, 1.0, length * 0.3)
    return at


def counts(rows: DataFrame, models: Boundaries) -> pd.DataFrame:
    """Per model: rows it learnt from or might have (seen) and those it predicts right (hits), and tp, fp, fn, tn on its own fold. One pass."""
    sent = rows.sparkSession.sparkContext.broadcast(models)
    names = ["seen", "hits", "tp", "fp", "fn", "tn"]

    def count(batches):
        at = sent.value
        total = np.zeros((6, at.n), np.int64)
        for read in map(Rows.of, batches):
            for some, used, x in read.blocks(len(at.coefs) - 1):
                said, true = x @ at.coefs[used] > 0, read.y[some, None] > 0.5
                held = (read.fold[some, None] == at.folds) & (at.folds >= 0)
                total += np.stack([m.sum(0) for m in (~held, ~held & (said == true), held & said & true, held & said & ~true, held & ~said & true, held & ~said & ~true)])
        yield pa.RecordBatch.from_arrays([*map(pa.array, total), pa.array(np.arange(at.n, dtype=np.int32))], [*names, "model"])

    sums = rows.drop("id").mapInArrow(count, ", ".join([*[f"{c} long" for c in names], "model int"])).groupBy("model").agg(*[F.sum(c).alias(c) for c in names])
    out = sums.toPandas().set_index("model").reindex(range(models.n), fill_value=0)
    return out.assign(fold=models.folds, repeat=models.repeats)


def training_accuracy(found: pd.DataFrame) -> np.ndarray:
    """Share of the rows outside a model's fold that it predicts right; 0 without any."""
    return (found["hits"] / found["seen"].clip(lower=1)).to_numpy()


def scores(rows: DataFrame, models: Boundaries) -> DataFrame:
    """(id, y, raw): distance from the boundary, signed, of every row for every model."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        at = sent.value
        for batch in batches:
            raw = np.vstack([np.empty((0, at.n)), *[x @ at.coefs[used] for _, used, x in Rows.of(batch).blocks(len(at.coefs) - 1)]])
            lists = pa.ListArray.from_arrays(np.arange(0, raw.size + 1, at.n, dtype=np.int32), raw.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), lists], ["id", "y", "raw"])

    return rows.mapInArrow(score, "id string, y double, raw array<double>")
