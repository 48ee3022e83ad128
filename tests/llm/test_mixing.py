"""Mixing against targets shared out round by round and against sorting."""

import pytest
from pyspark.sql import functions as F

from palaver.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), percent=150, most=2):
    """sizes: list by rank. Share by weight, cut at the limit, share the excess again until none is above."""
    total = sum(sizes) * percent / 100
    w = [float(weights[k % len(weights)]) for k in range(len(sizes))]
    fixed = {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        rest = total - sum(fixed.values())
        t = {k: rest * w[k] / sum(w[j] for j in free) for k in free}
        above = [k for k in free if t[k] > most * sizes[k]]
        if not above:
            return [fixed.get(k, t.get(k)) for k in range(len(sizes))]
        for k in above:
            fixed[k] = float(most * sizes[k])


def mixed(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, at string")
    return mixing.mix(df).collect()


@pytest.mark.parametrize("counts", [[5, 50, 500], [300, 1, 1, 40, 0, 7], [1], [10, 10], [400, 3, 3, 3, 3, 3, 3]])
def test_targets_and_taken(spark, counts):
    rows, i = [], 0
    for k, n in enumerate(counts):
        for j in range(n):
            rows.append((i, " ".join(["w"] * (1 + (i * 7) % 23)), None if k == len(counts) - 1 else f"s{k}"))
            i += 1
    out = mixed(spark, rows)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in names}
    want = dict(zip(names, plain_targets([size[s] for s in names])))
    assert len(out) == len(rows)
    for s in names:
        mine = [r for r in out if r["source"] == s]
        taken = sum(r["taken"] for r in mine)
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == size[s] and r["taken"] <= 2 * r["size"] for r in mine)
        assert want[s] - 25 < taken <= want[s] + 1e-6
    assert sorted(map(str, out)) == sorted(map(str, mixed(spark, rows[::-1])))


def test_thresholds_are_those_of_sorted_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), mixing.place(F.col("id")).alias("at"), (F.col("id") % 17).alias("size"))
    for budget in (0.0, 1.0, 777.0, 5000.0, 1e9):
        cuts = {r["source"]: r["cut"] for r in mixing.thresholds(df, spark.createDataFrame([("a", budget), ("b", budget)], "source string, budget double")).collect()}
        for s in "ab":
            rows = sorted((r["at"], r["size"]) for r in df.filter(F.col("source") == s).collect())
            spent = 0
            kept = 0
            for at, n in rows:
                if spent + n > budget:
                    break
                spent, kept = spent + n, kept + 1
            assert sum(at < cuts[s] for at, _ in rows) == kept


def test_edges(spark):
    assert mixed(spark, []) == []
    out = mixed(spark, [(1, None, None), (1, None, None), (None, "a b", "s"), (None, "a b", "s"), (2, " \t", "s"), (3, "x" * 100_000 + " y", "t")])
    assert sorted((r["id"] or 0, r["size"]) for r in out) == [(0, 2), (0, 2), (1, 0), (1, 0), (2, 0), (3, 2)]
    assert len({r["taken"] for r in out if r["id"] is None}) == 1
