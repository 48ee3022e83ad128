"""Codes against a plain version that computes every distance."""

import hashlib
import math
import random

import numpy as np
import pytest

from palaver.llm import quantize

INF, NAN = float("inf"), float("nan")


def plain(rows, parts, entries, rounds):
    kept = [(i, lab, v) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in kept]
    ints.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(ints[0][2]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, _, v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            code = [nearest(p, c[p])[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, e in zip(cut, code) if e == k]
                if mine:
                    new[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
        books = new
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = {}
    for (_, lab, _), f in zip(ints, found):
        errors[lab] = errors.get(lab, 0) + sum(d for d, _ in f)
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[lab], sha) for (i, lab, _), f in zip(ints, found))


def coded(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "vec_id long, embedding array<double>, label int, code string, far double")
    out = quantize.compress(df.repartition(3), **options)
    assert out.columns == ["id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(tuple([str(r[0]), *r[1:]]) for r in out.collect())


def vectors(n, dims, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    return [(k * 7 % n, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.choice([None, 1, 2])) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"parts": 2, "entries": 5, "rounds": 3, "pivots": 1}, {"parts": 4, "entries": 30, "rounds": 1, "pivots": 40}])
def test_same_as_all_distances(spark, options):
    rows = vectors(211, 16)
    rows += [(500, None, 1), (501, [NAN] * 16, 1), (502, [None] * 16, 1), (503, [INF] * 16, 1)] + rows[:6] + [(None, rows[3][1], 2)]
    want = plain(rows, options.get("parts", 8), options.get("entries", 16), options.get("rounds", 6))
    assert len(want) == 218 and coded(spark, rows, **options) == want


def test_ties_and_few_rows(spark):
    same = [(k, [1.0, -1.0] * 8, None) for k in range(5)]
    assert coded(spark, same) == plain(same, 8, 16, 6)
    steps = [(k, [float(k % 3)] * 8, k % 2) for k in range(40)]  # repeated entries: the first of equal ones is used
    assert coded(spark, steps) == plain(steps, 8, 16, 6)


def test_odd_rows(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1), (2, [NAN], 1)]) == []
    rows = vectors(40, 8)
    odd = [(90, [1.0] * 7, 1), (91, [], 7), (92, [1e30] * 8, 7), (93, [2.0] * 24, 1)]
    out = coded(spark, rows + odd)
    sha = out[0][-1]
    want = {r[:4] for r in plain(rows, 8, 16, 6)}
    errors = {r[2]: None for r in rows} | {lab: e for (i, _, _, e) in want for j, _, lab in rows if str(j) == i}
    assert {r[:4] for r in out if r[1]} == want and all(r[-1] == sha for r in out)
    assert {r[:4] for r in out if not r[1]} == {("90", None, None, errors[1]), ("91", None, None, None), ("92", None, None, None), ("93", None, None, errors[1])}
    assert {r[1] for r in coded(spark, [(1, [1.0] * 7, 1)])} == {None}


def test_pivots_spare_distances():
    rng = np.random.default_rng(1)
    book = rng.integers(-4000, 4000, (16, 8))
    v = book[rng.integers(0, 16, 3000)] + rng.integers(-300, 300, (3000, 8))
    pivots = quantize.choose_pivots(book[None], 4)
    code, best, evaluated = quantize.nearest(v, quantize.pivot_distances(v[:, None], pivots)[:, 0], book, pivots[0])
    d = ((v[:, None] - book[None]) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all() and evaluated < 0.4 * d.size
