"""Graphs and queries meet without being shuffled, and links found from one end only count for both."""

import zlib

import numpy as np
from test_hnsw import by_force, clustered, joined

from palaver.llm import hnsw


def test_graphs_are_not_shuffled(spark, monkeypatch):
    plans, frame = [], type(spark.range(1))
    plain = frame.mapInPandas

    def spied(df, *a, **k):
        if {"vectors", "queries"} <= set(df.columns):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *a, **k)

    monkeypatch.setattr(frame, "mapInPandas", spied)
    rows = clustered(1)
    got, (want, _) = joined(spark, rows, shard_nodes=100, block_nodes=30), by_force(rows)
    assert [r[0] for r in got] == [r[0] for r in want] and sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
    assert len(plans) >= 2 and not any("hashpartitioning" in p for p in plans), plans


def test_both_ends():
    rng = np.random.default_rng(2)
    for n, m, share in ((700, 300, 0.01), (300, 700, 0.6), (520, 9, 0.0)):
        a, b = rng.random((n, m)) < share, rng.random((m, n)) < share
        keys, keys2, w, w2 = np.arange(n), np.arange(n, n + m), rng.integers(1, 4, n), rng.integers(1, 4, m)
        pack = lambda x: zlib.compress(np.packbits(x, axis=1).tobytes(), 1)
        rows = [(0, 1, keys[200:], w[200:], pack(a[200:])), (0, 0, keys[:200], w[:200], pack(a[:200])), (1, 0, keys2, w2, pack(b))]
        both = a | b.T
        counts, edges = hnsw.both_ends(rows)
        want = dict(zip(keys.tolist(), (both @ w2).tolist())) | dict(zip(keys2.tolist(), (w @ both).tolist()))
        assert counts == {k: v for k, v in want.items() if v} and all(both[x, y - n] for x, y in edges) and (len(edges) > 0) == both.any()
    inside = rng.random((400, 400)) < 0.02
    counts, edges = hnsw.both_ends([(3, 0, np.arange(400), np.ones(400, int), zlib.compress(np.packbits(inside, axis=1).tobytes()))])
    both = inside | inside.T
    assert counts == {k: int(v) for k, v in enumerate(both.sum(1)) if v} and all(both[x, y] for x, y in edges)
