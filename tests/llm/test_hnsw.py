"""Links found in the graphs against all pairs compared in double precision."""

import numpy as np
import pytest

from palaver.llm import hnsw

INF, NAN = float("inf"), float("nan")


def by_force(rows, similarity=hnsw.SIMILARITY):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = {k: k for k in range(len(ok))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(ok)
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= similarity:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(ok):
        low[find(k)] = min(i, low.get(find(k), i))
    out = [(i, links[k], low[find(k)], low[find(k)] == i) for k, (i, _) in enumerate(ok)]
    used = {id(v) for _, v in ok}
    return sorted(out), used


def joined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, node int")
    return sorted(tuple(r) for r in hnsw.near_duplicates(df, **options).collect())


def clustered(seed, n=500, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(30, dim))
    out = []
    for k in range(n):
        v = centers[rng.integers(30)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.3]) if rng.random() < 0.6 else rng.normal(size=dim)
        out.append((int(k * 13 % 1777), [float(np.float32(x)) for x in v]))
    big = rng.normal(size=dim)
    out += [(5000 + k, [float(np.float32(x)) for x in big + rng.normal(size=dim) * 0.02]) for k in range(150)]
    return out


@pytest.mark.parametrize("shard_nodes", [8192, 100])
def test_links(spark, shard_nodes):
    rows = clustered(1)
    want, _ = by_force(rows)
    got = joined(spark, rows, shard_nodes=shard_nodes, block_nodes=200)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.98 * len(want)


def test_edges(spark):
    rows = [(9, [1.0, 0.0]), (4, [2.0, 0.0]), (7, [-0.0, 0.0]), (8, None), (6, []), (5, [1.0, None]), (3, [NAN, 1.0]), (2, [INF, 1.0]),
            (1, [1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (0, [0.0, 1e-30]), (11, [0.0, 1e30]), (12, [-0.0, 1e30])]
    assert joined(spark, rows) == sorted([(9, 2, 4, False), (9, 2, 4, False), (4, 2, 4, True), (7, 0, 7, True), (8, 0, 8, True), (6, 0, 6, True),
                                          (5, 0, 5, True), (3, 0, 3, True), (2, 0, 2, True), (1, 0, 1, True), (0, 2, 0, True), (11, 2, 0, False), (12, 2, 0, False)])
    assert joined(spark, []) == [] and joined(spark, [(3, None)]) == [(3, 0, 3, True)]


def test_many_copies(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(3000)]
    assert set(r[1:3] for r in joined(spark, rows)) == {(2999, 0)}


def test_graph_alone_finds_neighbours():
    rng = np.random.default_rng(4)
    v = hnsw.unit(rng.normal(size=(800, 12))).astype(np.float32)
    levels = np.floor(-np.log(rng.random(800)) / np.log(hnsw.DEGREE)).astype(int)
    g = hnsw.build(v, levels)
    q = g.v[:200]
    idx, _ = g.search(q, 0, g.descend(q, 0, 0, len(v)), 48, len(v))
    true = np.argsort(-(q @ g.v.T), axis=1)[:, :10]
    assert np.mean([len(np.intersect1d(a, b)) / 10 for a, b in zip(idx, true)]) > 0.9 and g.top > 0


def lonely(n=2000, pairs=60, dim=16):
    """A dense crowd and pairs far from it, whose nodes the crowd's lists leave out."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=dim) + rng.normal(size=(n, dim)) * 0.5
    v[:2 * pairs] = rng.normal(size=(2 * pairs, dim))
    v[:pairs] = v[pairs:2 * pairs] + rng.normal(size=(pairs, dim)) * 0.2
    return [(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(v[rng.permutation(n)])]


@pytest.mark.parametrize("shard_nodes", [8192, 700])
def test_links_count_for_both_ends(spark, shard_nodes):
    rows = lonely()
    v = hnsw.unit(np.array([x for _, x in rows]))
    near = v @ v.T >= hnsw.SIMILARITY
    got = joined(spark, rows, shard_nodes=shard_nodes, block_nodes=300)
    total = sum(r[1] for r in got)
    assert 0.98 * (near.sum() - len(v)) <= total <= near.sum() - len(v)
    assert total % 2 == 0  # distinct vectors: each link twice


def test_unreachable_nodes_are_compared():
    v = hnsw.unit(np.array([x for _, x in lonely(1500)]))
    ids = np.arange(1500)
    g = hnsw.build(v.astype(np.float32), np.zeros(1500, int))
    for layer in g.links:
        layer[:] = -1
    v = v[g.order]
    found = hnsw.audit(ids, v, ids, g, v, 0.9, 0.98)
    assert [f[0] for f in found] == hnsw.beams(1500) and all(f[1] < 0.98 * f[2] for f in found)
    links = hnsw.links_between(ids, v, ids, g, v, 0.9, hnsw.EXACT)
    assert sum(map(len, links)) == np.count_nonzero(v @ v.T >= 0.9) - 1500
