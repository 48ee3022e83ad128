"""Differencing on small cases, and the law of equal bytes."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from palaver.llm import sharding


def test_differencing_two_ways():
    parts = sharding.differencing([[(w, [w])] for w in (8, 7, 6, 5, 4)], 2)
    assert sorted(x for x, _ in parts) == [14, 16]  # the textbook case
    assert sorted(i for _, p in parts for i in p) == [4, 5, 6, 7, 8] and all(sum(p) == x for x, p in parts)
    assert sharding.differencing([], 3) == [(0, [])] * 3


@pytest.mark.parametrize("k", [2, 3, 7])
def test_differencing_beats_greedy(k):
    rng = random.Random(k)
    for _ in range(20):
        w = [rng.randrange(1, 1000) for _ in range(60)]
        parts = sharding.differencing([[(x, [x])] for x in sorted(w, reverse=True)], k)
        assert sorted(x for _, p in parts for x in p) == sorted(w)
        greedy = [0] * k
        for x in w:
            greedy[greedy.index(min(greedy))] += x
        assert parts[0][0] - parts[-1][0] <= max(greedy) - min(greedy)


def sharded(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, shard int, key string")
    return sharding.shard(df, **options).collect()


@pytest.mark.parametrize("items,k", [(10_000, 3), (40, 3), (12, 4)])
def test_same_as_differencing_by_hand(spark, items, k):
    """The placement itself: heavy groups alone, light ones in bundles by the same hash, differenced in plain Python."""
    rng = random.Random(items)
    weights = {f"g{i}": rng.choice([7, rng.randrange(1, 5000), 90_000 if i % 50 == 0 else 7]) for i in range(150)}
    df = spark.createDataFrame(list(weights.items()), "key string, weight long")
    got = {r["key"]: r["shard"] for r in sharding.balance(df.repartition(3), k, items).collect()}
    bundle = {r["key"]: f"bundle {r['b']}" for r in df.selectExpr("key", f"pmod(xxhash64(key), {items}) AS b").collect()}
    alone = len(weights) <= items
    item = {key: key if alone or w * items >= sum(weights.values()) else bundle[key] for key, w in weights.items()}
    sums = Counter()
    for key, w in weights.items():
        sums[item[key]] += w
    parts = sharding.differencing([[(sums[i], [i])] for i in sorted(sums, key=lambda i: (-sums[i], i))], k)
    where = {i: shard for shard, (_, members) in enumerate(parts) for i in members}
    assert got == {key: where[item[key]] for key in weights} and len(sums) == (150 if alone else len(sums)) <= max(150, 2 * items)


@pytest.mark.parametrize("items", [10_000, 300])
def test_shards(spark, items):
    rng = random.Random(1)
    texts = ["é" * rng.randrange(1, 400) + str(i) for i in range(900)] + ["same text"] * 200 + [None] * 30 + [""] * 20
    rows = [(k // 2 if k < 10 else k, t) for k, t in enumerate(texts)]
    out = sharded(spark, rows, n_shards=8, items=items)
    assert len(out) == len(rows) and {r["shard"] for r in out} == set(range(8))
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    for r in by.values():
        assert sorted(x["slot"] for x in r) == list(range(len(r)))
    total = Counter({s: sum(x["size"] for x in r) for s, r in by.items()})
    assert max(total.values()) - min(total.values()) < 0.01 * max(total.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in out) == want
    where = defaultdict(set)
    for r in out:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    crc = {(zlib.crc32(t.encode()), len(t.encode()) + 16) for t in texts if t}
    assert all(len(where[c]) == 1 for c in crc)
    again = sharded(spark, rows[::-1], n_shards=8, items=items)
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_edges(spark):
    assert sharded(spark, []) == []
    out = sharded(spark, [(None, None), (None, None), (None, "")])
    assert len({r["shard"] for r in out if r["size"] == 16}) <= 2 and len(out) == 3
    big = sharded(spark, [(1, "x" * 200_000)] + [(k, f"t{k}") for k in range(2, 50)])
    assert len([r for r in big if r["shard"] == next(b["shard"] for b in big if b["id"] == 1)]) == 1
