"""Greedy string tiling against a plain quadratic version, and planted passages."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from palaver.llm import decontam as dc


def plain_tiles(item, doc, shortest):
    """Longest matches first, by comparing every start with every start."""
    mi, md = [x < 0 for x in item], [x < 0 for x in doc]
    tiles = []
    while True:
        best, starts = shortest - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mi[i + n] and not md[j + n]:
                    n += 1
                if n > best:
                    best, starts = n, [(i, j)]
                elif n == best and n >= shortest:
                    starts.append((i, j))
        if best < shortest:
            return tiles
        for i, j in starts:
            if not any(mi[i:i + best]) and not any(md[j:j + best]):
                mi[i:i + best] = md[j:j + best] = [True] * best
                tiles.append((i, j, best))


@pytest.mark.parametrize("seed", range(30))
def test_tiles(seed):
    rng = random.Random(seed)
    item = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))]
    doc = [rng.choice([-1, 1, 2, 3, 4]) for _ in range(rng.randrange(0, 60))]
    at = rng.randrange(len(doc) + 1)
    doc[at:at] = item[len(item) // 2:] + item[:len(item) // 2]
    shortest = rng.choice([1, 2, 3, 5])
    assert dc.tile(item, doc, shortest) == plain_tiles(item, doc, shortest)


@pytest.mark.parametrize("seed", range(30))
def test_tiles_of_repeated_words(seed):
    rng = random.Random(seed)
    item = [rng.choice([1, 1, 1, 2]) for _ in range(rng.randrange(1, 14))]
    doc = [rng.choice([-1, 1, 1, 1, 1, 2]) for _ in range(rng.randrange(0, 70))]
    shortest = rng.choice([1, 2, 3])
    assert dc.tile(item, doc, shortest) == plain_tiles(item, doc, shortest)


def test_equal_words_need_no_pairs():
    item, doc = np.ones(200, np.int64), np.ones(1_000_000, np.int64)
    tracemalloc.start()
    begun = time.process_time()
    assert dc.tile(item, doc, 5) == [(0, 0, 200)]
    took, most = time.process_time() - begun, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 10 and most < 250e6, (took, most)
    mixed = np.tile([1, 2], 100_000)
    assert sum(n for _, _, n in dc.tile(np.tile([2, 1, 1], 60), mixed, 2)) == 179  # the longest match is 1 2 1


def by_force(docs, items, match=dc.MATCH, coverage=dc.COVERAGE):
    out = []
    for d, t in docs:
        for i, s in items:
            item = dc.words(s)
            if item:
                ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
                tiles = plain_tiles([ids[w] for w in item], [ids.get(w, -1) for w in dc.words(t)], min(match, len(item)))
                covered = sum(x[2] for x in tiles)
                if covered >= coverage * len(item):
                    out.append((d, i, len(item), covered, len(tiles), tiles[0][2]))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 2000])
def test_planted(spark, block_bytes):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 30, 45])))) for k in range(12)] + [(90, None), (91, " .. "), (2, "v1 v2 v3 v4 v5 v6")]
    docs = [(0, None), (1, ""), (1, "")]
    for k in range(40):
        w = " ".join(rng.choice(vocab) for _ in range(60))
        it = rng.choice(items)[1] or ""
        half = it.split(" ")
        n = len(half) // 2
        moved = " ".join(half[n:]) + " other words between " + " ".join(half[:n])
        docs.append((k + 2, rng.choice([w, w + " " + it.upper() + "! " + w, w + ". " + moved, " ".join(half[:n // 2]) + w])))
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(tuple(r) for r in dc.find(d, b, block_bytes=block_bytes).collect())
    assert got == by_force(docs, items) and len({r[0] for r in got}) > 10
    assert dc.find(d.limit(0), b).collect() == [] and dc.find(d, b.limit(0)).collect() == []


def test_long_text(spark):
    item = " ".join(f"q{i}" for i in range(40))
    text = "x " * 200_000 + item
    d = spark.createDataFrame([(None, text)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [tuple(r) for r in dc.find(d, b).collect()] == [(None, 1, 40, 40, 1, 40)]


def test_hashes_of_windows():
    ids = np.array([3, 1, 2, 3, 1, 2, 9])
    r = dc.Rolling(ids, 8)
    w = r.windows(3, 8)
    assert w[0] == w[3] and len(set(w.tolist())) == 4
