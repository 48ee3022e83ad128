"""The Jaccard join against all pairs compared one by one."""

import random
from collections import defaultdict

import numpy as np
import pytest

from palaver.llm import jaccard

SCHEMA = "doc_id long, text string, node string"
BLANK = " \t\n\x0b\x0c\r"


def shingle_set(text):
    words, word = [], ""
    for ch in text or "":
        if ch in BLANK:
            words.append(word)
            word = ""
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    words = [w for w in [*words, word] if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def by_force(rows):
    """doc_id to (n, component) from all pairs that share a shingle."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    pairs = set()
    for k, (_, s) in enumerate(sets):
        met = defaultdict(int)
        for x in s:
            for o in where[x]:
                if o < k:
                    met[o] += 1
        for o, n in met.items():
            if 100 * n >= 75 * (len(s) + len(sets[o][1]) - n):
                pairs.add((o, k))
                root[find(k)] = find(o)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(i, low.get(find(k), i))
    return sorted((i, len(s), low[find(k)]) for k, (i, s) in enumerate(sets)), pairs


def joined(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    return sorted(tuple(r) for r in jaccard.near_duplicates(df).collect())


def random_rows(seed, n=260):
    """Copies and near copies in chains, texts of one to a few hundred words, a passage that most documents share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.45:
            t = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(t) + 1)
                what = rng.random()
                if what < 0.4:
                    t[at:at + 1] = [rng.choice(words)]
                elif what < 0.7:
                    t[at:at] = [rng.choice(words)]
                else:
                    t[at:at + 1] = []
            text = " ".join(t)
        else:
            text = " ".join(rng.choice(words) for _ in range(int(2 ** rng.uniform(0, 8))))
            if kind > 0.6:
                text = passage + " " + text
        texts.append(text)
        rows.append((i * 7 % 1009, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed):
    rows = random_rows(seed)
    assert joined(spark, rows) == by_force(rows)[0]


def test_no_pair_is_missed_by_the_signatures():
    rows = random_rows(11, 500)
    _, pairs = by_force(rows)
    sketch = np.zeros(1 << jaccard.SKETCH_BITS, np.uint32)
    sets = [jaccard.shingles(t) for _, t in rows]
    for s in sets:
        np.add.at(sketch, (s >> np.uint64(64 - jaccard.SKETCH_BITS)).astype(np.int64), 1)
    for plan in ({}, {c: 1 for c in range(2, 12)}, {c: 2 for c in range(3, 12)}):
        sigs = [set(jaccard.signatures(s, sketch, plan).tolist()) for s in sets]
        assert all(sigs[a] & sigs[b] or np.array_equal(sets[a], sets[b]) for a, b in pairs)
    bits = [jaccard.bitmap(s) for s in sets]
    for a, b in list(pairs)[:300]:
        apart = len(np.setxor1d(sets[a], sets[b]))
        assert jaccard.differing_bits(bits[a], bits[b]) <= apart <= jaccard.allowance(len(sets[a]), len(sets[b]))


@pytest.mark.parametrize("block", [16_384, 4])
def test_rest_of_a_group_is_compared_by_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard.links, "__defaults__", (jaccard.PERCENT, 0))
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL", 3)
    rows = random_rows(5, 150)
    assert joined(spark, rows) == by_force(rows)[0]


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "A b"), (8, "a\tB"), (7, "a b c"), (20, long), (11, long + " tail"), (2, "é É"), (2, "é É"), (1, "é é")]
    assert joined(spark, rows) == by_force(rows)[0]
    assert joined(spark, []) == []
    assert joined(spark, [(None, "one two three four five six"), (3, "one two three four five six"), (None, None)].copy()[1:2]) == [(3, 2, 3)]


def test_null_ids(spark):
    near = " ".join("abcdefghijklmnopqrstuvw")
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, None), (None, near), (8, near + " x")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, jaccard.near_duplicates(df).collect()))) == ["(3, 2, 3)", "(8, 20, 8)", "(None, 0, None)", "(None, 19, 8)", "(None, 2, 3)"]


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in jaccard.near_duplicates(df).collect()) == by_force(rows)[0]
