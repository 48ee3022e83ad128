"""Spelling variants against a plain version: all pairs of words, letter by letter."""

import random
import re
import zlib
from collections import Counter

import pytest

from palaver.llm import spelling


def plain_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))


def plain_variants(rows):
    words = plain_words(rows)
    out = {}
    for w, n in words.items():
        near = [v for v in words if plain_near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if near and words[best] >= 2 * n else None, w, n, len(near)]
    for w, r in out.items():
        while out[r[1]][0] is not None:
            r[1] = out[r[1]][0]
    return {(w, f, root, n, k, words[f] if f else None) for w, (f, root, n, k) in out.items()}


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    out = spelling.variants(df, **options)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def texts(seed, n=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(80):
            w = rng.choice(stems)
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w, w, w.upper(), w[:at] + rng.choice("abÿ×") + w[at:], w[:at] + w[at + 1:], w[:at] + "z" + w[at + 1:]])
            words.append(w)
        rows.append((k, rng.choice([" ", ", ", "\n", "1"]).join(words)))
    chain = ["kkkkkkk"] * 90 + ["kkkkkko"] * 40 + ["kkkkkoo"] * 18 + ["kkkkooo"] * 6
    return [*rows, (None, " ".join(chain))]


@pytest.mark.parametrize("options", [{}, {"shard_words": 12}, {"shard_words": 5, "groups": 2}, {"shard_words": 30, "part_queries": 7}])
def test_same_as_all_pairs(spark, options):
    rows = texts(1)
    want = plain_variants(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)
    assert found(spark, rows, **options) == want


def test_edges(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, None), (2, ""), (None, "1 2 3 日本語 ab abc abcd")]) == set()
    long = "ab" * 40_000
    rows = [(None, f"{long} {long}x {long[1:]} hello hallo")] * 7 + [(5, "hello hallo HELLO Éllos éllos")] * 5
    assert found(spark, rows) == plain_variants(rows)


def test_ties_go_to_the_smallest_word(spark):
    rows = [(k, "abcdeg abcdex abcdea abcdex abcdea") for k in range(4)]
    out = {r[0]: r for r in found(spark, rows)}
    assert out["abcdeg"][1] == "abcdea" and out == {r[0]: r for r in plain_variants(rows)}


def test_word_by_word_comparison():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))
        assert spelling.differ_by_one(a.encode(), b.encode()) == plain_near(a, b)
