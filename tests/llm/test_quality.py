"""Quality rules against a plain version, and the forest by path lengths and held-out labels."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from palaver.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if seen[tuple(words[k:k + 8])] > 1 for j in range(8)}
    lines, earlier = 0, set()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in earlier
            earlier.add(line)
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, r, n < 20 or 100 * r > 30 * n


def texts(seed=1, n=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé日") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    out = [None, "", " \n\t ", "\x1c\x85\xa0 a", "a" * 100_000, "x y " * 20_000, "a|b\n" * 3 + " \n \n", "\x0bword\x0c" * 30]
    for _ in range(n):
        some = [rng.choice(words) + rng.choice(["", "", ",", ".", "#", "\U0001f600"]) for _ in range(rng.randrange(5, 120))]
        if rng.random() < 0.4:
            at = rng.randrange(len(some))
            some[rng.randrange(len(some)):0] = some[at:at + rng.randrange(6, 30)] * rng.randrange(1, 3)
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\t", "  ", "\r\n"]) for w in some)
        out.append(text + (text[:40] + "\n" + text[:40] + "\n" if rng.random() < 0.2 else ""))
    return out


def rows_of(spark, rows, labels, **options):
    docs = spark.createDataFrame([(*r, 1.0, "x", False) for r in rows], "doc_id long, text string, score double, id string, kept boolean")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    return quality.judge(docs.repartition(3), known, **options).collect()


def test_counts_same_as_plain(spark):
    rows = list(enumerate(texts()))
    out = {r["id"]: r for r in rows_of(spark, rows, [])}
    for k, text in rows:
        r = out[k]
        assert (*[r[c] for c in quality.BASE], r["base_failed"]) == plain(text), (k, text and text[:200])
        assert r["kept"] == (not r["base_failed"])  # nothing is learnt without labels


def test_windows_do_not_cross_texts():
    words = b"a b c d e f g h".split()
    assert quality.repeats(words * 2, np.repeat([0, 1], 8), 2)[0].tolist() == [0, 0]
    assert quality.repeats(words * 2, np.repeat([0, 1], [16, 0]), 2)[0].tolist() == [16, 0]
    assert quality.repeats(words[:3], np.zeros(3, int), 1)[0].tolist() == [0]
    assert quality.repeats([], np.zeros(0, int), 2)[1].tolist() == [0, 0]


def test_lonely_rows_have_short_paths():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(0, 1, (500, 6)), [[9] * 6]])
    trees = quality.forest(rows[rng.permutation(501)], 50, 64)
    score = quality.anomaly(rows, trees, 64)
    assert score.argmax() == 500 and score[500] > 0.65 and np.median(score) < 0.5
    t = trees[0]

    def walk(x, at=0):  # one row at a time
        f = t["feature"][at]
        return t["length"][at] if f < 0 else walk(x, t["left"][at] + (x[f] > t["value"][at]))

    one = quality.anomaly(rows[:40], [t], 64)
    assert np.allclose(one, [2 ** -(walk(x) / quality.mean_path(64)) for x in rows[:40]])
    assert quality.anomaly(rows[:2], [], 64).tolist() == [1.0, 1.0] and quality.forest(np.zeros((3, 6)), 2, 64)[0]["length"].tolist() == [quality.mean_path(3)]


def test_edges(spark):
    assert rows_of(spark, [], [(1, 0)]) == []
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    odd = " ".join(f"{w}###" for w in text.split())
    rows = [(None, text), (1, text), (1, text), (2, odd), (3, None), (4, ""), (None, odd)] + [(k, text) for k in range(10, 60)]
    labels = [(k, 1) for k in range(10, 50)] + [(2, 0), (2, None), (None, 0), (3, 0)]
    out = Counter((r["id"], r["kept"]) for r in rows_of(spark, rows, labels))
    assert out[None, True] == 1 and out[None, False] == 1 and out[1, True] == 2 and out[2, False] == 1 and out[3, False] == out[4, False] == 1
    assert all(out[k, True] == 1 for k in range(10, 60))
    assert sorted(map(str, rows_of(spark, rows, labels))) == sorted(map(str, rows_of(spark, rows[::-1], labels[::-1])))


@pytest.mark.parametrize("half", [0, 1])
def test_held_out_labels(spark, half):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = quality.judge(spark.read.parquet(f"{folder}/documents.parquet"), labels.filter(f"doc_id % 2 = {half}"))
    kept = {r["id"]: r["kept"] for r in out.collect()}
    held = [(kept[i], q) for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet' WHERE doc_id % 2 <> {half}").fetchall()]
    good = [k for k, q in held if q]
    bad = [k for k, q in held if not q]
    assert sum(good) > 0.93 * len(good) and sum(bad) < 0.15 * len(bad)
