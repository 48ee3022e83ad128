"""Restoring disguised words, and held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import toxicity as tx

WORDS = "the a of and to in that worthless idiot clown garden water stone river mountain letter people little green morning scum pathetic moron table".split()


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    texts = [(" ".join(rng.choice(WORDS) for _ in range(200)),) for _ in range(50)]
    return tx.character_model(tx.gram_counts(spark.createDataFrame(texts, "text string")))


@pytest.mark.parametrize("shown,meant", [
    ("1d10t", "idiot"), ("cl0wn", "clown"), ("m0r0n", "moron"), ("$cum", "scum"), ("idiooooot", "idiot"), ("i.d.i.o.t", "idiot"), ("p@th3t1c", "pathetic"),
    ("w0rthle$$", "worthless"), ("sssscum", "scum"), ("w-o-r-t-h-l-e-s-s", "worthless"), ("i-d-1-o-t", "idiot")])
def test_restore(model, shown, meant):
    assert tx.disguised(tx.core(shown)) and tx.restore(tx.core(shown), model) == meant


def test_plain_words_stay(model):
    for w in WORDS:
        assert tx.words_of(w, model) == [w]
    assert "i.d.i.o.t" in tx.tokens_of("you are an I D I O T.") and "idiot" in tx.words_of("i.d.i.o.t", model)
    assert tx.core('"word$$$",') == "word" and tx.core("$cum!") == "$cum"


def test_restored_path_is_the_cheapest(model):
    """Against every path of the lattice."""
    def paths(token):
        out = [("", 0.0, "")]
        for ch in token:
            new = []
            for text, cost, before in out:
                code = tx.CODES.get(ch, 0)
                if code:
                    new.append((text + ch, cost, ch))
                    if ch == before:
                        new.append((text, cost + tx.REPEAT_COST, ch))
                elif ch in tx.SIGNS:
                    new += [(text + x, cost + tx.SIGN_COST, ch) for x in tx.SIGNS[ch]]
                    new.append((text, cost + (tx.REPEAT_COST if ch == before else tx.DROP_SIGN_COST), ch))
                else:
                    new.append((text, cost + tx.SEPARATOR_COST, ch))
            out = new
        return out

    def price(text, cost):
        codes = [0, 0, 0, *[tx.CODES[c] for c in text], 0]
        for i in range(3, len(codes)):
            cost -= float(model[((codes[i - 3] * 27 + codes[i - 2]) * 27 + codes[i - 1]) * 27 + codes[i]])
        return cost

    rng = random.Random(5)
    for _ in range(60):
        token = "".join(rng.choice("aeilst1034$.o") for _ in range(rng.randrange(1, 8)))
        best = min(price(t, c) for t, c, _ in paths(token))
        found = tx.restore(token, model)
        assert min(price(t, c) for t, c, _ in paths(token) if t == found) == pytest.approx(best, abs=1e-3)


def test_counts_cover_whole_texts(spark):
    texts = ["Ab é", None, "", "x" * 3_000_000]
    got = {r["code"]: r["n"] for r in tx.gram_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    want = Counter()
    for t in texts:
        c = [0, 0, 0, *[tx.CODES.get(x, 0) for x in t or ""], 0, 0, 0] if t else []
        for i in range(3, len(c)):
            want[((c[i - 3] * 27 + c[i - 2]) * 27 + c[i - 1]) * 27 + c[i]] += 1
    assert {k: n for k, n in got.items() if k} == {k: n for k, n in want.items() if k}


def labelled(spark, n=2500):
    rng = random.Random(9)
    bad = {"idiot", "clown", "scum", "pathetic", "moron", "worthless"}
    disguise = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$"}
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.2)
        words = [rng.choice([w for w in WORDS if w not in bad]) for _ in range(rng.randrange(3, 60))]
        for _ in range(rng.randrange(1, 4) * y):
            w = rng.choice(sorted(bad))
            w = rng.choice([w, w.upper(), "".join(disguise.get(c, c) for c in w), " ".join(w)]) if w != "clown" else w
            words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "lang", 0.5))
        if i % 3:
            labels.append((i, y))
            if i % 50 == 1:
                labels += [(i, 0), (i, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.mark.parametrize("most", [tx.TRAIN_ROWS, 400])
def test_held_out_accuracy(spark, most):
    docs, labels = labelled(spark)
    out = tx.score(docs, labels, train_rows=most)
    y = labels.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    held = out.join(y, out["id"] == y["doc_id"]).filter("held_out").collect()
    right = sum(r["predicted"] == r["y"] for r in held)
    assert right >= 0.97 * len(held) and len(held) > 300
    rows = out.collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert {r["id"] for r in rows if r["held_out"]} == {i for i in range(2500) if __import__("zlib").crc32(str(i).encode()) % 4 == 2}


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "idiot " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = tx.score(docs, none).collect()
    assert len(rows) == 4 and all(r["score"] == 0.0 and r["predicted"] == 0 for r in rows)
    assert tx.score(docs.limit(0), none).collect() == []
    odd = spark.createDataFrame([(None, 1), (2, None), (1, 1)], "doc_id long, toxic int")
    assert all(math.isfinite(r["score"]) for r in tx.score(docs, odd).collect())


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] - 1)))).astype(float)
    assert np.allclose(tx.fit_logistic(x, y), [2, -1, -1], atol=0.25)


@pytest.mark.parametrize("shown,meant", [
    ("iddiiot", "idiot"), ("i,d,i,o,t", "idiot"), ("i/d/i/o/t", "idiot"), ("i~d~i~o~t", "idiot"), ("1d107", "idiot"), ("i  d  i  o  t", "idiot"), ("i\td\ti\no\tt", "idiot"),
    ("5ccuumm", "scum"), ("m/0/r/0/n", "moron")])
def test_every_disguise_is_decoded(model, shown, meant):
    assert meant in {w for t in tx.tokens_of(f"you are {shown}.") for w in tx.words_of(t, model)}


def test_signs_alone_are_decoded():
    spelled = np.full(tx.LETTERS ** 4, -9.0, np.float32)
    codes = [0, 0, 0, *[tx.CODES[c] for c in "ass"], 0]
    for i in range(3, len(codes)):
        spelled[((codes[i - 3] * 27 + codes[i - 2]) * 27 + codes[i - 1]) * 27 + codes[i]] = -0.1
    for shown in ("@$$", "455", "4$$", "a$$"):
        assert "ass" in tx.words_of(shown, spelled)
