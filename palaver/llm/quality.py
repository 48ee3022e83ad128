"""Quality rules, and an isolation forest over their statistics for what the fixed limits let through.

A tree splits a sample of documents at random values of random statistics; documents that soon stand alone, over many trees,
are anomalous. The score above which a document is rejected comes from labelled rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.threads import lookup
from .common import small_batches, stored

MIN_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
TREES, SAMPLE = 200, 64  # trees of the forest, and documents that each is grown on
MOST_LOST = 0.01  # share of the rows labelled good that the forest may reject; one of them it may always
BINS = 4096  # of the scores of labelled rows

# Bytes that count as symbols and as marks.
SYMBOLS, MARKS = b"#*$%&|<>", b".,;:!?"
BLANKS = b" \t\n\v\f\r"
NO_LETTER = bytes(c for c in range(128) if not chr(c).isalpha() and c not in BLANKS)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["chars_per_word", "symbols_per_word", "marks_per_word", "letterless", "distinct", "duplicate_lines"]


def repeats(words: list[bytes], owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in windows found twice or more in their text, and distinct words, of each text.

    words: those of all texts in a row; owner: index of the text of each. Windows are numbered by doubling: pairs of
    words, pairs of pairs, pairs of those, so that equal numbers mean equal windows.
    """
    n = len(words)
    if not n:
        return np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    code = pd.factorize(np.fromiter(words, object, n))[0].astype(np.int64)
    distinct = np.bincount(pd.unique(owner * n + code) // n, minlength=texts)
    width = 1
    while width < WINDOW and len(code) > width:
        code = pd.factorize(code[:-width] * n + code[width:])[0].astype(np.int64)
        width *= 2
    if width < WINDOW:
        return np.zeros(texts, np.int64), distinct
    at = np.flatnonzero(owner[:len(code)] == owner[WINDOW - 1:])
    same = pd.factorize(owner[at] * n + code[at])[0]
    again = at[np.bincount(same)[same] > 1]
    edges = np.bincount(again, minlength=n + 1) - np.bincount(again + WINDOW, minlength=n + 1)
    return np.bincount(owner[np.cumsum(edges)[:n] > 0], minlength=texts), distinct


def text_statistics(texts: list[bytes]) -> pd.DataFrame:
    """BASE counts and FEATURES of whole texts in UTF-8; a text without words has none but symbols and marks."""
    words, n_words = [], []
    for b in texts:
        some = b.split()
        words += some
        n_words.append(len(some))
    n_words = np.array(n_words, np.int64)
    repeated, distinct = repeats(words, np.repeat(np.arange(len(texts)), n_words), len(texts))
    del words

    def count(of):
        return np.fromiter(map(of, texts), np.int64, len(texts))

    def without(chars: bytes):
        return lambda b: len(b) - len(b.translate(None, chars))

    def duplicates(b: bytes) -> tuple[int, int]:
        lines = [x for x in b.split(b"\n") if x.strip()]
        return len(lines) - len(set(lines)), len(lines)

    lines = np.array([duplicates(b) for b in texts], np.int64).reshape(-1, 2)
    chars = count(lambda b: len(b.decode().translate({c: None for c in BLANKS})) if not b.isascii() else len(b.translate(None, BLANKS)))
    symbols, some = count(without(SYMBOLS)), np.maximum(n_words, 1)
    return pd.DataFrame({
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines[:, 0], "n_repeat_words": repeated,
        "chars_per_word": chars / some, "symbols_per_word": symbols / some, "marks_per_word": count(without(MARKS)) / some,
        "letterless": 1 - count(lambda b: len(b.translate(None, NO_LETTER).split())) / some, "distinct": distinct / some,
        "duplicate_lines": lines[:, 0] / np.maximum(lines[:, 1], 1)})


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, BASE, FEATURES, base_failed) of every document. Null texts count as empty."""
    def measure(batches):
        for pdf in batches:
            yield pd.concat([pdf[["id"]], text_statistics([(t or "").encode() for t in pdf["text"]])], axis=1)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = [f"{c} long" for c in BASE] + [f"{c} double" for c in FEATURES]
    out = rows.mapInPandas(measure, ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *kinds]))
    repetitive = F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repetitive)


# The forest ------------------------------------------------------------------------------

def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n, the measure of a path's length."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(rows: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree as arrays over its nodes: feature (-1: leaf), value, left child (the right one follows), path length."""
    feature, value, left, length = [], [], [], []
    deepest = int(np.ceil(np.log2(max(2, len(rows)))))
    queue = [(rows, 0)]
    for some, depth in queue:  # grows while it is read
        low, high = some.min(0), some.max(0)
        split = np.flatnonzero(high > low) if depth < deepest else []
        if len(split):
            f = int(rng.choice(split))
            at = rng.uniform(low[f], high[f])
            feature.append(f)
            value.append(at)
            left.append(len(queue))
            length.append(0.0)
            queue += [(some[some[:, f] <= at], depth + 1), (some[some[:, f] > at], depth + 1)]
        else:
            feature.append(-1)
            value.append(0.0)
            left.append(0)
            length.append(depth + mean_path(len(some)))
    return {"feature": np.array(feature), "value": np.array(value), "left": np.array(left), "length": np.array(length), "depth": deepest}


def forest(rows: np.ndarray, trees: int, sample: int) -> list[dict[str, np.ndarray]]:
    """Trees on consecutive samples of the rows, starting over where these end. The splits are the same in each run."""
    out = []
    for k in range(trees if len(rows) else 0):
        at = (np.arange(min(sample, len(rows))) + k * sample) % len(rows)
        out.append(grow(rows[at], np.random.default_rng(k)))
    return out


def anomaly(rows: np.ndarray, trees: list[dict[str, np.ndarray]], sample: int) -> np.ndarray:
    """2 to the power of minus the mean path over that of a sample: near 1 for rows that soon stand alone."""
    total = np.zeros(len(rows))
    for t in trees:
        at = np.zeros(len(rows), np.int64)
        for _ in range(t["depth"]):
            f = t["feature"][at]
            right = rows[np.arange(len(rows)), np.maximum(f, 0)] > t["value"][at]
            at = np.where(f < 0, at, t["left"][at] + right)
        total += t["length"][at]
    return 2.0 ** -(total / max(1, len(trees)) / max(mean_path(sample), 1e-9))


def sample_rows(stats: DataFrame, most: int) -> np.ndarray:
    """At most so many documents that passed the rules, by a hash of id and statistics, in its order."""
    passed = stats.filter(~F.col("base_failed"))
    share = most / max(1, passed.count())
    h = F.xxhash64("id", *FEATURES)
    some = passed.select(h.alias("h"), *FEATURES).filter((F.shiftrightunsigned("h", 11) * 2.0 ** -53) < 2 * share)
    return some.orderBy("h", *FEATURES).limit(most).toPandas()[FEATURES].to_numpy(float)


def threshold(scored: DataFrame, labels: DataFrame, label_id: str, label_col: str, most_lost: float) -> float | None:
    """The score that separates good from bad best among those that reject no more than most_lost of the good.

    All labelled documents that passed the rules count, by bins of their score. None without rows of both classes.
    """
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    seen = lookup(scored.filter("NOT base_failed AND id IS NOT NULL"), known, "id", "score").filter("y IS NOT NULL")
    bins = seen.groupBy(F.floor(F.col("score") * BINS).alias("bin"), "y").agg(F.count("*").alias("n")).collect()
    count = np.zeros((BINS + 2, 2))
    for r in bins:
        count[r["bin"], r["y"]] += r["n"]
    if not count.sum(0).all():
        return None
    reached = count[::-1].cumsum(0)[::-1] / count.sum(0)  # share at or above each bin
    gain = np.where(reached[:, 1] <= max(most_lost, 1 / count[:, 1].sum()), reached[:, 0] - reached[:, 1], -1)
    return len(gain) - 1 - int(np.argmax(gain[::-1]))  # of equal ones the highest


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
          label_col: str = "quality", trees: int = TREES, sample: int = SAMPLE, most_lost: float = MOST_LOST) -> DataFrame:
    """(id, BASE, base_failed, score, kept) of every document.

    base_failed: fewer than 20 words, or more than 30 percent of them in repeated windows. The forest is grown on at most
    trees * sample documents that passed and scores all; score is between 0 and 1, higher for stranger documents. kept:
    not base_failed, and the score is below the threshold, which all labelled documents (label above 0: good) set. Without labels of both
    kinds nothing is anomalous. Of several labels of an id the largest counts; null labels and ids teach nothing. Null
    and empty texts fail the rules. Repeated rows get equal verdicts. Other columns are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stats = stored(statistics(docs, id_col, text_col))
    rows = sample_rows(stats, trees * sample)
    grown = spark.sparkContext.broadcast(forest(rows, trees, sample))
    size = min(sample, len(rows))

    def rate(batches):
        for pdf in batches:
            yield pdf[["id", *BASE, "base_failed"]].assign(score=anomaly(pdf[FEATURES].to_numpy(float), grown.value, size))

    shape = stats.select("id", *BASE, "base_failed", F.lit(0.0).alias("score")).schema
    scored = stored(stats.mapInPandas(rate, shape))
    bound = threshold(scored, labels, label_id, label_col, most_lost)
    normal = F.lit(True) if bound is None else F.floor(F.col("score") * BINS) < bound
    return scored.withColumn("kept", ~F.col("base_failed") & normal)
