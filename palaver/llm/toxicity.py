"""Toxicity scores behind a noisy-channel deobfuscation.

A token that is not a plain word without double letters may be disguised (digits and signs for letters, letters set
apart by any signs or blanks, letters repeated): it is a lattice of the letters that may have been meant. The best path under a character model of the whole corpus and the costs of the
channel is the restored word. Tokens and their restored forms are scored by the labelled classes in which their
character n-grams occur, and the document by its worst words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

TRAIN_ROWS = 10_000  # labelled rows the classifier is fitted on, at most about
THRESHOLD = 0.3
GRAMS = (4, 5)
MIN_ROWS = 4  # toxic rows that an n-gram must occur in
MIN_EVIDENCE = 20.0  # log-likelihood ratio of an n-gram
KNOWN_TOKENS = 400_000  # tokens whose weight a task remembers at once
KNOWN_GRAMS = 40_000  # tokens whose n-grams it remembers at once
LETTERS = 27  # a to z, and 0 for the edge of a word

# Signs and the letters they stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "§": "s", "µ": "u", "¡": "i",
}
# Costs of the channel, in nats.
SIGN_COST, DROP_SIGN_COST, SEPARATOR_COST, REPEAT_COST = 1.0, 4.0, 0.2, 1.0

EDGES = ".,;:!?\"'()[]{}<>…*%&#~`^/\\-_=«»„“”‘’"
TRIPLE_SIGN = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
WORD = re.compile(r"[^\W\d_]+")
SIGN = re.compile("[" + re.escape("".join(SIGNS)) + "]")
REPEATED = re.compile(r"([^\W\d_])\1")
SPACED = re.compile(r"(?<!\S)[^\s.,;:](?:\s+[^\s.,;:]){2,}(?=[.,;:!?]*(?:\s|$))")


def _fold_table() -> tuple[np.ndarray, dict[str, int]]:
    import unicodedata

    table, codes = np.zeros(256, np.uint8), {}
    for i in range(256):
        base = unicodedata.normalize("NFD", chr(i).lower())[:1]
        base = {"ß": "s", "æ": "a", "ø": "o", "ð": "d", "þ": "t"}.get(base, base)
        if "a" <= base <= "z":
            table[i] = ord(base) - 96
            codes[chr(i)] = int(table[i])
    return table, codes


FOLD, CODES = _fold_table()


def letter_codes(text: str) -> np.ndarray:
    """1 to 26 for Latin letters without accents and case, 0 for all else."""
    return FOLD[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): how often each run of four letters and word edges occurs in all texts."""
    def run(batches):
        total, edges = np.zeros(LETTERS ** 4, np.int64), np.zeros(3, np.uint8)

        def add(pieces: list[np.ndarray]) -> None:
            c = np.concatenate([edges, *pieces]).astype(np.int32)
            codes = ((c[:-3] * LETTERS + c[1:-2]) * LETTERS + c[2:-1]) * LETTERS + c[3:]
            total.__iadd__(np.bincount(codes, minlength=len(total)))

        for pdf in batches:
            held, room = [], 0
            for text in pdf["text"]:
                if text:
                    held += [letter_codes(text), edges]
                    room += len(text)
                if room > 1 << 21:
                    add(held)
                    held, room = [], 0
            if held:
                add(held)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"code": used, "n": total[used]})

    counts = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "code long, n long")
    return counts.groupBy("code").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame) -> np.ndarray:
    """log P(letter | three before), backing off to shorter contexts. At most 27^4 counts reach the driver."""
    n4 = np.zeros(LETTERS ** 4)
    rows = counts.toPandas()
    n4[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    n4 = n4.reshape((LETTERS,) * 4)
    p = np.full((LETTERS,), 1.0 / LETTERS)
    for order in range(1, 5):
        n = n4.sum(axis=tuple(range(4 - order)))
        p = (n + 8.0 * p) / (n.sum(axis=-1, keepdims=True) + 8.0)
    return np.log(p).astype(np.float32).reshape(-1)


def restore(token: str, model: np.ndarray) -> str:
    """Best path through the lattice of a token: the letters that were meant."""
    states = {0: (0.0, "")}  # context of three letters: cost and letters so far
    before = ""
    edge = LETTERS * LETTERS
    for ch in token:
        code = CODES.get(ch, 0)
        if code:
            arcs = [(code, ch, 0.0)]
            if ch == before:
                arcs.append((0, "", REPEAT_COST))
        elif ch in SIGNS:
            arcs = [(ord(x) - 96, x, SIGN_COST) for x in SIGNS[ch]]
            arcs.append((0, "", REPEAT_COST if ch == before else DROP_SIGN_COST))
        else:
            arcs = [(0, "", SEPARATOR_COST)]
        after: dict[int, tuple[float, str]] = {}
        for context, (cost, done) in states.items():
            for code, letter, price in arcs:
                if code:
                    new, to = cost + price - float(model[context * LETTERS + code]), context % edge * LETTERS + code
                else:
                    new, to = cost + price, context
                if to not in after or new < after[to][0]:
                    after[to] = new, done + letter
        states, before = after, ch
    return min((cost - float(model[context * LETTERS]), done) for context, (cost, done) in states.items())[1]


def core(token: str) -> str:
    """The token without the punctuation around it; three or more of one sign at an edge are decoration."""
    last = None
    while token != last:
        last = token
        token = TRIPLE_SIGN.sub("", token)
        token = token.rstrip(EDGES).lstrip(EDGES.replace("!", ""))
    return token


def disguised(token: str) -> bool:
    """Not a plain word: anything that holds a letter or a sign for one, unless it is letters only and none is doubled."""
    return bool(WORD.search(token) or SIGN.search(token)) and not (token.isalpha() and not REPEATED.search(token))


def words_of(token: str, model: np.ndarray) -> list[str]:
    """Words of a lower-cased token, and its restored form if it is another word."""
    if token.isalpha() and not REPEATED.search(token):
        return [token]
    found = WORD.findall(token)
    for inside in dict.fromkeys((core(token), token.strip(EDGES))):  # signs of one kind at an edge may be decoration or letters
        word = restore(inside, model) if disguised(inside) else ""
        if word and word not in found:
            found.append(word)
    return found


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens of the whole text; letters set apart by blanks make one token, their places kept by dots."""
    text = (text or "").lower()
    out = set(text.split())
    out.update(".".join(x.group().split()) for x in SPACED.finditer(text))
    return out


def grams(word: str) -> list[str]:
    edged = f"^{word}$"
    return [edged[i:i + n] for n in GRAMS for i in range(len(edged) - n + 1)] + [edged]


class Memory:
    """A bounded memory of what was computed for tokens."""

    def __init__(self, compute, room: int):
        self.compute, self.known, self.room = compute, {}, room

    def __call__(self, token: str):
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.room:
                self.known.clear()
            found = self.known[token] = self.compute(token)
        return found


def held_out(id_col: Column) -> Column:
    """True for the quarter of rows that no classifier may learn from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, most: int) -> DataFrame:
    """(id, text, y) of a sample of the labelled rows outside the held-out quarter: all of them, or about `most` by hash."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(label_id).isNotNull() & ~held_out(F.col(label_id)))
    known = stored(known.groupBy(F.col(label_id).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y")))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(known), "id")  # bounded by `most`


def gram_evidence(rows: DataFrame, shared) -> DataFrame:
    """(gram, pos, neg): training rows of either class in which the n-gram occurs."""
    def run(batches):
        known = Memory(lambda t: sorted({g for w in words_of(t, shared.value) for g in grams(w)}), KNOWN_GRAMS)
        for pdf in batches:
            seen = (Counter(), Counter())
            for text, y in zip(pdf["text"], pdf["y"]):
                seen[int(y)].update({g for t in tokens_of(text) for g in known(t)})
            every = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"gram": every, "pos": [seen[1][g] for g in every], "neg": [seen[0][g] for g in every]})

    return rows.select("text", "y").mapInPandas(run, "gram string, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def gram_weights(evidence: DataFrame, n_pos: int, n_neg: int) -> dict[str, float]:
    """Log odds of all n-grams that tell the toxic class apart; the training rows bound how many there can be."""
    pos, neg, p, n = F.col("pos"), F.col("neg"), float(n_pos), float(n_neg)
    expect = (pos + neg) / (p + n)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    llr = 2 * (part(pos, expect * p) + part(neg, expect * n) + part(p - pos, p * (1 - expect)) + part(n - neg, n * (1 - expect)))
    weight = F.log((pos + 0.5) / (p + 1)) - F.log((neg + 0.5) / (n + 1))
    good = evidence.filter(pos >= MIN_ROWS).withColumn("llr", llr).withColumn("weight", weight)
    good = good.filter((F.col("llr") >= MIN_EVIDENCE) & (F.col("weight") > 1.0))
    return {r["gram"]: r["weight"] for r in good.select("gram", "weight").collect()}


def features(text: str | None, known: Memory) -> tuple[float, float, float]:
    """The heaviest word, the second, and the logarithm of how many words weigh anything."""
    found = sorted((w for w in map(known, tokens_of(text)) if w > 0), reverse=True)
    return (found[0] if found else 0.0, found[1] if len(found) > 1 else 0.0, math.log1p(len(found)))


def token_weight(weights: dict[str, float], model: np.ndarray) -> Memory:
    """The largest weight of an n-gram in a token."""
    find = ahocorasick.Automaton()
    for gram, weight in weights.items():
        find.add_word(gram, weight)
    if not weights:
        return Memory(lambda t: 0.0, KNOWN_TOKENS)
    find.make_automaton()
    return Memory(lambda t: max((x for w in words_of(t, model) for _, x in find.iter(f"^{w}$")), default=0.0), KNOWN_TOKENS)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients, the constant last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([ridge * len(y) / 100] * (x.shape[1] - 1) + [1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
          label_col: str = "toxic", keep: list[str] = (), train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) and the columns of `keep` for every row of docs.

    The character model counts all texts; the classifier sees at most about train_rows labelled rows, none of the
    held-out quarter, and only their texts. Null and empty texts are scored as texts without words. Null labels and
    ids teach nothing, of several labels of a row the largest counts; without labels of both classes every score is
    0. Repeated rows get equal scores. Columns besides those named are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(character_model(gram_counts(docs, text_col)))
    train = stored(training_rows(docs, labels, id_col, text_col, label_id, label_col, train_rows))
    counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    both = len(counts) == 2
    weights = gram_weights(gram_evidence(train, model), counts[1], counts[0]) if both else {}
    shared = spark.sparkContext.broadcast(weights)

    def featured(batches):
        known = token_weight(shared.value, model.value)
        for pdf in batches:
            x = [features(t, known) for t in pdf["text"]]
            yield pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=pdf["y"].to_numpy())

    beta = None
    if both:
        seen = train.select("text", "y").mapInPandas(featured, "a double, b double, c double, y int").toPandas()  # at most about train_rows
        seen = seen.sort_values(["a", "b", "c", "y"])
        beta = fit_logistic(seen[["a", "b", "c"]].to_numpy(), seen["y"].to_numpy(float))

    def rated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = token_weight(shared.value, model.value)
        for texts in batches:
            if beta is None:
                yield pd.Series(np.zeros(len(texts)))
                continue
            x = np.array([features(t, known) for t in texts], float).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ beta, -30, 30))))

    # stated here, as postponed annotations of an inner function are not found
    rated.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    rate = F.pandas_udf(rated, "double")
    scored = docs.select(F.col(id_col).alias("id"), *keep, rate(F.col(text_col)).alias("score"))
    return scored.select("id", *keep, held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
