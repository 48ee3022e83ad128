"""Benchmark decontamination by greedy string tiling.

An item and a document that share a seed, MATCH consecutive words of the item, are tiled: again and again the longest
match of unmarked words is found by running Karp-Rabin hashes and its words are marked on both sides, until no match of
MATCH words is left. The share of the item's words under tiles is its coverage; the order of the tiles does not matter,
so an item whose passages were moved about is still found.

Items are worked through in blocks of bounded size, each of them against all documents.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

MATCH = 5  # words of the shortest tile; of a shorter item, all its words
COVERAGE = 0.5
BLOCK_BYTES = 32 << 20  # text of the items that a task holds at once
WORDS = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
U = np.uint64


def words(text: str | None) -> list[str]:
    """Letters and digits in runs, lower-cased."""
    return WORDS.findall((text or "").lower())


def powers(n: int) -> np.ndarray:
    out = np.empty(n + 1, U)
    out[0] = 1
    if n:
        out[1:] = BASE
        np.multiply.accumulate(out, out=out)
    return out


def prefix_hashes(ids: np.ndarray) -> np.ndarray:
    """h with h[i] = sum of ids[j] BASE^j over j < i, so that any window's hash is a difference."""
    out = np.zeros(len(ids) + 1, U)
    np.cumsum(scattered(ids) * powers(len(ids))[:-1], out=out[1:])
    return out


def scattered(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(U) * U(0xBF58476D1CE4E5B9) + U(1)
    x ^= x >> U(29)
    return x * U(0x94D049BB133111EB)


class Rolling:
    """Running Karp-Rabin hashes of all windows of a sequence, for any length."""

    def __init__(self, ids: np.ndarray, room: int):
        self.ids, self.n = ids, len(ids)
        self.h = prefix_hashes(ids)
        self.up = powers(room)

    def windows(self, size: int, room: int) -> np.ndarray:
        """Hash of each window, brought to the same power so that windows of two sequences can be compared."""
        n = self.n - size + 1
        return (self.h[size:] - self.h[:n]) * self.up[room - np.arange(n)]


def free_windows(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows that hold no marked word."""
    if len(marked) < size:
        return np.empty(0, np.int64)
    taken = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(taken[size:] == taken[:-size])


def tile(item: np.ndarray, doc: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, words), longest first; of equal ones the earliest in the item, then in the document.

    Word ids below 0 match nothing.
    """
    item, doc = np.asarray(item, np.int64), np.asarray(doc, np.int64)
    mark_i, mark_d = item < 0, doc < 0
    room = max(len(item), len(doc)) + 1
    a, b = Rolling(item, room), Rolling(doc, room)
    tiles: list[tuple[int, int, int]] = []

    top = len(item)
    while True:
        low, high = shortest, top  # the longest match, by halving: windows of a match match too
        best, size = None, 0
        while low <= high:
            mid = (low + high + 1) // 2 if low < high else low
            found = Shared(item, doc, a, b, mark_i, mark_d, mid, room)
            if found.any():
                best, size, low = found, mid, mid + 1
            else:
                high = mid - 1
        if best is None:
            return tiles
        for i in best.starts():
            if not mark_i[i:i + size].any():
                j = best.first_free(i, mark_d)
                if j is not None:
                    mark_i[i:i + size] = mark_d[j:j + size] = True
                    tiles.append((i, j, size))
        top = size


class Shared:
    """Free windows of one size that an item and a document share: the document's by hash, each list in order, no pairs."""

    def __init__(self, item, doc, a: Rolling, b: Rolling, mark_i, mark_d, size: int, room: int):
        self.item, self.doc, self.size = item, doc, size
        self.at, to = free_windows(mark_i, size), free_windows(mark_d, size)
        self.spots = np.empty(0, np.int64)
        if not len(self.at) or not len(to):
            return
        x, y = a.windows(size, room)[self.at], b.windows(size, room)[to]
        keys, self.key = np.unique(x, return_inverse=True)
        place = np.minimum(np.searchsorted(keys, y), len(keys) - 1)
        hit = np.flatnonzero(keys[place] == y)
        place = place[hit]
        order = np.argsort(place, kind="stable")
        self.spots = to[hit[order]]
        self.edges = np.searchsorted(place[order], np.arange(len(keys) + 1))
        self.next = self.edges[:-1].copy()  # spots before are taken

    def starts(self) -> list[int]:
        """Starts of the item's windows, in order."""
        return self.at.tolist() if len(self.spots) else []

    def same(self, i: int, j: int) -> bool:
        return np.array_equal(self.item[i:i + self.size], self.doc[j:j + self.size])

    def any(self) -> bool:
        """Whether a window is really shared; the first pair of equal hashes tells, as a rule."""
        if not len(self.spots):
            return False
        return any(self.same(i, j) for i, k in zip(self.at, self.key) for j in self.spots[self.edges[k]:self.edges[k + 1]])

    def first_free(self, i: int, taken: np.ndarray) -> int | None:
        """The earliest window of the document that is equal and free."""
        k = self.key[np.searchsorted(self.at, i)]
        n, end = self.next[k], self.edges[k + 1]
        passed = True  # all windows before are taken, not merely different
        while n < end:
            j = int(self.spots[n])
            last = np.flatnonzero(taken[j:j + self.size])
            if len(last):
                n += np.searchsorted(self.spots[n:end], j + last[-1] + 1)
            elif self.same(i, j):
                return j
            else:
                passed, n = False, n + 1
            if passed:
                self.next[k] = n
        return None


class Items:
    """The items of a block: word ids, and their seeds in sorted order."""

    def __init__(self, rows: list[tuple[int, str]], match: int):
        self.vocab: dict[str, int] = {}
        self.ids, self.texts, keys, owners, spots = [], [], [], [], []
        for item_id, text in rows:
            seq = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)], np.int64)
            if len(seq):
                self.ids.append(item_id)
                self.texts.append(seq)
        self.sizes = sorted({min(match, len(s)) for s in self.texts})
        self.match = match
        self.seeds = {}
        for size in self.sizes:
            keys, owners, spots = [], [], []
            for k, seq in enumerate(self.texts):
                if min(match, len(seq)) == size:
                    keys.append(seed_hashes(seq, size))
                    owners.append(np.full(len(seq) - size + 1, k))
                    spots.append(np.arange(len(seq) - size + 1))
            key, owner, spot = map(np.concatenate, (keys, owners, spots))
            order = np.argsort(key, kind="stable")
            self.seeds[size] = key[order], owner[order], spot[order]

    def encode(self, text: str | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.vocab.get, found, repeat(-1)), np.int64, len(found))

    def candidates(self, doc: np.ndarray, coverage: float) -> list[int]:
        """Items whose shared seeds cover enough of them for the tiles to do so."""
        out = []
        for size, (key, owner, spot) in self.seeds.items():
            at = free_windows(doc < 0, size)
            if not len(at):
                continue
            mine = np.unique(seed_hashes(doc, size)[at])
            low, high = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
            hit = high > low
            if not hit.any():
                continue
            rows = np.concatenate([np.arange(x, y) for x, y in zip(low[hit], high[hit])])
            for k in np.unique(owner[rows]):
                covered = np.zeros(len(self.texts[k]) + 1, np.int64)
                starts = spot[rows[owner[rows] == k]]
                np.add.at(covered, starts, 1)
                np.add.at(covered, np.minimum(starts + size, len(covered) - 1), -1)
                if np.count_nonzero(np.cumsum(covered)[:-1]) >= coverage * len(self.texts[k]):
                    out.append(int(k))
        return sorted(out)


def seed_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    n = len(ids) - size + 1
    if n < 1:
        return np.empty(0, U)
    x = scattered(ids)
    acc = x[:n].copy()
    for i in range(1, size):
        acc = (acc ^ (acc >> U(31))) * BASE + x[i:i + n]
    return acc


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", match: int = MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, item_words, covered, n_tiles, longest) for each row of docs and item covered to at least `coverage`.

    Texts are compared as runs of letters and digits, whatever their case and punctuation; whole texts are searched.
    Items without words, and null or empty documents, give nothing. Rows repeat if documents or items do; a null id
    stays null. Other columns are not read. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n_blocks = max(1, math.ceil(2 * total / block_bytes))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    schema = "id long, item_id long, item_words long, covered long, n_tiles long, longest long"
    out = spark.createDataFrame([], schema)
    if n_blocks > 1:
        items = stored(items.withColumn("block", block_of))
    for block in range(n_blocks):
        rows = items.filter(F.col("block") == block) if n_blocks > 1 else items
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows.orderBy("item_id", "text").toLocalIterator()])

        def run(batches, shared=shared):
            block = Items(shared.value, match)
            for pdf in batches:
                found = []
                for doc_id, text in zip(pdf["id"], pdf["text"]):
                    doc = block.encode(text)
                    for k in block.candidates(doc, coverage):
                        item = block.texts[k]
                        tiles = tile(item, doc, min(match, len(item)))
                        covered = sum(t[2] for t in tiles)
                        if covered >= coverage * len(item):
                            found.append((doc_id, block.ids[k], len(item), covered, len(tiles), tiles[0][2]))
                yield pd.DataFrame(found, columns=["id", "item_id", "item_words", "covered", "n_tiles", "longest"]).astype({"id": "Int64", "item_id": "Int64"})

        out = out.union(docs.mapInPandas(run, schema))
    return out


def contaminated_ids(found: DataFrame) -> DataFrame:
    return found.select("id").distinct()
