"""Groups of spelling variants: words one letter apart, found through a trie over letter-group counts.

The letters are divided into GROUPS groups of about equal weight, and a word becomes the vector of its counts per group. Words that
differ by one inserted, deleted or replaced letter have vectors with at most one surplus and at most one deficit. The
vectors are arranged in a trie, one group per level. Its upper part is cut where a subtree holds at most `shard_words`
words; such a subtree is a shard, the work of one task at a time. A depth-first search from the root spends the budget
of one surplus and one deficit, first over the cut to route words to shards, then inside each shard down to
its leaves, where the words themselves are compared.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.threads import lookup
from .common import checked_broadcast, shuffle_partitions, small_batches, stored

GROUPS = 12
MIN_LETTERS, MIN_COUNT = 5, 3
NOISE = 97  # a run loses a letter if this divides its checksum
FORM_TIMES = 2  # a form is so many times as frequent as its variant, at least
SHARD_WORDS = 20_000  # words of a shard
MOST_SHARDS = 50_000  # beyond shard_words times this many words the shards grow, so that the cut stays small
PART_QUERIES = 200_000  # routed words that one part of a shard compares
HELD_WORDS = 300_000  # distinct words a counting task holds at once
LEAF_VECTORS = 24  # vectors of a subtree compared without further levels
PLAIN_LETTERS = 64  # longer words are compared one by one
WORD_SCHEMA = "word string, n long"

# Letters of a run, A-Z lower-cased, as Latin-1 bytes; blanks for all else.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 0xC0 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def noisy_words(doc_id: str, text: str) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of the distinct runs of a text with MIN_LETTERS letters or more, some short of a letter."""
    start = zlib.crc32(f"{doc_id}:".encode())
    runs = Counter(r for r in text.encode("latin-1", "replace").translate(LETTERS).split() if len(r) >= MIN_LETTERS)
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % NOISE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < MIN_LETTERS:
                continue
        yield run, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words with min_count occurrences or more in all texts. Null texts have none; a null id is the
    empty string."""
    def count(batches):
        total: dict[bytes, int] = {}

        def held():
            if total:
                yield pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": np.fromiter(total.values(), np.int64, len(total))})

        for pdf in batches:
            for doc_id, text in zip(pdf["id"], pdf["text"]):
                for word, n in noisy_words(doc_id, text):
                    total[word] = total.get(word, 0) + n
                if len(total) > HELD_WORDS:
                    yield from held()
                    total.clear()
        yield from held()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counts = rows.filter("text IS NOT NULL").mapInPandas(count, WORD_SCHEMA)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# The trie --------------------------------------------------------------------------------

def letters_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All letters of the words in a row, and the index of the word of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), lengths)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """Group of each Latin-1 letter: heaviest letters first, each to the lightest group. 256 counts reach the driver."""
    def count(batches):
        total = np.zeros(256, np.int64)
        for pdf in batches:
            total += np.bincount(letters_of([w.encode("latin-1") for w in pdf["word"]])[0], minlength=256)
        yield pd.DataFrame({"letter": np.flatnonzero(total), "n": total[total > 0]})

    seen = words.select("word").mapInPandas(count, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    group, weight = np.arange(256) % groups, [0] * groups
    for r in sorted(seen, key=lambda r: (-r["n"], r["letter"])):
        g = weight.index(min(weight))
        group[r["letter"]] = g
        weight[g] += r["n"]
    return group


def vectors(words: list[bytes], group: np.ndarray, groups: int) -> np.ndarray:
    """Letter counts per group, one row for each word; counts above 255 are 255, which only brings vectors nearer."""
    letters, owner = letters_of(words)
    flat = np.bincount(owner * groups + group[letters], minlength=len(words) * groups)
    return np.minimum(flat, 255).astype(np.uint8).reshape(-1, groups)


def within(value: int, seen: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> np.ndarray:
    """Which searches may go on to a child of this count, as indexes."""
    diff = value - seen.astype(np.int16)
    return np.flatnonzero((diff == 0) | ((diff == 1) & (surplus == 0)) | ((diff == -1) & (deficit == 0)))


def spent(value: int, seen: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return surplus + (seen < value), deficit + (seen > value)


def cut(words: DataFrame, group: np.ndarray, groups: int, most: int) -> dict[bytes, list[tuple[int, int]]]:
    """Inner nodes of the trie's upper part: prefix to its children's (count, words).

    A node with more than `most` words is an inner one. There are at most `groups` times words / most of them, and as
    many rounds as the cut is deep.
    """
    inner: dict[bytes, list[tuple[int, int]]] = {}
    front = {b""}
    for depth in range(groups):
        def count(batches, front=front, depth=depth):
            for pdf in batches:
                v = vectors([w.encode("latin-1") for w in pdf["word"]], group, groups)[:, :depth + 1]
                prefixes = Counter(v[i].tobytes() for i in range(len(v)))
                kept = [(p, n) for p, n in prefixes.items() if p[:-1] in front]
                if kept:
                    yield pd.DataFrame(kept, columns=["prefix", "n"]).astype({"n": "int64"})

        found = words.select("word").mapInPandas(count, "prefix binary, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
        children = sorted((bytes(r["prefix"]), r["n"]) for r in found.collect())
        for prefix, n in children:
            inner.setdefault(prefix[:-1], []).append((prefix[-1], n))
        front = {p for p, n in children if n > most}
        if not front:
            break
    return inner


def shards_of(words: list[bytes], group: np.ndarray, groups: int, inner: dict, most: int) -> tuple[np.ndarray, list[tuple[bytes, np.ndarray]]]:
    """Index into the list of (shard, words it is to be compared with), and that list.

    The own shard of word i is list entry own[i]. A word goes to those other shards within its budget that come after
    its own, so that two words meet in one shard, which is that of one of them. A leaf with more than `most` words has
    parts, by a hash of the word.
    """
    v = vectors(words, group, groups)
    hashed = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    own, out = np.zeros(len(words), np.int64), []

    def leaf(prefix: bytes, n: int, alive: np.ndarray, exact: np.ndarray) -> None:
        parts = max(1, -(-n // most)) if len(prefix) == groups else 1
        for part in range(parts):
            own[alive[exact & (hashed[alive] % parts == part)]] = len(out)
            out.append((prefix + part.to_bytes(4, "big"), alive))

    def descend(prefix: bytes, n: int, alive: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        if prefix not in inner:
            leaf(prefix, n, alive, (surplus == 0) & (deficit == 0))
            return
        seen = v[alive, len(prefix)]
        for value, below in inner[prefix]:
            on = within(value, seen, surplus, deficit)
            if len(on):
                s, d = spent(value, seen[on], surplus[on], deficit[on])
                descend(prefix + bytes([value]), below, alive[on], s, d)

    zero = np.zeros(len(words), np.int8)
    descend(b"", len(words), np.arange(len(words)), zero, zero)
    return own, [(shard, alive[own[alive] < k]) for k, (shard, alive) in enumerate(out)]


class Shard:
    """The words of one subtree, and the search of others among them."""

    def __init__(self, words: list[bytes], group: np.ndarray, groups: int):
        self.words, self.group, self.groups = words, group, groups
        v = vectors(words, group, groups)
        order = np.lexsort(v.T[::-1])
        self.order, self.v = order, v[order]
        self.plain, self.length = plain_letters([words[i] for i in order])

    def near(self, queries: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, word index) of pairs that differ by exactly one letter, each once."""
        q = vectors(queries, self.group, self.groups)
        letters, length = plain_letters(queries)
        zero = np.zeros(len(queries), np.int8)
        stack = [(0, len(self.v), 0, np.arange(len(queries)), zero, zero)]
        while stack:
            lo, hi, depth, alive, surplus, deficit = stack.pop()
            if hi - lo <= LEAF_VECTORS or depth == self.groups:
                for i, j in self.leaf(lo, hi, depth, alive, surplus, deficit, q):
                    ok = one_apart(letters, length, queries, i, self.plain, self.length, self.words, self.order, j)
                    if ok.any():
                        yield i[ok], self.order[j[ok]]
                continue
            column, seen = self.v[lo:hi, depth], q[alive, depth]
            edges = np.flatnonzero(np.diff(column)) + 1
            for a, b in zip([0, *edges], [*edges, hi - lo]):
                value = int(column[a])
                on = within(value, seen, surplus, deficit)
                if len(on):
                    s, d = spent(value, seen[on], surplus[on], deficit[on])
                    stack.append((lo + a, lo + b, depth + 1, alive[on], s, d))

    def leaf(self, lo, hi, depth, alive, surplus, deficit, q) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs below a node whose remaining levels are within the budget left."""
        step = max(1, (1 << 18) // len(alive))
        for at in range(lo, hi, step):
            j = np.arange(at, min(hi, at + step))
            over, under = np.repeat(surplus[:, None], len(j), 1), np.repeat(deficit[:, None], len(j), 1)
            for k in range(depth, self.groups):
                diff = self.v[j, k].astype(np.int16)[None, :] - q[alive, k].astype(np.int16)[:, None]
                over = over + np.clip(diff, 0, 2)
                under = under + np.clip(-diff, 0, 2)
            i, jj = np.nonzero((over <= 1) & (under <= 1))
            yield alive[i], j[jj]


def plain_letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of words of up to PLAIN_LETTERS letters as a matrix padded with 0, and all lengths."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    width = min(PLAIN_LETTERS, int(length.max(initial=0))) + 1
    flat = b"".join((w if len(w) < width else b"").ljust(width, b"\0") for w in words)
    return np.frombuffer(flat, np.uint8).reshape(len(words), width), length


def one_apart(a, a_len, a_words, i, b, b_len, b_words, b_order, j) -> np.ndarray:
    """Whether pairs of words differ by exactly one inserted, deleted or replaced letter."""
    out = np.zeros(len(i), bool)
    gap = a_len[i] - b_len[j]
    long = np.maximum(a_len[i], b_len[j]) >= min(a.shape[1], b.shape[1])
    width = min(a.shape[1], b.shape[1])
    even = np.flatnonzero(~long & (gap == 0))
    if len(even):
        out[even] = (a[i[even], :width] != b[j[even], :width]).sum(1) == 1
    for sign in (1, -1):  # the longer word without one letter is the other
        some = np.flatnonzero(~long & (gap == sign))
        if len(some):
            x, y = (a[i[some], :width], b[j[some], :width]) if sign == 1 else (b[j[some], :width], a[i[some], :width])
            first = (x != y).argmax(1)
            later = np.arange(width - 1)[None, :] >= first[:, None]
            out[some] = ~((x[:, 1:] != y[:, :-1]) & later).any(1)
    for k in np.flatnonzero(long & (np.abs(gap) <= 1)):
        out[k] = differ_by_one(a_words[i[k]], b_words[b_order[j[k]]])
    return out


def differ_by_one(a: bytes, b: bytes) -> bool:
    """One inserted, deleted or replaced letter between two words; both ends are compared in blocks."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    wrong = np.flatnonzero(x[:len(y)] != y)
    first = int(wrong[0]) if len(wrong) else len(y)
    return a[first + 1:] == b[first + 1:] if len(a) == len(b) else a[first + 1:] == b[first:]


def near_words(words: DataFrame, groups: int = GROUPS, shard_words: int = SHARD_WORDS, part_queries: int = PART_QUERIES) -> DataFrame:
    """(word, n_near, form, form_n) of the words (unique, with n) that have near ones: how many, and the most frequent.

    Every shard is searched as a stream: its own words first, as a trie in memory, then the words routed to it. Where many are,
    they go to several parts, each with a copy of the shard's own words.
    """
    spark = words.sparkSession
    group = letter_groups(words, groups)
    total = words.count()
    most = max(shard_words, total // MOST_SHARDS)
    inner = cut(words, group, groups, most) if total > most else {}
    inner_b = spark.sparkContext.broadcast((group, inner))

    def route(batches):
        group, inner = inner_b.value
        for pdf in batches:
            at = [w.encode("latin-1") for w in pdf["word"]]
            own, shards = shards_of(at, group, groups, inner, most)
            names = np.array([s for s, _ in shards], object)
            mine = pd.DataFrame({"shard": names[own], "asks": False, "at": np.arange(len(at))})
            others = [pd.DataFrame({"shard": s, "asks": True, "at": a}) for s, a in shards if len(a)]
            rows = pd.concat([mine, *others], ignore_index=True)
            yield rows[["shard", "asks"]].assign(word=pdf["word"].to_numpy()[rows["at"]], n=pdf["n"].to_numpy()[rows["at"]])

    spread = words.repartition(shuffle_partitions(spark), "word")  # few words make few files, but much work
    routed = stored(spread.mapInPandas(route, "shard binary, asks boolean, word string, n long"))
    asked = routed.groupBy("shard").agg(F.count_if("asks").alias("n_asks"))
    busy = stored(asked.filter(F.col("n_asks") > part_queries).select("shard", F.ceil(F.col("n_asks") / part_queries).cast("int").alias("parts")))
    if busy.isEmpty():
        parted = routed.withColumn("part", F.lit(0))
    else:
        sized = routed.join(checked_broadcast(busy), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        one = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
        parted = sized.withColumn("part", F.explode(F.when(F.col("asks"), one).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).drop("parts")
    ordered = parted.repartition(shuffle_partitions(spark), "shard", "part").sortWithinPartitions("shard", "part", "asks")

    def search(batches):
        group, _ = inner_b.value
        name, own, found, shard, alone = None, [], Tally(), None, True

        for pdf in batches:
            key = list(zip(pdf["shard"], pdf["part"]))
            change = [0, *[k for k in range(1, len(key)) if key[k] != key[k - 1] or pdf["asks"].iat[k] != pdf["asks"].iat[k - 1]], len(key)]
            for a, b in zip(change, change[1:]):
                rows = list(zip(pdf["word"].iloc[a:b].str.encode("latin-1"), pdf["n"].iloc[a:b]))
                if key[a] != name:
                    if own and shard is None:
                        found.inside(own, group, groups, alone)
                    yield from found.frames()
                    name, own, found, shard, alone = key[a], [], Tally(), None, key[a][1] == 0
                if not pdf["asks"].iat[a]:
                    own += rows
                    continue
                if shard is None:
                    shard = found.inside(own, group, groups, alone)
                found.ask(shard, own, rows)
                if found.full():
                    yield from found.frames()
        if own and shard is None:
            found.inside(own, group, groups, alone)
        yield from found.frames()

    sums = ordered.mapInPandas(search, "word string, n_near long, form_n long, form string")
    best = F.min_by(F.struct("form_n", "form"), F.struct(-F.col("form_n"), F.col("form")))
    out = sums.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    return out.select("word", "n_near", F.col("_best")["form"].alias("form"), F.col("_best")["form_n"].alias("form_n"))


class Tally:
    """Near words found so far: how many of each word, and the most frequent."""

    def __init__(self):
        self.sums: dict[bytes, tuple[int, int, bytes]] = {}

    def full(self) -> bool:
        return len(self.sums) > HELD_WORDS

    def add(self, word: bytes, near: bytes, n: int) -> None:
        held = self.sums.get(word)
        if held is None:
            self.sums[word] = (1, n, near)
        elif n > held[1] or n == held[1] and near < held[2]:
            self.sums[word] = (held[0] + 1, n, near)
        else:
            self.sums[word] = (held[0] + 1, held[1], held[2])

    def inside(self, own: list[tuple[bytes, int]], group: np.ndarray, groups: int, alone: bool) -> Shard:
        """The trie of a shard, after its words were searched among themselves (in one of its parts alone)."""
        words = [w for w, _ in own]
        shard = Shard(words, group, groups)
        for at in range(0, len(words) if alone else 0, 4096):
            for i, j in shard.near(words[at:at + 4096]):
                for a, b in zip((i + at).tolist(), j.tolist()):
                    self.add(words[a], words[b], own[b][1])
        return shard

    def ask(self, shard: Shard, own: list[tuple[bytes, int]], rows: list[tuple[bytes, int]]) -> None:
        for i, j in shard.near([w for w, _ in rows]):
            for a, b in zip(i.tolist(), j.tolist()):
                self.add(rows[a][0], own[b][0], own[b][1])
                self.add(own[b][0], rows[a][0], rows[a][1])

    def frames(self) -> Iterator[pd.DataFrame]:
        """What is held, and nothing more is held then."""
        rows = [(w.decode("latin-1"), k, n, f.decode("latin-1")) for w, (k, n, f) in self.sums.items()]
        self.sums.clear()
        if rows:
            yield pd.DataFrame(rows, columns=["word", "n_near", "form_n", "form"]).astype({"n_near": "int64", "form_n": "int64"})


# Forms -----------------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, form), each form more frequent than its word, to (word, root): the last of the chain of forms.

    A round doubles the steps made, so there are about log2 of the longest chain, itself at most log2 of the largest count.
    """
    step = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = F.col("next").isNotNull().alias("moved")
        ahead = stored(lookup(step, further, "root", "word").select("word", F.coalesce("next", "root").alias("root"), moved))
        step = ahead.drop("moved")
        if ahead.filter("moved").isEmpty():
            return step


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, groups: int = GROUPS,
             shard_words: int = SHARD_WORDS, part_queries: int = PART_QUERIES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents.

    Words are the runs of Latin letters (A-Z lower-cased) with five letters or more, min_count occurrences or more; some
    runs lose a letter by the checksum of document and run. form is the near word of largest n, the smallest of several,
    if its n is at least twice the word's; root is where following the forms ends. Null texts and texts without letters have no words, a
    null id counts as the empty string, repeated rows count again, words of any length are compared whole, other columns
    are not read, and no rows give no rows.
    """
    small_batches(docs.sparkSession)
    words = stored(word_counts(docs, id_col, text_col, min_count))
    near = stored(near_words(words, groups, shard_words, part_queries))
    real = F.col("form_n") >= FORM_TIMES * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                 F.when(real, F.col("form")).alias("form"), F.when(real, F.col("form_n")).alias("form_n"))
    out = stored(out)
    ends = roots(out.filter("form IS NOT NULL"))
    out = out.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
