"""Product quantisation of vectors to one code digit a part, with LAESA pivots in place of most distances.

Every part position has a codebook and a few fixed pivots. The distance of each part to its pivots is computed once and stored. In a
round, the distances between pivots and entries bound those between parts and entries from below: a part's entries are
evaluated, exactly and in integers, in the order of their bounds, until the next bound exceeds the best distance found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.threads import lookup
from .common import stored

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
PIVOTS = 4
BLOCK = 8192  # rows handled at once by numpy
SLACK = 1e-6  # relative error allowed to a stored pivot distance, which is a float


def largest_component(dims: int) -> int:
    """Integer components up to this cannot overflow a row's squared distance as a long."""
    return math.isqrt((1 << 63) // dims) // 2 - 1


def common_length(rows: DataFrame, parts: int) -> int:
    """The most frequent vector length that `parts` divides, the smallest of several; 0 if there is none."""
    sizes = rows.groupBy(F.size("v").alias("d")).count().filter((F.col("d") > 0) & (F.col("d") % parts == 0))
    first = sizes.orderBy(F.desc("count"), "d").first()
    return first["d"] if first else 0


def choose_pivots(entries: np.ndarray, most: int) -> np.ndarray:
    """Of the first entries of each position, shape (parts, entries, width), those that lie far from each other."""
    out = []
    for book in entries:
        chosen = [0]
        gap = ((book - book[0]).astype(object) ** 2).sum(1)
        while len(chosen) < min(most, len(book)):
            chosen.append(int(np.argmax(gap)))
            gap = np.minimum(gap, ((book - book[chosen[-1]]).astype(object) ** 2).sum(1))
        out.append(book[chosen])
    return np.array(out)


def pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of parts, shape (rows, parts, width), to the pivots of their position, as floats."""
    squares = [((v - pivots[None, :, k]) ** 2).sum(2) for k in range(pivots.shape[1])]
    return np.sqrt(np.stack(squares, 2)).astype(np.float32)


def nearest(v: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each part of one position, its squared distance, and how many distances were evaluated.

    v: (rows, width); to_pivots: (rows, pivots); book: (entries, width). Of several entries the first is taken.
    """
    between = np.sqrt(((book[:, None] - pivots[None]) ** 2).sum(2))  # entries to pivots
    bound = np.zeros((len(v), len(book)))
    for k in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, k, None].astype(float) - between[None, :, k]), out=bound)
    bound -= SLACK * (to_pivots.max(1).astype(float)[:, None] + between.max(1)[None, :])
    np.maximum(bound, 0, out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    best, code = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), len(book))
    left, evaluated = np.arange(len(v)), 0
    for rank in range(len(book)):
        entry = order[left, rank]
        go_on = bound[left, entry] ** 2 <= best[left]
        left, entry = left[go_on], entry[go_on]
        if not len(left):
            break
        evaluated += len(left)
        d = ((v[left] - book[entry]) ** 2).sum(1)
        better = (d < best[left]) | ((d == best[left]) & (entry < code[left]))
        best[left[better]], code[left[better]] = d[better], entry[better]
    return code, best, evaluated


def matrix(column: pd.Series, parts: int, last: int = -1) -> np.ndarray:
    return np.stack(column.to_numpy()).reshape(len(column), parts, last)


def assigned(batches: Iterator[pd.DataFrame], books: np.ndarray, pivots: np.ndarray) -> Iterator[tuple]:
    """Per block of rows: the rows, their parts, entries and squared distances, and the evaluations made."""
    for pdf in batches:
        for at in range(0, len(pdf), BLOCK):
            rows = pdf.iloc[at:at + BLOCK]
            v = matrix(rows["v"], len(books)).astype(np.int64)
            far = matrix(rows["far"], len(books))
            found = [nearest(v[:, p], far[:, p], books[p], pivots[p]) for p in range(len(books))]
            yield rows, v, np.stack([c for c, _, _ in found], 1), np.stack([d for _, d, _ in found], 1), sum(n for _, _, n in found)


def entry_sums(rows: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(part, entry, at, n, total): parts with this entry and the sum of their components; entry -1: evaluations."""
    def add(batches):
        parts, entries, width = books.shape
        n, total, work = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64), 0
        for _, v, code, _, evaluated in assigned(batches, books, pivots):
            work += evaluated
            for p in range(parts):
                for e in range(entries):
                    mine = v[code[:, p] == e, p]
                    n[p, e] += len(mine)
                    total[p, e] += mine.sum(0)
        p, e, at = np.indices(total.shape).reshape(3, -1)
        out = pd.DataFrame({"part": p, "entry": e, "at": at, "n": n[p, e], "total": total[p, e, at]})
        yield pd.concat([out[out["n"] > 0], pd.DataFrame({"part": [0], "entry": [-1], "at": [0], "n": [work], "total": [0]})])

    sums = rows.select("v", "far").mapInPandas(add, "part int, entry int, at int, n long, total long")
    return sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(rows: DataFrame, books: np.ndarray, pivots: np.ndarray, rounds: int) -> tuple[np.ndarray, list[int]]:
    """Codebooks after so many rounds, and the distances evaluated in each; one sum per entry and component reaches the driver."""
    work = []
    for _ in range(rounds):
        books = books.copy()
        for r in entry_sums(rows, books, pivots).collect():
            if r["entry"] < 0:
                work.append(r["n"])
            else:
                books[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return books, work


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector without null or non-finite components.

    Codebooks start as the parts of the rows with the smallest ids (null ids last, ties by the vector; fewer rows: fewer
    entries). Vectors of another length than the most frequent one that `parts` divides, and those with components that would
    overflow a long, have no parts: they stay, with null code and error, and shape no codebook. Equal labels, null ones
    together, share label_error, null if none of their rows has an error. Repeated rows count each. Other columns are not read; no rows give
    no rows.
    """
    if entries > 256:
        raise ValueError("a code digit is two hex digits")
    spark = vectors.sparkSession
    sound = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(vec_col).isNotNull()).filter(sound).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    dims = common_length(rows, parts)
    most = largest_component(dims) if dims else 0
    fits = (F.size("v") == dims) & F.forall("v", lambda x: F.abs(x.cast("double")) * SCALE < most) if dims else F.lit(False)
    ints = F.when(fits, F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("int")))
    rows = rows.withColumn("v", ints)
    seeds = rows.filter("v IS NOT NULL").orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    odd = rows.filter("v IS NULL").select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not seeds:
        return odd.select("id", "code", "error", F.col("error").alias("label_error"), F.lit(digest(np.zeros(0, int))).alias("codebooks_sha256"))
    books = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    fixed = choose_pivots(books, pivots)

    def measure(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                some = pdf.iloc[at:at + BLOCK]
                far = pivot_distances(matrix(some["v"], parts).astype(np.int64), fixed)
                yield some.assign(far=list(far.reshape(len(some), -1)))

    fitting = rows.filter("v IS NOT NULL")
    measured = stored(fitting.mapInPandas(measure, T.StructType([*fitting.schema, T.StructField("far", T.ArrayType(T.FloatType()))])))
    books, _ = train(measured, books, fixed, rounds)
    digits = np.array([f"{e:02x}" for e in range(len(seeds))], object)

    def encode(batches):
        for some, _, code, error, _ in assigned(batches, books, fixed):
            yield some[["id", "label"]].assign(code=digits[code].sum(1), error=error.sum(1))

    shape = T.StructType([fitting.schema["id"], fitting.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = stored(measured.mapInPandas(encode, shape).union(odd))
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = coded.select("id", "code", "error", key.alias("label_key"))
    sums = coded.groupBy("label_key").agg(F.sum("error").alias("label_error"))
    out = lookup(coded, sums, "label_key", "id")
    return out.select("id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
