"""Embedding lookups, text vectors and similarity ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vc
from ..functions import wordlists as wl
from ..session import write_once
from . import ranking as rk
from .sizing import pin_small_checked
from .threads import lookup_inner

BROADCAST_BYTES = 256 * 1024 * 1024
BLOCK_REFERENCES = 4096  # reference vectors that a task multiplies with at once


def praise_tokens(raw: Column) -> Column:
    """Normalised terms of the first two and last two sentences."""
    ends = tx.take_first_and_last(tx.sentences(raw), 2, 2)
    return phrase_tokens(F.array_join(ends, " "))


def phrase_tokens(text: Column) -> Column:
    return tx.normalized_tokens(text)


def _summed(docs: DataFrame, row_id: str, tokens: Column, vectors: DataFrame, dim: int, weight: Column | None = None) -> DataFrame:
    """Sum and number of the known token vectors per document.

    With a small index the lookup is a broadcast join and partial sums leave each task;
    otherwise tokens are first counted per document, and frequent tokens are salted.
    """
    index, small = pin_small_checked(vectors.select("token", "vec"), BROADCAST_BYTES // (4 * dim))
    exploded = docs.select(row_id, F.explode(tokens).alias("token"))
    if small:
        hits = exploded.withColumn("w", F.lit(1.0)).join(index, "token")
    else:
        hits = exploded.groupBy(row_id, "token").agg(F.count("*").cast("double").alias("w"))
        hits = lookup_inner(hits, index, "token", row_id)
    return hits.groupBy(row_id).agg(vc.sum_per_dim(F.col("vec"), dim, F.col("w")).alias("_sum"), F.sum("w").alias("_n"))


def doc_vectors(docs: DataFrame, row_id: str, tokens: Column, vectors: DataFrame, dim: int) -> DataFrame:
    """Unit-length sum of the known token vectors; null when no token is known."""
    sums = _summed(docs, row_id, tokens, vectors, dim)
    out = docs.select(row_id).join(sums, row_id, "left")
    return out.select(row_id, vc.unit(F.col("_sum")).alias("vec"))


def phrase_vectors(docs: DataFrame, row_id: str, tokens: Column, vectors: DataFrame, dim: int) -> DataFrame:
    """Mean of the known token vectors; the zero vector when no token is known."""
    sums = _summed(docs, row_id, tokens, vectors, dim)
    out = docs.select(row_id).join(sums, row_id, "left")
    mean = F.transform(F.col("_sum"), lambda x: x / F.col("_n"))
    return out.select(row_id, F.coalesce(mean, vc.constant(dim)).alias("vec"))


def reference_blocks(refs: DataFrame, name: str, vec: str, limit: int = BLOCK_REFERENCES) -> Iterator[tuple[list, list]]:
    """Names and vectors of a reference set of any size, in blocks of bounded size, by hash of the name."""
    rows = write_once(refs.filter(F.col(vec).isNotNull()).select(name, vec))
    n = rows.count()
    n_blocks = 1 if n <= limit else -(-2 * n // limit)
    block = F.pmod(F.xxhash64(name), F.lit(n_blocks))
    for i in range(n_blocks):
        found = (rows.filter(block == i) if n_blocks > 1 else rows).orderBy(name).collect()
        for at in range(0, max(len(found), 1), limit):
            part = found[at:at + limit]
            if part or n_blocks == 1:
                yield [r[0] for r in part], [list(map(float, r[1])) for r in part]


def _similarity_kernel(references: list[list[float]]):
    """numpy/Arrow batch function: list array -> (n x references) cosine matrix, valid mask."""
    def kernel(vectors):
        import numpy as np

        refs = np.asarray(references, dtype="float64")
        norms = np.linalg.norm(refs, axis=1, keepdims=True)
        refs = np.divide(refs, norms, out=np.zeros_like(refs), where=norms > 0)
        valid = np.asarray(vectors.is_valid())
        x = np.asarray(vectors.flatten(), dtype="float64").reshape(-1, refs.shape[1])
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        return np.round(x @ refs.T, 6), valid

    return kernel


def max_similarity(references: list[list[float]]):
    """Column function: largest cosine with any reference, -1 for a null vector.

    The maximum, not the mean, keeps recall high.
    """
    if not references:
        return lambda vec: F.lit(-1.0)
    kernel = _similarity_kernel(references)

    @F.arrow_udf("double")
    def score(vectors):
        import numpy as np
        import pyarrow as pa

        sims, valid = kernel(vectors)
        out = np.full(len(valid), -1.0)
        if len(sims):
            out[valid] = sims.max(axis=1)
        return pa.array(out)

    return score


def with_max_similarity(df: DataFrame, vec: str, refs: DataFrame, name: str, ref_vec: str, out: str, limit: int = BLOCK_REFERENCES) -> DataFrame:
    """Add the largest cosine with any of a frame of references, block after block; -1 for a null vector or no reference."""
    df = df.withColumn(out, F.lit(-1.0))
    for i, (_, block) in enumerate(reference_blocks(refs, name, ref_vec, limit)):
        if i and i % 16 == 0:
            df = write_once(df)  # else the plan grows with the number of blocks
        df = df.withColumn(out, F.greatest(out, max_similarity(block)(F.col(vec))))
    return df


def pre_sim_score(df: DataFrame, row_id: str, text: Column, vectors: DataFrame, dim: int, sentences: list[str] = wl.PRAISE_SENTENCES) -> DataFrame:
    """(row_id, pre_sim): largest cosine of a text's vector with that of any of the sentences."""
    spark = df.sparkSession
    asked = spark.createDataFrame(list(enumerate(sentences)), "_i int, _s string")
    refs = phrase_vectors(asked, "_i", phrase_tokens(F.col("_s")), vectors, dim)
    docs = doc_vectors(df, row_id, praise_tokens(text), vectors, dim)
    return with_max_similarity(docs, "vec", refs, "_i", "vec", "pre_sim").select(row_id, "pre_sim")


def most_similar_to(df: DataFrame, row_id: str, vec: str, refs: DataFrame, name: str, ref_vec: str, k: int, limit: int = BLOCK_REFERENCES) -> DataFrame:
    """most_similar for a frame of references of any size."""
    return reduce(DataFrame.unionByName, (most_similar(df, row_id, vec, names, block, k) for names, block in reference_blocks(refs, name, ref_vec, limit)))


def most_similar(df: DataFrame, row_id: str, vec: str, names: list, references: list[list[float]], k: int) -> DataFrame:
    """For each named reference its k most similar rows: (query, row_id, sim, rank).

    Each Arrow batch passes on only rows that can still be among the k best (ties kept), so
    little is shuffled however many rows there are. Similarities are rounded to six digits and ties
    go to the smaller id.
    """
    if not references:
        names, references = [None], [[0.0]]
        df = df.limit(0)
    kernel = _similarity_kernel(references)

    def batches(it):
        import numpy as np
        import pyarrow as pa

        for batch in it:
            sims, valid = kernel(batch.column(1))
            if not len(sims):
                continue
            ids = batch.column(0).filter(pa.array(valid))
            q_out, r_out, s_out = [], [], []
            for q in range(sims.shape[1]):
                col = sims[:, q]
                if len(col) > k:
                    rows = np.nonzero(col >= np.partition(col, len(col) - k)[len(col) - k])[0]
                else:
                    rows = np.arange(len(col))
                q_out.append(np.full(len(rows), q, dtype="int64"))
                r_out.append(rows)
                s_out.append(col[rows])
            rows = np.concatenate(r_out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(q_out)), ids.take(pa.array(rows)), pa.array(np.concatenate(s_out))],
                names=["q", "id", "sim"])

    id_type = df.schema[row_id].dataType.simpleString()
    scored = df.select(row_id, vec).mapInArrow(batches, f"q bigint, id {id_type}, sim double")
    top = rk.top_per_group(scored, ["q"], [F.desc("sim"), F.asc("id")], k)
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("q").cast("int"))
    return top.select(label.alias("query"), F.col("id").alias(row_id), "sim", "rank")


def similarity_matrix(words: DataFrame, row_id: str, vec: str) -> DataFrame:
    """All pairwise cosines of a chosen word list: (a, b, sim).

    The pairs are the result asked for; the list is worked through in blocks.
    """
    return most_similar_to(words, row_id, vec, words, row_id, vec, words.count()).select(
        F.col("query").alias("a"), F.col(row_id).alias("b"), "sim")
