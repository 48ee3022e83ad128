"""Word vectors, text vectors and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vc
from ..functions import wordlists as wl
from ..operators import ranking as rk
from ..operators import retrieval as rt
from ..session import write_once
from . import views as v
from .registry import query, quoted, sql_all
from .text_queries import STOP, sql_ends, sql_sentences

DIM = 64


def term_tokens(t):
    """All normalised terms of documents and benchmark texts."""
    asked = t.spark.createDataFrame([(x,) for x in wl.PRAISE_SENTENCES], "text string")
    texts = t.documents.select("text").unionByName(t.benchmark.select("text")).unionByName(asked)
    return texts.select(F.explode(F.array_distinct(rt.phrase_tokens(F.col("text")))).alias("token")).distinct()


def word_vectors(t):
    """A word-vector table: each known term takes the vector its hash points at.

    The hash range is four times the number of vectors, so three terms in four are unknown.
    """
    n = t.embeddings.select(F.count("*")).scalar()
    slot = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 8), 16, 10).cast("long") % (n * 4)
    table = term_tokens(t).withColumn("vec_id", slot).join(t.embeddings, "vec_id").select(
        "token", F.col("embedding").alias("vec"))
    return write_once(table)


def _norm(w: str) -> str:
    return f"regexp_replace({v.sql_fold(w)}, '[^A-Za-z0-9_]', '', 'g')"


def sql_phrase_tokens(expr: str) -> str:
    return (f"list_filter(list_transform({sql_all(expr, tx.WORD_APOSTROPHE)}, lambda w: {_norm('w')}), "
            f"lambda w: w <> '' AND w NOT IN ({STOP}))")


ASKED = ", ".join(f"({i}, {quoted(x)})" for i, x in enumerate(wl.PRAISE_SENTENCES))
WV = f"""asked AS (SELECT * FROM (VALUES {ASKED}) AS q(i, text)),
n_vec AS (SELECT count(*) AS n FROM embeddings),
toks AS (SELECT DISTINCT token FROM (SELECT unnest({sql_phrase_tokens('text')}) AS token FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM asked))),
wv AS (SELECT token, embedding::DOUBLE[] AS vec FROM (SELECT token, ('0x' || substr(md5(token), 1, 8))::BIGINT % (n * 4) AS vec_id FROM toks, n_vec) JOIN embeddings USING (vec_id))"""

DOC_TOKENS = f"""ends AS (SELECT doc_id, {sql_ends('s', 2, 2)} AS e FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)),
dt AS (SELECT doc_id, unnest({sql_phrase_tokens("array_to_string(e, ' ')")}) AS token FROM ends)"""


def sql_vectors(rel: str, id_: str, name: str, how: str) -> str:
    """(id, vec) per row of `rel(id, token)`, aggregated with `how` per dimension."""
    return f"""{name}_dims AS (SELECT {id_}, i, {how}(x) AS x FROM (SELECT {id_}, unnest(vec) AS x, unnest(range({DIM})) AS i FROM {rel} JOIN wv USING (token)) GROUP BY 1, 2),
{name} AS (SELECT {id_}, list(x ORDER BY i) AS vec FROM {name}_dims GROUP BY 1)"""


def doc_vectors(t, vectors):
    return rt.doc_vectors(t.documents, "doc_id", rt.praise_tokens(F.col("text")), vectors, DIM)


def bench_vectors(t, vectors):
    return rt.phrase_vectors(t.benchmark, "item_id", rt.phrase_tokens(F.col("text")), vectors, DIM)


@query("ret1_doc_vectors", f"""WITH {WV}, {DOC_TOKENS}, {sql_vectors('dt', 'doc_id', 'dv', 'sum')}
SELECT doc_id, round(vec[1] / norm, 6) AS first, round(vec[{DIM}] / norm, 6) AS last, round(list_sum(vec) / norm, 6) AS total
FROM documents LEFT JOIN (SELECT doc_id, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS norm FROM dv) USING (doc_id)""")
def _(t):
    vec = F.col("vec")
    return doc_vectors(t, word_vectors(t)).select("doc_id", F.round(F.get(vec, F.lit(0)), 6).alias("first"),
                                 F.round(F.get(vec, F.lit(DIM - 1)), 6).alias("last"), F.round(vc.total(vec), 6).alias("total"))


BENCH = f"bt AS (SELECT item_id, unnest({sql_phrase_tokens('text')}) AS token FROM benchmark),\n" + sql_vectors("bt", "item_id", "bv", "avg")


@query("ret2_phrase_vectors", f"""WITH {WV}, {BENCH}
SELECT item_id, round(coalesce(vec[1], 0), 6) AS first, round(coalesce(list_sum(vec), 0), 6) AS total FROM benchmark LEFT JOIN bv USING (item_id)""")
def _(t):
    vec = F.col("vec")
    return bench_vectors(t, word_vectors(t)).select("item_id", F.round(F.get(vec, F.lit(0)), 6).alias("first"), F.round(vc.total(vec), 6).alias("total"))


ASKED_VECTORS = f"asked_tokens AS (SELECT i AS q, unnest({sql_phrase_tokens('text')}) AS token FROM asked),\n" + sql_vectors("asked_tokens", "q", "av", "avg")


@query("ret3_pre_sim_score", f"""WITH {WV}, {DOC_TOKENS}, {sql_vectors('dt', 'doc_id', 'dv', 'sum')}, {ASKED_VECTORS},
m AS (SELECT doc_id, max(coalesce(list_cosine_similarity(dv.vec, av.vec), 0)) AS sim FROM dv, (SELECT i, vec FROM asked LEFT JOIN av ON av.q = asked.i) av GROUP BY 1)
SELECT doc_id, round(coalesce(sim, -1.0::DOUBLE), 6) AS pre_sim FROM documents LEFT JOIN m USING (doc_id)""")
def _(t):
    out = rt.pre_sim_score(t.documents, "doc_id", F.col("text"), word_vectors(t), DIM)
    return out.select("doc_id", F.round("pre_sim", 6).alias("pre_sim"))


CENTRES = f"""centre_dims AS (SELECT label, i, sum(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range({DIM})) AS i FROM embeddings) GROUP BY 1, 2),
centres AS (SELECT label, list(x ORDER BY i) AS vec FROM centre_dims GROUP BY 1)"""


def label_queries(t):
    """One query vector per label: the sum of its vectors."""
    return t.embeddings.groupBy("label").agg(vc.sum_per_dim(F.col("embedding"), DIM).alias("vec"))


SIMS = f"WITH {CENTRES}, sims AS (SELECT label::BIGINT AS query, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], vec), 6) AS sim FROM (SELECT vec_id, embedding FROM embeddings), centres)"


@query("ret4_rank_by_similarity", f"""{SIMS}
SELECT query, vec_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM sims) WHERE rank <= 1000""")
def _(t):
    out = rt.most_similar_to(t.embeddings, "vec_id", "embedding", label_queries(t), "label", "vec", 1000)
    return out.withColumn("query", F.col("query").cast("long"))


FIRST_WORDS = "firsts AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1), words AS (SELECT e.* FROM embeddings e JOIN firsts USING (vec_id))"


def query_words(t):
    """One query word per label: its first vector."""
    firsts = t.embeddings.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("w"))
    return firsts.select("w.vec_id", "w.embedding")


@query("ret5_similarity_matrix", f"""WITH {FIRST_WORDS}
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM words a, words b""")
def _(t):
    return rt.similarity_matrix(query_words(t), "vec_id", "embedding").withColumn("a", F.col("a").cast("long"))


@query("top8_similar_words", f"""WITH {FIRST_WORDS}, s AS (SELECT w.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], w.embedding::DOUBLE[]), 6) AS sim
  FROM embeddings e, words w)
SELECT query, vec_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 20""")
def _(t):
    out = rt.most_similar_to(t.embeddings, "vec_id", "embedding", query_words(t), "vec_id", "embedding", 20)
    return out.withColumn("query", F.col("query").cast("long"))


@query("top5_similarity_page", f"""WITH {WV}, {DOC_TOKENS}, {sql_vectors('dt', 'doc_id', 'dv', 'sum')}, {BENCH},
m AS (SELECT doc_id, round(max(list_cosine_similarity(dv.vec, bv.vec)), 6) AS sim FROM dv, bv GROUP BY 1)
SELECT doc_id, round(coalesce(sim, -1.0::DOUBLE), 6) AS sim FROM documents LEFT JOIN m USING (doc_id) ORDER BY 2 DESC, 1 OFFSET 20 LIMIT 20""")
def _(t):
    vectors = word_vectors(t)
    scored = rt.with_max_similarity(doc_vectors(t, vectors), "vec", bench_vectors(t, vectors), "item_id", "vec", "sim").select("doc_id", "sim")
    return rk.page(scored, [F.desc("sim"), F.asc("doc_id")], 20, 20)
