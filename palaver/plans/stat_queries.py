"""Aggregation, window and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import text as tx
from ..functions import vectors as vc
from ..functions import wordlists as wl
from ..operators import frames as fr
from ..operators import ranking as rk
from ..operators import stats as st
from ..operators import threads as th
from . import views as v
from .registry import query, sql_all, sql_list
from .text_queries import (
    HEUR, JOINED, NORM, RAW, SQL_COMMENT_FEATURES, SQL_SUBMISSION_FEATURES, STOP, WORDS,
    joined, sql_hob, sql_ngrams, words,
)

T, C, S = v.THINGS, v.COMMENTS, v.SUBMISSIONS


@query("agg1_counts", v.with_views(T) + """
SELECT count(*) AS n_all, count(*) FILTER (WHERE is_comment AND body <> '[deleted]' AND length(body) <= 500) AS n_short_live FROM things""")
def _(t):
    short = F.col("is_comment") & fr.short_and_live(F.col("body"))
    return v.things(t).agg(F.count("*").alias("n_all"), F.count_if(short).alias("n_short_live"))


@query("agg2_feature_census", v.with_views(T, C, S, f"""f AS (
  SELECT 'comment' AS kind, unnest({SQL_COMMENT_FEATURES}) AS feature FROM comments
  UNION ALL SELECT 'submission', unnest({SQL_SUBMISSION_FEATURES}) FROM submissions)""") + """
SELECT kind, feature, count(*) AS n FROM f GROUP BY 1, 2""")
def _(t):
    a = st.feature_census(v.comments(t), ft.comment_features(v.comments(t))).select(F.lit("comment").alias("kind"), "feature", "n")
    b = st.feature_census(v.submissions(t), ft.submission_features(v.submissions(t))).select(F.lit("submission").alias("kind"), "feature", "n")
    return a.unionByName(b)


@query("agg3_count_by_heuristic", v.with_views(T, C, S, JOINED, RAW, HEUR) + f"""
SELECT h, count(*) AS n FROM heur WHERE flair IN ({sql_list(wl.SOCIOPOLITICAL_FLAIRS)}) AND body <> '[deleted]' GROUP BY 1""")
def _(t):
    df = v.with_raw_body(joined(t)).filter(fr.is_comment_of_interest(F.col("flair"), F.col("body")))
    return st.count_by(df, h=fr.heuristic_positive(F.col("dgms_body_raw")))


@query("agg3_count_by_media_type", v.with_views(T, S) + "SELECT media_type, count(*) AS n FROM submissions GROUP BY 1")
def _(t):
    return st.count_by(v.submissions(t), media_type=F.col("media_type"))


@query("agg4_category_frequencies", v.with_views(T, C, S, JOINED, RAW, HEUR) + f"""
SELECT flair, count(*) AS n, count(*) FILTER (WHERE h) AS n_positive, coalesce(flair IN ({sql_list(wl.TOPIC_FLAIRS)}), false) AS chosen
FROM heur GROUP BY flair""")
def _(t):
    h = fr.heuristic_positive(F.col("dgms_body_raw"))
    out = v.with_raw_body(joined(t)).groupBy("flair").agg(F.count("*").alias("n"), F.count_if(h).alias("n_positive"))
    return out.withColumn("chosen", F.coalesce(F.col("flair").isin(wl.TOPIC_FLAIRS), F.lit(False)))


BUCKETS = f"""buckets AS (SELECT {sql_hob('w')} AS bucket, count(*) AS n_docs, sum(c)::BIGINT AS n_chars, sum(w)::BIGINT AS n_words
  FROM (SELECT length(text)::BIGINT AS c, len({sql_all('text', tx.WORD)})::BIGINT AS w FROM documents) GROUP BY 1)"""


@query("agg5_length_buckets", f"WITH {BUCKETS} SELECT * FROM buckets")
def _(t):
    return st.length_buckets(t.documents, F.col("text"))


@query("agg6_term_statistics", f"""WITH {WORDS}, terms AS (SELECT lower(word) AS term, count(*) AS n_term FROM words GROUP BY 1)
SELECT term, n_term, (SELECT count(*) FROM words) AS n_total, (SELECT count(*) FROM documents) AS n_docs FROM terms""")
def _(t):
    docs = t.documents.select(tx.split_words(F.lower("text")).alias("tokens"))
    per_term, overall = st.term_statistics(docs, "tokens")
    totals = overall.select(F.struct("n_total", "n_docs")).scalar()
    return per_term.withColumn("_t", totals).select("term", "n_term", "_t.n_total", "_t.n_docs")


@query("agg7_document_frequency", f"""
SELECT gram, count(*) AS n_docs_with FROM (
  SELECT doc_id, unnest({sql_ngrams('w')}) AS gram FROM (SELECT doc_id, {sql_all('lower(text)', tx.WORD)} AS w FROM documents))
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10000""")
def _(t):
    docs = t.documents.select(tx.split_words(F.lower("text")).alias("w"))
    return st.document_frequency(docs, tx.first_ngrams(F.col("w")), 10000)


SCORED = """scored AS (SELECT d.doc_id, d.lang, length(text) > 800 AS h, quality > 0.5 AS r, length(text) / 10000.0 AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def scored(t):
    """Labelled documents with a length heuristic and score."""
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "lang", (F.length("text") > 800).alias("h"), (F.col("quality") > 0.5).alias("r"),
        (F.length("text") / F.lit(10000.0)).alias("score"))


@query("agg9_contingency", f"""WITH {SCORED} SELECT count(*) FILTER (WHERE h AND r) AS n_h_r, count(*) FILTER (WHERE NOT h AND r) AS n_noth_r,
  count(*) FILTER (WHERE h AND NOT r) AS n_h_notr, count(*) FILTER (WHERE NOT h AND NOT r) AS n_noth_notr FROM scored""")
def _(t):
    return st.contingency(scored(t), "h", "r")


@query("agg10_cross_tab", f"WITH {SCORED} SELECT r, score >= 0.1 AS above, count(*) AS n FROM scored GROUP BY 1, 2")
def _(t):
    return st.count_by(scored(t), r=F.col("r"), above=F.col("score") >= 0.1)


@query("agg11_score_histogram", "SELECT floor(value * 10) / 10.0::DOUBLE AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return st.score_histogram(t.events, F.col("value"))


@query("agg12_index_by", "SELECT conv_id, max_by(role, turn) AS last_role, max_by(text, turn) AS last_text FROM conversations GROUP BY 1")
def _(t):
    last = F.max_by(F.struct("role", "text"), "turn").alias("last")
    return t.conversations.groupBy("conv_id").agg(last).select(
        "conv_id", F.col("last.role").alias("last_role"), F.col("last.text").alias("last_text"))


@query("agg12_group_by", f"""WITH sizes AS (SELECT source, ceil(count(*) / 20.0)::BIGINT AS n_chunks FROM documents GROUP BY 1)
SELECT source, n_chunks, floor({v.sql_uniform('doc_id::VARCHAR')} * n_chunks)::BIGINT AS chunk, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids
FROM documents JOIN sizes USING (source) GROUP BY 1, 2, 3""")
def _(t):
    lists = th.chunked_lists(t.documents.select("source", "doc_id"), "source", "doc_id", "doc_id", per_row=20)
    return lists.select("source", "n_chunks", "chunk", F.array_join(F.col("items").cast("array<string>"), ",").alias("ids"))


OCCURRENCES = f"""occ AS (SELECT {NORM} AS term, {{'d': doc_id, 'p': pos}} AS idx, word FROM (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {sql_all('text', tx.WORD)} AS w FROM documents)))"""


def first_occurrences(t):
    """Every term with the unique rank, in corpus order, and the word of its first occurrence.

    Words are brought to their first place before they are normalised: a few distinct ones are shuffled, not all occurrences.
    """
    w = t.documents.select("doc_id", F.posexplode(tx.split_words(F.col("text"))).alias("pos", "word"))
    span = t.documents.select(F.min("doc_id"), F.max("doc_id")).first()
    w = rk.first_places(w, "word", "doc_id", "pos", tuple(span)).select(
        tx.normalize_term(F.col("word")).alias("term"), F.struct(F.col("doc_id").alias("d"), F.col("pos").alias("p")).alias("idx"), "word")
    return rk.keep_smallest_rank(w.filter("term IS NOT NULL"), "term", "idx", ["word"])


@query("agg13_keep_lowest_index", f"""WITH {OCCURRENCES} SELECT term, min(idx).d AS doc_id, min(idx).p AS pos, min_by(word, idx) AS word FROM occ
WHERE term <> '' AND term NOT IN ({STOP}) GROUP BY 1""")
def _(t):
    out = first_occurrences(t)
    return out.select("term", F.col("idx.d").alias("doc_id"), F.col("idx.p").alias("pos"), "word")


@query("agg14_mean_pairwise_cosine", """
SELECT round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean_sim
FROM embeddings a, embeddings b WHERE a.label < 5 AND b.label >= 5""")
def _(t):
    e = t.embeddings.select("label", vc.as_doubles(F.col("embedding")).alias("e"))
    out = st.mean_pairwise_cosine(e.filter("label < 5"), e.filter("label >= 5"), "e", 64)
    return out.select(F.round("mean_sim", 6).alias("mean_sim"))


# Windows and orderings ------------------------------------------------------------------

@query("win1_running_totals", f"""WITH {BUCKETS}
SELECT bucket, n_docs, sum(n_docs) OVER w::BIGINT AS cum_n_docs, sum(n_docs * bucket) OVER w::BIGINT AS cum_volume
FROM buckets WINDOW w AS (ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING)""")
def _(t):
    b = st.length_buckets(t.documents, F.col("text")).withColumn("volume", F.col("n_docs") * F.col("bucket"))
    return st.running_totals(b, "bucket", ["n_docs", "volume"]).select("bucket", "n_docs", "cum_n_docs", "cum_volume")


@query("win2_running_totals_three", f"""WITH {BUCKETS}
SELECT bucket, sum(n_docs) OVER w::BIGINT AS cum_n_docs, sum(n_chars) OVER w::BIGINT AS cum_n_chars, sum(n_words) OVER w::BIGINT AS cum_n_words
FROM buckets WINDOW w AS (ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING)""")
def _(t):
    out = st.running_totals(st.length_buckets(t.documents, F.col("text")), "bucket", ["n_docs", "n_chars", "n_words"])
    return out.select("bucket", "cum_n_docs", "cum_n_chars", "cum_n_words")


@query("win3_hold_out", """
SELECT doc_id, quality::BIGINT AS quality, rank FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rank FROM labels) WHERE (rank - 1) % 10 < 9""")
def _(t):
    out = rk.hold_out(t.labels.select("doc_id", F.col("quality").cast("long").alias("quality")), [F.asc("doc_id")])
    return out.select("doc_id", "quality", "rank")


@query("win4_prefix_until_unlabelled", """
WITH x AS (SELECT d.doc_id, l.quality::BIGINT AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  WHERE d.doc_id >= (SELECT min(doc_id) FROM labels))
SELECT * FROM x WHERE doc_id < coalesce((SELECT min(doc_id) FROM x WHERE quality IS NULL), 9223372036854775807)""")
def _(t):
    x = t.documents.select("doc_id").join(
        t.labels.select("doc_id", F.col("quality").cast("long").alias("quality")), "doc_id", "left")
    first = t.labels.select(F.min("doc_id")).scalar()
    return rk.prefix_until_missing(x.filter(F.col("doc_id") >= first), "doc_id", "quality")


@query("win5_top_per_group", f"""WITH {WORDS}, n AS (SELECT source, lower(word) AS word, count(*) AS n FROM words GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM n) WHERE rank <= 20""")
def _(t):
    n = words(t).groupBy("source", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    return rk.top_per_group(n, ["source"], [F.desc("n"), F.asc("word")], 20)


@query("top1_top_n_threshold", """
SELECT doc_id, n_chars, min(n_chars) OVER () AS threshold FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20000)""")
def _(t):
    top = rk.top_n(t.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 20_000)
    return top.withColumn("threshold", top.select(F.min("n_chars")).scalar())


@query("top2_score_bands", """
SELECT doc_id, rank, CASE WHEN rank > 5000 THEN 1 ELSE 0 END::BIGINT AS band FROM (
  SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 20000""")
def _(t):
    out = rk.score_bands(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id", [5_000, 20_000])
    return out.select("doc_id", "rank", "band")


@query("top3_stable_draw", v.with_views(T, C) + f"SELECT name, score FROM comments ORDER BY {v.sql_uniform(chr(110) + 'ame || ' + repr('_H'))}, name LIMIT 30")
def _(t):
    key = F.concat("name", F.lit("_H"))
    return rk.draw_n(v.comments(t).select("name", "score"), 30, key, "name")


@query("top4_by_frequency", f"WITH {WORDS} SELECT lower(word) AS word, count(*) AS n FROM words GROUP BY 1 ORDER BY 2 DESC, 1")
def _(t):
    return words(t).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word")


@query("top6_next_unlabelled", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 1""")
def _(t):
    todo = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_anti")
    return rk.top_n(todo, [F.asc("doc_id")], 1)


@query("top7_first_distinct_tokens", f"""WITH {OCCURRENCES}
SELECT term, min(idx).d AS doc_id, min(idx).p AS pos, min_by(word, idx) AS word FROM occ
WHERE term <> '' AND term NOT IN ({STOP}) GROUP BY 1 ORDER BY 2, 3 LIMIT 50000""")
def _(t):
    top = rk.top_n(first_occurrences(t), [F.asc("idx")], 50000)
    return top.select("term", F.col("idx.d").alias("doc_id"), F.col("idx.p").alias("pos"), "word")
