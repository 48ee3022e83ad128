"""Join and set queries over threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import numeric as nm
from ..functions import text as tx
from ..operators import frames as fr
from ..operators import stats as st
from ..operators import threads as th
from ..session import scratch_path
from ..sources import threadstore as ts
from . import views as v
from .registry import query
from .text_queries import (
    HEUR, JOINED, RAW, SQL_COMMENT_FEATURES, joined,
)

T, C, S = v.THINGS, v.COMMENTS, v.SUBMISSIONS
KNOWN = "known AS (SELECT * FROM submissions WHERE body <> '[deleted]')"


def known(t):
    """Live submissions: some threads lose their post."""
    return v.submissions(t).filter("body <> '[deleted]'")


@query("prj9_rebuild_permalink", v.with_views(T, C, S) + """
SELECT c.name, 'https://www.reddit.com' || s.permalink || c.id AS url,
  'https://www.reddit.com' || s.permalink || c.id || '?context=8&depth=9' AS url_in_context
FROM comments c JOIN submissions s ON c.link_id = s.name""")
def _(t):
    df = th.enrich_with_submission(v.comments(t), v.submissions(t), "subm", ["permalink"]).filter("subm IS NOT NULL")
    url = F.concat(F.lit("https://www.reddit.com"), F.col("subm.permalink"), F.col("id"))
    return df.select("name", url.alias("url"), F.concat(url, F.lit("?context=8&depth=9")).alias("url_in_context"))


@query("join1_enrich_with_submission", v.with_views(T, C, S, KNOWN) + """
SELECT c.name, c.link_id, s.name IS NOT NULL AS has_subm, s.title AS s_title, s.link_flair_text AS s_flair, s.score AS s_score
FROM comments c LEFT JOIN known s ON c.link_id = s.name""")
def _(t):
    df = th.enrich_with_submission(v.comments(t), known(t), "subm", ["title", "link_flair_text", "score"])
    return df.select("name", "link_id", F.col("subm").isNotNull().alias("has_subm"), F.col("subm.title").alias("s_title"),
                     F.col("subm.link_flair_text").alias("s_flair"), F.col("subm.score").alias("s_score"))


def thread_store(t):
    return ts.write(v.comments(t), known(t), scratch_path(t.spark, "threads"), n_buckets=16)


@query("join1_stored_threads", v.with_views(T, C, S, KNOWN) + """
SELECT c.name, c.link_id, s.name IS NOT NULL AS has_subm, s.title AS s_title, s.link_flair_text AS s_flair, s.score AS s_score
FROM comments c LEFT JOIN known s ON c.link_id = s.name""")
def _(t):
    df = ts.enriched(thread_store(t), "subm", ["title", "link_flair_text", "score"])
    return df.select("name", "link_id", F.col("subm").isNotNull().alias("has_subm"), F.col("subm.title").alias("s_title"),
                     F.col("subm.link_flair_text").alias("s_flair"), F.col("subm.score").alias("s_score"))


@query("join5_stored_threads", v.with_views(T, C, S, KNOWN) + """
SELECT s.name AS subm_name, c.name AS cmt_name, c.score AS cmt_score FROM known s LEFT JOIN comments c ON c.link_id = s.name""")
def _(t):
    out = ts.co_group(thread_store(t), ["name", "score"])
    return out.select("subm_name", F.col("cmt.name").alias("cmt_name"), F.col("cmt.score").alias("cmt_score"))


@query("join2_flow_parent_value", v.with_views(T) + """
SELECT c.name, c.parent_id, c.author, c.body || CASE WHEN p.name IS NOT NULL THEN ' <- ' || p.body ELSE '' END AS contents,
  CASE WHEN p.name IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS n_contents
FROM things c LEFT JOIN things p ON c.parent_id = p.name""")
def _(t):
    nodes = v.things(t).select("name", "parent_id", "author", F.array("body").alias("contents"))
    out = th.flow_parent_value(nodes, F.col("contents"), lambda own, parent: F.concat(own, parent), into="contents")
    return out.select("name", "parent_id", "author", F.array_join("contents", " <- ").alias("contents"),
                      F.size("contents").cast("long").alias("n_contents"))


@query("join3_enrich_with_parents", v.with_views(T, C) + """
SELECT c.name, c.parent_id, p.body AS parent_body, p.score AS parent_score
FROM comments c LEFT JOIN comments p ON c.parent_id = p.name WHERE c.score > 50""")
def _(t):
    everything = v.comments(t)
    out = th.enrich_with_parents(everything, everything.filter("score > 50"), "dgms_comment_parent", ["body", "score"])
    return out.select("name", "parent_id", F.col("dgms_comment_parent.body").alias("parent_body"),
                      F.col("dgms_comment_parent.score").alias("parent_score"))


@query("join4_submissions_of_sample", v.with_views(T, C, S, KNOWN) + """
SELECT s.name IS NOT NULL AS found, count(*) AS n FROM comments c LEFT JOIN known s ON c.link_id = s.name
WHERE c.permalink IS NULL AND c.body <> '[deleted]' GROUP BY 1""")
def _(t):
    sample = v.comments(t).filter(fr.missing_permalink(F.col("permalink"), F.col("body")))
    out = th.submissions_of_sample(sample, known(t), "subm", ["permalink"])
    return st.count_by(out, found=F.col("subm").isNotNull())


PER_ROW = 4


@query("join5_bundle_threads", v.with_views(T, C, S, KNOWN,
    "sizes AS (SELECT link_id, ceil(count(*) / 4.0)::BIGINT AS n_chunks FROM comments GROUP BY 1)",
    f"placed AS (SELECT link_id, n_chunks, floor({v.sql_uniform('name')} * n_chunks)::BIGINT AS chunk, name, score FROM comments JOIN sizes USING (link_id))",
    "lists AS (SELECT link_id, n_chunks, chunk, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, sum(score)::BIGINT AS score FROM placed GROUP BY 1, 2, 3)") + """
SELECT s.name, s.title, coalesce(chunk, 0) AS chunk, coalesce(n_chunks, 1) AS n_chunks, coalesce(n, 0) AS n_comments,
  coalesce(names, '') AS names, l.score AS total_score FROM known s LEFT JOIN lists l ON s.name = l.link_id""")
def _(t):
    out = th.bundle_threads(known(t).select("name", "title"), v.comments(t), ["name", "score"], per_row=PER_ROW)
    xs = F.col("dgms_submdb_comments_list")
    total = F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["score"])
    return out.select("name", "title", "chunk", "n_chunks", F.size(xs).cast("long").alias("n_comments"),
                      F.array_join(F.transform(xs, lambda x: x["name"]), ",").alias("names"),
                      F.when(F.size(xs) > 0, total).alias("total_score"))


@query("join5_co_group", v.with_views(T, C, S, KNOWN) + """
SELECT s.name AS subm_name, c.name AS cmt_name, c.score AS cmt_score FROM known s LEFT JOIN comments c ON c.link_id = s.name""")
def _(t):
    out = th.co_group(known(t).select("name"), v.comments(t), ["name", "score"])
    return out.select("subm_name", F.col("cmt.name").alias("cmt_name"), F.col("cmt.score").alias("cmt_score"))


@query("join7_children", v.with_views(T) + """
SELECT p.name AS parent_name, c.name AS child_name FROM things p JOIN things c ON c.parent_id = p.name""")
def _(t):
    return th.children_of(v.things(t))


@query("join8_thing_by_name", v.with_views(T, C) + """
SELECT name, title, score FROM things WHERE name IN (SELECT link_id FROM comments WHERE score > 60)""")
def _(t):
    names = v.comments(t).filter("score > 60").select(F.col("link_id").alias("name"))
    return th.thing_by_name(v.things(t), names).select("name", "title", "score")


@query("join9_semi_high_ratio", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (
  SELECT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_totalprice > 0 AND l_extendedprice / (o_totalprice + 10.0) > 1.7)""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("o_totalprice > 0")
    ids = j.filter(nm.smoothed_ratio(F.col("l_extendedprice"), F.col("o_totalprice")) > 1.7).select(
        F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("join10_not_yet_labelled", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "lang")


@query("join11_label_join", """
SELECT d.doc_id, lang, quality::DOUBLE AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    return t.documents.join(t.labels, "doc_id").select("doc_id", "lang", F.col("quality").cast("double").alias("label"))


@query("join12_count_lookup", v.with_views(T, C,
    f"f AS (SELECT name, unnest({SQL_COMMENT_FEATURES}) AS feature FROM comments)",
    "counts AS (SELECT feature, count(*) AS n FROM f GROUP BY 1)") + "SELECT name, feature, n FROM f JOIN counts USING (feature)")
def _(t):
    from ..operators.sizing import pin_small

    cmts = v.comments(t)
    counts = pin_small(st.feature_census(cmts, ft.comment_features(cmts)))
    return cmts.select("name", F.explode(ft.comment_features(cmts)).alias("feature")).join(counts, "feature")


# Sets -----------------------------------------------------------------------------------

@query("set1_union_by_name", v.with_views(T, C, S) + """
SELECT name, link_id, NULL::VARCHAR AS title, body FROM comments UNION ALL SELECT name, NULL, title, NULL FROM submissions""")
def _(t):
    a = v.comments(t).select("name", "link_id", "body")
    b = v.submissions(t).select("name", "title")
    return a.unionByName(b, allowMissingColumns=True)


@query("set2_tagged_slices", v.with_views(T, C) + """
SELECT name, 'high' AS sample_slice FROM comments WHERE score > 50 UNION ALL
SELECT name, 'middle' FROM comments WHERE score BETWEEN 0 AND 50 UNION ALL SELECT name, 'ordinary' FROM comments""")
def _(t):
    def tag(df, label):
        return df.select("name", F.lit(label).alias("sample_slice"))

    c = v.comments(t)
    return tag(c.filter("score > 50"), "high").unionByName(
        tag(c.filter("score BETWEEN 0 AND 50"), "middle")).unionByName(tag(c, "ordinary"))


@query("set3_distinct", v.with_views(T, C, f"f AS (SELECT unnest({SQL_COMMENT_FEATURES}) AS item FROM comments)") + """
SELECT DISTINCT item FROM f UNION SELECT DISTINCT parent_id FROM comments""")
def _(t):
    feats = v.comments(t).select(F.explode(ft.comment_features(v.comments(t))).alias("item"))
    return feats.unionByName(v.comments(t).select(F.col("parent_id").alias("item"))).distinct()
