"""Source and sink queries: derived rows are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import stats as st
from ..operators import topics as tp
from ..session import scratch_path, write_once
from ..sources import dumps as du
from ..sources import keyed as kt
from ..sources import lexicons as lx
from ..sources import records as rc
from . import views as v
from .registry import query
from .retrieval_queries import WV, word_vectors
from .text_queries import WORDS
from .topic_queries import PPMI_TOKENS, tokenized

T, C, S = v.THINGS, v.COMMENTS, v.SUBMISSIONS
COMMENT_FIELDS = ["id", "name", "link_id", "parent_id", "body", "author", "subreddit", "created_utc", "score", "ups", "downs", "permalink"]


def raw_comments(t):
    """Comments as in a dump: sparse names, two communities."""
    c = v.comments(t)
    return c.withColumns({"name": F.col("given_name"), "subreddit": F.when(F.col("author") == "system", "other").otherwise("france")}).select(*COMMENT_FIELDS)


def raw_submissions(t):
    s = v.submissions(t).withColumn("name", F.col("given_name"))
    return s.select("id", "name", "title", "selftext", "permalink", "link_flair_text", "subreddit", "created_utc", "score", "ups", "downs", "is_self")


RAW_COMMENTS = f"""raw_comments AS (SELECT id, given_name AS name, link_id, parent_id, body, author,
  CASE WHEN author = 'system' THEN 'other' ELSE 'france' END AS subreddit, created_utc, score, ups, downs, permalink FROM comments)"""


def dump_path(t):
    path = scratch_path(t.spark, "dump")
    raw_comments(t).write.option("compression", "gzip").json(path)
    return path


@query("src1_ingest_dump", v.with_views(T, C, RAW_COMMENTS) + f"SELECT {', '.join(COMMENT_FIELDS)} FROM raw_comments WHERE subreddit = 'france'")
def _(t):
    target = scratch_path(t.spark, "ingested")
    du.ingest_dump(t.spark, dump_path(t), target, du.COMMENT_SCHEMA, "france")
    return du.read_dump(t.spark, target, du.COMMENT_SCHEMA).select(*COMMENT_FIELDS)


@query("src2_text_lines", v.with_views(T, C) + "SELECT length(body) AS n_chars, count(*) AS n FROM (SELECT unnest(string_split(body, chr(10))) AS body FROM comments) GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "lines")
    v.comments(t).select(F.explode(F.split("body", "\n")).alias("value")).write.text(path)
    return du.read_lines(t.spark, path).groupBy(F.length("value").cast("long").alias("n_chars")).agg(F.count("*").alias("n"))


@query("src3_decode_json", """SELECT event_id, (props->>'k')::BIGINT AS k, false AS corrupt FROM events""")
def _(t):
    lines = t.events.select("event_id", F.col("props").alias("value"))
    out = du.decode_json(lines, "k bigint", keep=("event_id",))
    return out.select("event_id", "k", F.col(du.CORRUPT).isNotNull().alias("corrupt"))


@query("src4_read_text_sequence", "SELECT length(text) AS n_chars, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "textseq")
    rc.write_text_sequence(t.documents, "text", path)
    return rc.read_text_sequence(t.spark, path).groupBy(F.length("value").cast("long").alias("n_chars")).agg(F.count("*").alias("n"))


@query("src5_write_text_sequence", v.with_views(T, C, RAW_COMMENTS) + "SELECT id, link_id, score FROM raw_comments")
def _(t):
    path = scratch_path(t.spark, "jsonseq")
    rc.write_text_sequence(raw_comments(t).select(F.to_json(F.struct("*")).alias("line")), "line", path)
    back = du.decode_json(rc.read_text_sequence(t.spark, path), du.COMMENT_SCHEMA)
    return back.select("id", "link_id", "score")


@query("src6_bytes_sequence", v.with_views(T, C, RAW_COMMENTS) + "SELECT id, body FROM raw_comments")
def _(t):
    path = scratch_path(t.spark, "byteseq")
    rc.write_bytes_sequence(raw_comments(t).select("id", "body"), "id", "body", path)
    return rc.read_bytes_sequence(t.spark, path).select(F.col("key").alias("id"), F.col("value").cast("string").alias("body"))


@query("src7_record_store", v.with_views(T, C, S) + """
SELECT c.name, s.title AS s_title, s.score AS s_score, c.score FROM comments c JOIN submissions s ON c.link_id = s.name""")
def _(t):
    from ..operators import threads as th

    path = scratch_path(t.spark, "enriched")
    rc.write_records(th.enrich_with_submission(v.comments(t), v.submissions(t), "dgms_comment_submission", ["title", "score"]), path)
    return rc.read_records(t.spark, path).select("name", F.col("dgms_comment_submission.title").alias("s_title"),
                                                F.col("dgms_comment_submission.score").alias("s_score"), "score")


@query("src8_named_datasets", v.with_views(T) + "SELECT name, is_comment FROM things")
def _(t):
    root = scratch_path(t.spark, "root")
    rc.write_records(raw_comments(t), f"{root}/comments")
    rc.write_records(raw_submissions(t), f"{root}/submissions")
    return du.comments_all(t.spark, root).select("name", F.lit(True).alias("is_comment")).unionByName(
        du.submissions_all(t.spark, root).select("name", F.lit(False).alias("is_comment")))


@query("src9_json_documents", """SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels""")
def _(t):
    path = scratch_path(t.spark, "jsondocs")
    rc.write_json_documents(t.labels, path)
    return rc.read_json_documents(t.spark, path, "doc_id bigint, quality bigint, toxic bigint")


@query("src10_keyed_sink", v.with_views(T) + "SELECT name AS reddit_name, score FROM things")
def _(t):
    path = scratch_path(t.spark, "index")
    docs = v.things(t).select(F.col("name").alias("reddit_name"), "score")
    older = docs.withColumn("score", F.col("score") - 1)
    rc.write_index(docs.unionByName(older), "reddit_name", path, version=F.col("score"))
    return rc.read_records(t.spark, path)


@query("src10_keyed_upsert", v.with_views(T) + "SELECT name AS reddit_name, score + CASE WHEN score > 0 THEN 1 ELSE 0 END AS score FROM things")
def _(t):
    """An index that exists gets new versions of some documents and documents that it lacks."""
    docs = v.things(t).select(F.col("name").alias("reddit_name"), "score")
    known = kt.create(docs.filter("score > 0 OR reddit_name LIKE 't1%'"), ["reddit_name"], scratch_path(t.spark, "index"))
    kt.upsert(known, docs.withColumn("score", F.col("score") + F.when(F.col("score") > 0, 1).otherwise(0)), "score")
    return known.rows(t.spark)


@query("src11_raw_content", v.with_views(T) + """
SELECT name AS reddit_name, id, body AS doc_text FROM things""")
def _(t):
    kv = du.raw_content(v.comments(t).select("id", "body"), v.submissions(t).select("id", "body"))
    return kv.select("reddit_name", F.get_json_object("reddit_doc__json", "$.id").alias("id"),
                     F.get_json_object("reddit_doc__json", "$.body").alias("doc_text"))


@query("src12_word_vectors", f"WITH {WV} SELECT row_number() OVER (ORDER BY token) - 1 AS idx, token, len(vec) AS dim FROM wv")
def _(t):
    path = scratch_path(t.spark, "vectors")
    lx.write_word_vectors(word_vectors(t), "token", "vec", "token", path)
    back = lx.read_word_vectors(t.spark, path, normalize=lambda c: tx.normalize_term(c))
    return back.select("idx", "token", F.size("vec").cast("long").alias("dim"))


@query("src13_stop_words", f"WITH {WORDS} SELECT word FROM (SELECT lower(word) AS word, count(*) AS n FROM words GROUP BY 1 ORDER BY n DESC, word LIMIT 150)")
def _(t):
    path = scratch_path(t.spark, "stop")
    frequent = t.documents.select(F.explode(tx.split_words(F.lower("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    frequent.orderBy(F.desc("n"), "w").limit(150).select(
        F.concat("w", F.lit("   |  seen "), F.col("n").cast("string")).alias("value")).write.text(path)
    return lx.read_stop_words(t.spark, path)


@query("src14_saved_vectorizer", f"""WITH {PPMI_TOKENS}, n AS (SELECT term, count(*) AS n_term FROM tok GROUP BY 1)
SELECT row_number() OVER (ORDER BY n_term DESC, term) - 1 AS idx, term, n_term FROM n ORDER BY n_term DESC, term LIMIT 10000""")
def _(t):
    path = scratch_path(t.spark, "vectorizer")
    docs = write_once(tokenized(t).select("doc_id", "tokens"))  # texts are analysed once for both counts
    model, _ = tp.count_vectors(docs, "tokens", "bow")
    lx.save_vectorizer(model, path)
    vocabulary = tp.vocabulary_frame(t.spark, lx.load_vectorizer(path))
    per_term, _ = st.term_statistics(docs, "tokens")
    return vocabulary.join(per_term, "term").select("idx", "term", "n_term")
