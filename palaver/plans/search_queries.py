"""Search document, search and label-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import wordlists as wl
from ..operators import labels as lb
from ..operators import postings as ps
from ..operators import search as se
from ..session import scratch_path
from ..sources import keyed as kt
from . import views as v
from .registry import query, quoted, sql_all
from .text_queries import sql_analyze, sql_count, sql_formatting, sql_links, sql_sentences

T, C, S = v.THINGS, v.COMMENTS, v.SUBMISSIONS
KNOWN = "known AS (SELECT * FROM submissions WHERE body <> '[deleted]')"


def sql_doc(md: str) -> str:
    ok = f"({v.sql_non_empty(md)})"
    return f"""name AS reddit_name, strftime(make_timestamp(created_utc::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS reddit_created,
  ups::INT AS reddit_n_ups, downs::INT AS reddit_n_downs, score::INT AS reddit_score, {v.sql_raw(md)} AS dgms_text_contents,
  len({sql_sentences(v.sql_raw(md))})::INT AS dgms_n_sentences, len({sql_all(v.sql_raw(md), tx.WORD_OR_PUNCT)})::INT AS dgms_n_words,
  coalesce(len({sql_links(ok)}), 0)::INT AS dgms_n_hyperlinks, {sql_formatting(ok)}::INT AS dgms_n_formatting"""


SUBM_MD = f"(concat_ws(chr(10) || chr(10), title, {v.sql_non_empty('selftext')}))"
SDOCS = f"""sdocs AS (SELECT {sql_doc('md')}, 'reddit_type_submission' AS reddit_type, name AS subm_reddit_name, title AS subm_title,
  link_flair_text AS dgms_flair FROM (SELECT *, {SUBM_MD} AS md FROM known))"""
CDOCS = f"cdocs AS (SELECT {sql_doc('body')}, 'reddit_type_comment' AS reddit_type, parent_id AS parent_reddit_name, link_id FROM comments)"
COLS = ["reddit_name", "reddit_type", "parent_reddit_name", "subm_reddit_name", "subm_title", "dgms_text_contents",
        "dgms_parent_text_contents", "reddit_created", "dgms_flair", "reddit_n_ups", "reddit_n_downs", "reddit_score",
        "dgms_n_sentences", "dgms_n_words", "dgms_n_hyperlinks", "dgms_n_formatting"]
DOCS = f"""pool AS (SELECT reddit_name, link_id, dgms_text_contents FROM cdocs UNION ALL SELECT reddit_name, reddit_name, dgms_text_contents FROM sdocs),
linked AS (SELECT c.*, s.reddit_name AS subm_reddit_name, s.subm_title, s.dgms_flair, p.dgms_text_contents AS dgms_parent_text_contents
  FROM cdocs c JOIN sdocs s ON c.link_id = s.reddit_name LEFT JOIN pool p ON c.parent_reddit_name = p.reddit_name AND c.link_id = p.link_id),
docs AS (SELECT {', '.join(COLS)} FROM linked UNION ALL SELECT {', '.join('NULL' if c in ('parent_reddit_name', 'dgms_parent_text_contents') else c for c in COLS)} FROM sdocs)"""
BASE = (T, C, S, KNOWN, SDOCS, CDOCS)


def known(t):
    return v.submissions(t).filter("body <> '[deleted]'")


def documents(t):
    return se.search_documents(known(t), v.comments(t))


def flat(df):
    iso = tx.iso_instant(F.col("reddit_created")).alias("reddit_created")
    return df.select(*[iso if c == "reddit_created" else F.col(c) for c in df.columns])


@query("srch1_submission_documents", v.with_views(*BASE) + "SELECT *, NULL::VARCHAR AS parent_reddit_name, NULL::VARCHAR AS dgms_parent_text_contents FROM sdocs")
def _(t):
    return flat(se.submission_documents(known(t)))


@query("srch2_comment_documents", v.with_views(*BASE) + "SELECT * FROM cdocs")
def _(t):
    df = se.comment_documents(v.comments(t))
    ints = {c: F.col(c).cast("int") for c in df.columns if c.startswith(("reddit_n", "reddit_score", "dgms_n_")) and c != "reddit_name"}
    return flat(df.withColumns(ints))


@query("srch3_thread_documents", v.with_views(*BASE, DOCS) + "SELECT * FROM docs")
def _(t):
    return flat(documents(t))


@query("join6_fields_from_relatives", v.with_views(*BASE, DOCS) + """
SELECT reddit_name, subm_reddit_name, subm_title, dgms_flair, dgms_parent_text_contents FROM linked""")
def _(t):
    out = se.fields_from_relatives(se.comment_documents(v.comments(t)), se.submission_documents(known(t)))
    return out.select("reddit_name", "subm_reddit_name", "subm_title", "dgms_flair", "dgms_parent_text_contents")


@query("srch4_schema_coverage", v.with_views(*BASE, DOCS) + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS n_present FROM docs" for c in COLS))
def _(t):
    return se.schema_coverage(documents(t))


def sql_search(rel: str, id_: str, field: str, text: str, where: str) -> str:
    return f"""q AS (SELECT DISTINCT unnest({sql_analyze(quoted(text))}) AS term),
post AS (SELECT {id_}, term, count(*) AS tf FROM (SELECT {id_}, unnest({sql_analyze(field)}) AS term FROM {rel}) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1), tot AS (SELECT count({field}) AS n FROM {rel})
SELECT {id_}, round(sum(ln(1.0::DOUBLE + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2)), 6) AS score
FROM post JOIN dfs USING (term) JOIN {rel} USING ({id_}), tot WHERE {where} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""


TEXT_QUERY = "Réponse the in oder für para qui l'ouier mentoi ?"


@query("srch5_text_search", "WITH " + sql_search("documents", "doc_id", "text", TEXT_QUERY,
       f"lang IN ('fr', 'de') AND len({sql_all('text', tx.WORD_OR_PUNCT)}) >= 50"))
def _(t):
    return se.text_search(t.documents, "doc_id", "text", TEXT_QUERY,
                          [F.col("lang").isin("fr", "de"), tx.n_words(F.col("text")) >= 50])


@query("srch5_indexed_search", "WITH " + sql_search("documents", "doc_id", "text", TEXT_QUERY,
       f"lang IN ('fr', 'de') AND len({sql_all('text', tx.WORD_OR_PUNCT)}) >= 50"))
def _(t):
    path = scratch_path(t.spark, "search")
    ps.write_index(t.documents, "doc_id", "text", path, {"lang": F.col("lang"), "n_words": tx.n_words(F.col("text"))})
    found = ps.search(t.spark, path, TEXT_QUERY, [F.col("lang").isin("fr", "de"), F.col("n_words") >= 50])
    return found.select(F.col("doc").alias("doc_id"), "score")


@query("srch5_parent_text_search", v.with_views(*BASE, DOCS) + "," + sql_search("docs", "reddit_name", "dgms_parent_text_contents", TEXT_QUERY,
       "dgms_n_words >= 50 AND dgms_n_hyperlinks >= 1 AND dgms_n_formatting >= 1"))
def _(t):
    return se.text_search(documents(t), "reddit_name", "dgms_parent_text_contents", TEXT_QUERY, [
        F.col("dgms_n_words") >= 50, F.col("dgms_n_hyperlinks") >= 1, F.col("dgms_n_formatting") >= 1])


@query("srch6_match_all", v.with_views(*BASE, DOCS) + """
SELECT (SELECT count(*) FROM docs) AS n_docs, reddit_name FROM docs ORDER BY reddit_name LIMIT 10""")
def _(t):
    total, page = se.match_all(documents(t), "reddit_name")
    return page.select(total.scalar().alias("n_docs"), "reddit_name")


# Labels ---------------------------------------------------------------------------------

TABLE = """tbl AS (SELECT 'quality' AS dataset_id, doc_id::VARCHAR AS datapoint_id, '{"doc_id":' || doc_id || '}' AS payload, quality::DOUBLE AS label, doc_id AS label_time FROM labels
  UNION ALL SELECT 'toxic', doc_id::VARCHAR, '{"doc_id":' || doc_id || '}', toxic::DOUBLE, doc_id FROM labels)"""
NEW = """fresh AS (SELECT 'quality' AS dataset_id, doc_id::VARCHAR AS datapoint_id, '{"source":"' || source || '"}' AS payload,
  CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END::DOUBLE AS label, n_chars AS label_time FROM documents WHERE lang = 'fr')"""


def table(t):
    doc = F.to_json(F.struct("doc_id")).alias("payload")
    def part(dataset, col):
        return t.labels.select(F.lit(dataset).alias("dataset_id"), F.col("doc_id").cast("string").alias("datapoint_id"), doc,
                               F.col(col).cast("double").alias("label"), F.col("doc_id").alias("label_time"))
    return part("quality", "quality").unionByName(part("toxic", "toxic"))


def fresh(t):
    return t.documents.filter("lang = 'fr'").select(
        F.lit("quality").alias("dataset_id"), F.col("doc_id").cast("string").alias("datapoint_id"),
        F.to_json(F.struct("source")).alias("payload"), F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0).alias("label"),
        F.col("n_chars").alias("label_time"))


SAVED = """saved AS (SELECT * EXCLUDE (r, is_new) FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, datapoint_id ORDER BY label_time DESC, is_new DESC) AS r
  FROM (SELECT *, 0 AS is_new FROM tbl UNION ALL SELECT *, 1 FROM fresh)) WHERE r = 1)"""


@query("lbl1_save_labels", v.with_views(TABLE, NEW, SAVED) + "SELECT * FROM saved")
def _(t):
    return lb.save_labels(table(t), fresh(t))


@query("lbl2_already_labelled", v.with_views(TABLE) + """
SELECT doc_id, doc_id::VARCHAR AS datapoint_id, doc_id::VARCHAR IN (SELECT datapoint_id FROM tbl WHERE dataset_id = 'quality') AS labelled FROM documents""")
def _(t):
    items = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("datapoint_id"))
    return lb.already_labelled(table(t), "quality", items)


@query("lbl3_labels_of_dataset", v.with_views(TABLE) + "SELECT datapoint_id, payload, label FROM tbl WHERE dataset_id = 'quality'")
def _(t):
    return lb.labels_of(table(t), "quality").select("datapoint_id", "payload", "label")


@query("lbl4_count_labelled", v.with_views(TABLE) + "SELECT count(*) AS n FROM tbl WHERE dataset_id = 'toxic'")
def _(t):
    return lb.count_labelled(table(t), "toxic")


@query("lbl5_clear_labels", v.with_views(TABLE) + "SELECT * FROM tbl WHERE dataset_id <> 'toxic'")
def _(t):
    return lb.clear_labels(table(t), "toxic")


@query("lbl6_correct_labels", v.with_views(TABLE, NEW) + """
SELECT t.dataset_id, t.datapoint_id, '{"id":"' || t.datapoint_id || '"}' AS payload, coalesce(f.label, t.label) AS label, t.label_time
FROM tbl t LEFT JOIN fresh f ON t.dataset_id = f.dataset_id AND t.datapoint_id = f.datapoint_id""")
def _(t):
    fixed = lb.correct_labels(table(t), fresh(t))
    return lb.replace_payload(fixed, F.to_json(F.struct(F.col("datapoint_id").alias("id"))))


def label_store(t):
    """The label table as one that is kept: a dataset's labels are in buckets of their own."""
    return kt.create(table(t), lb.KEY, scratch_path(t.spark, "labels"), within=["dataset_id"], order=F.col("label_time"))


@query("lbl1_store_save", v.with_views(TABLE, NEW, SAVED) + "SELECT * FROM saved")
def _(t):
    store = label_store(t)
    kt.upsert(store, fresh(t), "label_time")
    return store.rows(t.spark)


@query("lbl5_store_clear", v.with_views(TABLE) + "SELECT * FROM tbl WHERE dataset_id <> 'toxic'")
def _(t):
    store = label_store(t)
    kt.clear(store, t.spark, dataset_id="toxic")
    return store.rows(t.spark)


@query("lbl6_store_correct", v.with_views(TABLE, NEW) + """
SELECT t.* EXCLUDE (label), coalesce(f.label, t.label) AS label FROM tbl t LEFT JOIN fresh f ON t.dataset_id = f.dataset_id AND t.datapoint_id = f.datapoint_id""")
def _(t):
    store = label_store(t)
    kt.update(store, fresh(t), "label", "label_time")
    return store.rows(t.spark)


@query("lbl7_false_negatives", v.with_views(TABLE) + """
SELECT datapoint_id, label, score FROM (SELECT datapoint_id, label, n_chars / 10000.0::DOUBLE AS score FROM tbl JOIN documents ON doc_id = datapoint_id::BIGINT WHERE dataset_id = 'quality')
WHERE label > 0.5 AND score < 0.1""")
def _(t):
    docs = t.documents.select(F.col("doc_id").cast("string").alias("datapoint_id"), (F.col("n_chars") / F.lit(10000.0)).alias("score"))
    scored = lb.labels_of(table(t), "quality").join(docs, "datapoint_id").select("datapoint_id", "label", "score")
    return lb.false_negatives(scored, 0.1)
