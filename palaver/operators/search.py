"""Flat search documents and filtered text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markup as mk
from ..functions import text as tx
from ..session import write_once
from . import frames as fr
from . import threads as th

SEARCH_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("reddit_name", T.StringType()), ("reddit_type", T.StringType()),
    ("parent_reddit_name", T.StringType()), ("subm_reddit_name", T.StringType()),
    ("subm_title", T.StringType()), ("dgms_text_contents", T.StringType()),
    ("dgms_parent_text_contents", T.StringType()), ("reddit_created", T.TimestampType()),
    ("dgms_flair", T.StringType()), ("reddit_n_ups", T.IntegerType()),
    ("reddit_n_downs", T.IntegerType()), ("reddit_score", T.IntegerType()),
    ("dgms_n_sentences", T.IntegerType()), ("dgms_n_words", T.IntegerType()),
    ("dgms_n_hyperlinks", T.IntegerType()), ("dgms_n_formatting", T.IntegerType()),
]])
MEASURES = ["dgms_n_sentences", "dgms_n_words", "dgms_n_hyperlinks", "dgms_n_formatting"]


def _conform(df: DataFrame) -> DataFrame:
    """Project on the search schema; fields that are not produced are null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SEARCH_SCHEMA])


def _with_text_fields(df: DataFrame, md: str) -> DataFrame:
    out = mk.with_text_features(df, md, ["dgms_body_raw", *MEASURES])
    return out.withColumnRenamed("dgms_body_raw", "dgms_text_contents")


def _common() -> list[Column]:
    created = tx.instant_from_utc(F.col("created_utc")).alias("reddit_created")
    return [c for c in fr.common_search_fields()[:1]] + [created] + fr.common_search_fields()[2:]


def submission_documents(subm: DataFrame) -> DataFrame:
    """Search documents of submissions; the text is the title followed by the body."""
    md = F.concat_ws("\n\n", F.col("title"), tx.non_empty_md(F.col("selftext")))
    base = subm.select(
        *_common(), F.lit("reddit_type_submission").alias("reddit_type"), F.col("name").alias("subm_reddit_name"),
        F.col("title").alias("subm_title"), F.col("link_flair_text").alias("dgms_flair"), md.alias("_md"))
    return _conform(_with_text_fields(base, "_md"))


def comment_documents(comments: DataFrame) -> DataFrame:
    """Search documents of comments, without inherited fields; keeps link_id."""
    base = comments.select(
        *_common(), "link_id", F.lit("reddit_type_comment").alias("reddit_type"),
        F.col("parent_id").alias("parent_reddit_name"), F.col("body").alias("_md"))
    return _with_text_fields(base, "_md").drop("_md")


def fields_from_relatives(cmt_docs: DataFrame, subm_docs: DataFrame) -> DataFrame:
    """Give comments their thread's name, title and flair, and the text of what they answer.

    Comments of unknown threads are dropped. The parent must belong to the same thread. All
    joins are row-wise equi-joins with a unique right side.
    """
    posts = th.one_per_key(subm_docs.select("reddit_name", "subm_title", "dgms_flair", "dgms_text_contents"), "reddit_name")
    head = posts.select(F.col("reddit_name").alias("link_id"), F.col("reddit_name").alias("subm_reddit_name"), "subm_title", "dgms_flair")
    inside = th.lookup_inner(cmt_docs, head, "link_id", "reddit_name")
    texts = cmt_docs.select("reddit_name", "link_id", "dgms_text_contents").unionByName(
        posts.select("reddit_name", F.col("reddit_name").alias("link_id"), "dgms_text_contents"))
    parents = th.one_per_key(texts, "reddit_name").select(
        F.col("reddit_name").alias("parent_reddit_name"), F.col("link_id").alias("_thread"),
        F.col("dgms_text_contents").alias("_ptext"))
    out = th.lookup(inside, parents, "parent_reddit_name", "reddit_name")
    return out.withColumn(
        "dgms_parent_text_contents", F.when(F.col("_thread") == F.col("link_id"), F.col("_ptext"))).drop("_thread", "_ptext")


def search_documents(subm: DataFrame, comments: DataFrame) -> DataFrame:
    """All search documents of all threads."""
    posts = submission_documents(th.one_per_key(subm, "name"))
    cmts = fields_from_relatives(comment_documents(comments.filter("link_id IS NOT NULL")), posts)
    return posts.unionByName(_conform(cmts))


def schema_coverage(docs: DataFrame) -> DataFrame:
    """Number of non-null values per mapped field; every field should be produced somewhere."""
    if docs.schema != SEARCH_SCHEMA and [f.dataType for f in docs.schema] != [f.dataType for f in SEARCH_SCHEMA]:
        raise ValueError("documents do not follow the search schema")
    counts = docs.agg(*[F.count(f.name).alias(f.name) for f in SEARCH_SCHEMA])
    return counts.unpivot([], [f.name for f in SEARCH_SCHEMA], "field", "n_present")


def query_terms(spark, text: str) -> list[str]:
    """Distinct index terms of a query, analysed like the documents."""
    return list(dict.fromkeys(spark.range(1).select(tx.analyze_french(F.lit(text))).first()[0]))


def text_search(docs: DataFrame, doc_id: str, field: str, text: str, filters: list[Column] = (), k: int = 20) -> DataFrame:
    """The k best rows matching any query term in one field: (doc_id, score).

    BM25 with k1 = 1.2 and no length norm. Term frequencies are counted inside each row, so
    the only thing that moves is one row of document frequencies and the k best per task.
    Filters restrict the answer, not the statistics.
    """
    terms = query_terms(docs.sparkSession, text)
    if not terms:
        return docs.select(doc_id, F.lit(0.0).alias("score")).limit(0)
    none = F.array().cast("array<array<int>>")

    def frequencies(hits: Column) -> Column:
        tf = F.transform(F.array(*[F.lit(t) for t in terms]), lambda q: F.size(F.filter(hits, lambda t: t == q)))
        return F.when(F.size(hits) > 0, F.array(tf)).otherwise(none)

    hits = F.filter(tx.analyze_french(F.col(field)), lambda t: t.isin(terms))
    wanted = F.lit(True)
    for f in filters:
        wanted = wanted & f
    # the analysis runs once: both passes below read the few numbers of the matching rows
    counted = write_once(docs.select(doc_id, wanted.alias("_wanted"), F.explode(tx.bind(hits, frequencies)).alias("_tf")))
    stats = counted.agg(F.array(*[F.count_if(F.get("_tf", F.lit(i)) > 0) for i in range(len(terms))]).alias("df"))
    stats = stats.withColumn("n", docs.select(F.count(field)).scalar())
    frozen = stats.select(F.struct("n", "df")).scalar()
    scored = counted.filter("_wanted").withColumn("_s", frozen)
    score = F.lit(0.0)
    for i in range(len(terms)):
        n_with = F.get(F.col("_s.df"), F.lit(i))
        idf = F.log(F.lit(1.0) + (F.col("_s.n") - n_with + 0.5) / (n_with + 0.5))
        f = F.get("_tf", F.lit(i))
        score = score + idf * 2.2 * f / (f + 1.2)
    return scored.select(doc_id, F.round(score, 6).alias("score")).orderBy(F.desc("score"), doc_id).limit(k)


def match_all(docs: DataFrame, doc_id: str, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Number of documents, and a page of the first n."""
    return docs.agg(F.count("*").alias("n_docs")), docs.orderBy(doc_id).limit(n)
