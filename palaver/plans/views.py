"""Threads, comments, submissions and Markdown bodies derived from the test tables.

A conversation is a thread: turn 0 is the submission, each later turn a comment on the
turn before it. Assistant turns carry Markdown (a quote, bold text, a link).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup as mk
from ..functions import text as tx
from ..functions import wordlists as wl
from .registry import Tables, quoted, sql_list, sql_steps

FLAIRS = ["Politique", "Société", "Économie", "Science", "Écologie", "Culture"]
EPOCH = 1_536_000_000
FIRST_SENTENCE = r"^[^.!?\n]*"


def things(t: Tables) -> DataFrame:
    """All nodes of all threads, submissions and comments, in one frame."""
    c = t.conversations
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    conv_s, turn_s = conv.cast("string"), turn.cast("string")
    head = F.regexp_extract(text, FIRST_SENTENCE, 0)
    link = F.concat(F.lit("https://www.example.org/c/"), conv_s, F.lit("/"), turn_s)
    score = (F.length(text) % 97 - 20).cast("long")
    is_comment = turn > 0
    body = (
        F.when(F.length(text) < 40, F.lit("[deleted]"))
        .when(~is_comment, text)
        .when(
            F.col("role") == "assistant",
            F.concat(
                F.lit("&gt; "), head, F.lit("\n\n"), text, F.lit("\n\n**"), F.col("role"),
                F.lit("** [source]("), link, F.lit(")"),
            ),
        )
        .when(F.length(text) % 97 > 60, F.concat(F.lit("Merci, très intéressant. "), text))
        .when(F.length(text) < 90, F.lit(" Source ?"))
        .otherwise(text)
    )
    node_id = F.when(is_comment, F.concat(conv_s, F.lit("_"), turn_s)).otherwise(conv_s)
    name = F.concat(F.when(is_comment, "t1_").otherwise("t3_"), node_id)
    subm = F.concat(F.lit("t3_"), conv_s)
    parent = F.when(turn == 1, subm).when(
        turn > 1, F.concat(F.lit("t1_"), conv_s, F.lit("_"), (turn - 1).cast("string"))
    )
    flair = F.get(F.array(*[F.lit(f) for f in FLAIRS]), (conv % len(FLAIRS)).cast("int"))
    user = F.col("role") == "user"
    return c.select(
        node_id.alias("id"),
        F.when(user, name).alias("given_name"),
        name.alias("name"),
        F.when(is_comment, subm).alias("link_id"),
        parent.alias("parent_id"),
        is_comment.alias("is_comment"),
        F.col("role").alias("author"),
        body.alias("body"),
        head.alias("title"),
        F.substring(text, F.length(head) + 2, F.length(text)).alias("selftext"),
        F.when(~is_comment, flair).alias("link_flair_text"),
        (F.lit(EPOCH) + conv * 20000 + turn * 60).cast("string").alias("created_utc"),
        score.alias("score"),
        F.when(user, F.greatest(score, F.lit(0))).alias("ups"),
        F.when(user, F.greatest(-score, F.lit(0))).alias("downs"),
        F.when(~is_comment | user, F.concat(F.lit("/c/"), conv_s, F.lit("/t/"))).alias("permalink"),
        F.lit("france").alias("subreddit"),
        (~is_comment & (F.length(text) > 300)).alias("is_self"),
        F.when(~is_comment & (F.length(text) > 300), F.lit("rich")).alias("media_type"),
        turn.alias("depth"),
        F.when(~is_comment, F.when(conv % 2 == 0, "richtext").otherwise("text")).alias("link_flair_type"),
        F.when(~is_comment, conv % 13).alias("num_comments"),
        F.when(~is_comment, conv % 3).alias("num_crossposts"),
        F.when(~is_comment & (conv % 5 == 0), conv % 2).alias("num_reports"),
    )


THINGS = f"""things AS (
  SELECT *, CASE WHEN author = 'user' THEN name END AS given_name,
         CASE WHEN author = 'user' THEN greatest(score, 0) END AS ups,
         CASE WHEN author = 'user' THEN greatest(-score, 0) END AS downs
  FROM (
    SELECT CASE WHEN turn > 0 THEN conv_id || '_' || turn ELSE conv_id::VARCHAR END AS id,
      CASE WHEN turn > 0 THEN 't1_' || conv_id || '_' || turn ELSE 't3_' || conv_id END AS name,
      CASE WHEN turn > 0 THEN 't3_' || conv_id END AS link_id,
      CASE WHEN turn = 1 THEN 't3_' || conv_id
           WHEN turn > 1 THEN 't1_' || conv_id || '_' || (turn - 1) END AS parent_id,
      turn > 0 AS is_comment, role AS author,
      CASE WHEN length(text) < 40 THEN '[deleted]'
           WHEN turn = 0 THEN text
           WHEN role = 'assistant' THEN '&gt; ' || regexp_extract(text, {quoted(FIRST_SENTENCE)}) || chr(10) || chr(10)
             || text || chr(10) || chr(10) || '**' || role || '** [source](https://www.example.org/c/' || conv_id || '/' || turn || ')'
           WHEN length(text) % 97 > 60 THEN 'Merci, très intéressant. ' || text
           WHEN length(text) < 90 THEN ' Source ?'
           ELSE text END AS body,
      regexp_extract(text, {quoted(FIRST_SENTENCE)}) AS title,
      substr(text, length(regexp_extract(text, {quoted(FIRST_SENTENCE)})) + 2) AS selftext,
      CASE WHEN turn = 0 THEN list_extract([{sql_list(FLAIRS)}], (conv_id % {len(FLAIRS)})::INT + 1) END AS link_flair_text,
      ({EPOCH} + conv_id * 20000 + turn * 60)::VARCHAR AS created_utc,
      (length(text) % 97 - 20)::BIGINT AS score,
      CASE WHEN turn = 0 OR role = 'user' THEN '/c/' || conv_id || '/t/' END AS permalink,
      'france' AS subreddit,
      turn = 0 AND length(text) > 300 AS is_self,
      CASE WHEN turn = 0 AND length(text) > 300 THEN 'rich' END AS media_type,
      turn AS depth,
      CASE WHEN turn = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'richtext' ELSE 'text' END END AS link_flair_type,
      CASE WHEN turn = 0 THEN conv_id % 13 END AS num_comments,
      CASE WHEN turn = 0 THEN conv_id % 3 END AS num_crossposts,
      CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN conv_id % 2 END AS num_reports
    FROM conversations))"""
COMMENTS = "comments AS (SELECT * FROM things WHERE is_comment)"
SUBMISSIONS = "submissions AS (SELECT * FROM things WHERE NOT is_comment)"


def comments(t: Tables) -> DataFrame:
    return things(t).filter("is_comment")


def submissions(t: Tables) -> DataFrame:
    return things(t).filter(~F.col("is_comment"))


def with_raw_body(df: DataFrame, col: str = "body") -> DataFrame:
    return df.withColumn("dgms_body_raw", mk.raw_text(F.col(col)))


def sql_non_empty(expr: str) -> str:
    return f"CASE WHEN {expr} NOT IN ({sql_list(wl.NO_TEXT)}) AND regexp_matches({expr}, '\\S') THEN {expr} END"


def sql_raw(expr: str, remove_quotes: bool = True, remove_code: bool = True) -> str:
    """SQL form of markup.raw_text."""
    return sql_steps(f"({sql_non_empty(expr)})", mk.raw_text_steps(remove_quotes, remove_code))


def sql_fold(expr: str) -> str:
    return f"translate(lower({expr}), '{tx.ACCENTED}', '{tx.PLAIN}')"


def sql_uniform(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT / 4294967296.0)"


MD_BODIES = f"""md AS (SELECT page_id, {sql_steps('html', mk.HTML_TO_MD)} AS body FROM pages)"""


def md_bodies(t: Tables) -> DataFrame:
    """Markdown bodies derived from the web pages."""
    return t.pages.select("page_id", mk.html_to_markdown(F.col("html")).alias("body"))


def with_views(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
