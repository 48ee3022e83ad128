"""Projection, filter, text, arithmetic, vector and markup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import markup as mk
from ..functions import numeric as nm
from ..functions import stemming as sg
from ..functions import text as tx
from ..functions import vectors as vc
from ..functions import wordlists as wl
from ..operators import frames as fr
from ..operators import threads as th
from . import views as v
from .registry import query, quoted, sql_all, sql_list, sql_pattern, sql_steps

T, C, S, MD = v.THINGS, v.COMMENTS, v.SUBMISSIONS, v.MD_BODIES
JOINED = "joined AS (SELECT c.*, s.link_flair_text AS flair FROM comments c LEFT JOIN submissions s ON c.link_id = s.name)"


def joined(t):
    """Comments with the flair of their thread."""
    subm = v.submissions(t).select(F.col("name").alias("link_id"), F.col("link_flair_text").alias("flair"))
    return th.lookup(v.comments(t), subm, "link_id", "name")


# Projections ----------------------------------------------------------------------------

@query("prj1_backfill_name", v.with_views(T) + """
SELECT id, coalesce(given_name, CASE WHEN is_comment THEN 't1_' ELSE 't3_' END || id) AS name FROM things""")
def _(t):
    base = v.things(t).select("id", F.col("given_name").alias("name"), "is_comment")
    both = fr.backfill_name(base.filter("is_comment"), "t1_").unionByName(
        fr.backfill_name(base.filter("not is_comment"), "t3_"))
    return both.select("id", "name")


@query("prj2_instant_from_utc", v.with_views(T) + """
SELECT name, created_utc::BIGINT AS epoch, epoch(make_timestamp(created_utc::BIGINT * 1000000))::BIGINT AS instant_s FROM things""")
def _(t):
    instant = tx.instant_from_utc(F.col("created_utc"))
    return v.things(t).select("name", F.col("created_utc").cast("long").alias("epoch"),
                              F.unix_seconds(instant).alias("instant_s"))


@query("prj3_iso_instant", v.with_views(T) + """
SELECT name, strftime(make_timestamp(created_utc::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created_iso FROM things""")
def _(t):
    return v.things(t).select("name", tx.iso_instant(tx.instant_from_utc(F.col("created_utc"))).alias("created_iso"))


@query("prj4_basic_submission_data", v.with_views(T, S) + """
SELECT created_utc, is_self, link_flair_text, name, num_comments, num_crossposts, permalink, score, title FROM submissions""")
def _(t):
    return fr.basic_submission_data(v.submissions(t))


@query("prj5_remove_nil_vals", v.with_views(T) + """
SELECT name, CASE WHEN ups IS NULL THEN 0 ELSE 2 END + CASE WHEN link_id IS NULL THEN 0 ELSE 1 END + 1::BIGINT AS n_keys,
  '{"name":"' || name || '"' || coalesce(',"ups":' || ups || ',"downs":' || downs, '')
  || coalesce(',"link_id":"' || link_id || '"', '') || '}' AS doc FROM things""")
def _(t):
    doc = fr.json_without_nulls("name", "ups", "downs", "link_id")
    return v.things(t).select("name", F.size(F.json_object_keys(doc)).cast("long").alias("n_keys"), doc.alias("doc"))


@query("prj6_rename_keys", v.with_views(T) + "SELECT id AS reddit_id, name AS reddit_name, score FROM things")
def _(t):
    return fr.rename_keys(v.things(t).select("id", "name", "score"),
                          {"id": "reddit_id", "name": "reddit_name", "absent": "nothing"})


@query("prj7_add_columns", v.with_views(T) + """
SELECT name, score, score * 2 AS double_score, author || ':' || name AS label FROM things""")
def _(t):
    return fr.add_columns(v.things(t).select("name", "score", "author"), {
        "double_score": F.col("score") * 2,
        "label": F.concat_ws(":", "author", "name"),
    }).drop("author")


@query("prj8_extract_column", v.with_views(T) + "SELECT title FROM things")
def _(t):
    return fr.extract_column(v.things(t), "title")


@query("prj10_is_post", v.with_views(T) + """
SELECT name, parent_id, coalesce(starts_with(parent_id, 't3_'), false) AS parent_is_post, starts_with(name, 't3_') AS is_post FROM things""")
def _(t):
    return v.things(t).select("name", "parent_id", fr.is_post(F.col("parent_id")).alias("parent_is_post"),
                              fr.is_post(F.col("name")).alias("is_post"))


@query("prj11_vote_numbers", v.with_views(T) + """
SELECT name, votes[1] AS v_score, votes[2] AS v_ups, votes[3] AS v_downs FROM (SELECT name, [score, ups, downs] AS votes FROM things)""")
def _(t):
    df = v.things(t).select("name", fr.vote_numbers().alias("votes"))
    return df.select("name", F.get("votes", F.lit(0)).alias("v_score"), F.get("votes", F.lit(1)).alias("v_ups"),
                     F.get("votes", F.lit(2)).alias("v_downs"))


@query("prj12_common_search_fields", v.with_views(T) + """
SELECT name AS reddit_name, strftime(make_timestamp(created_utc::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS reddit_created,
  ups AS reddit_n_ups, downs AS reddit_n_downs, score AS reddit_score FROM things""")
def _(t):
    return v.things(t).select(*fr.common_search_fields())


# Filters --------------------------------------------------------------------------------

@query("flt1_comment_of_interest", v.with_views(T, C, S, JOINED) + f"""
SELECT name, flair FROM joined WHERE flair IN ({sql_list(wl.SOCIOPOLITICAL_FLAIRS)}) AND body <> '[deleted]'""")
def _(t):
    return joined(t).filter(fr.is_comment_of_interest(F.col("flair"), F.col("body"))).select("name", "flair")


@query("flt2_flairs_of_interest", v.with_views(T, C, S, JOINED) + f"""
SELECT name, flair FROM joined WHERE flair IN ({sql_list(wl.TOPIC_FLAIRS)})""")
def _(t):
    return joined(t).filter(F.col("flair").isin(wl.TOPIC_FLAIRS)).select("name", "flair")


@query("flt3_min_text_length", v.with_views(T) + f"""
SELECT name, coalesce(length({v.sql_raw('body')}), 0) AS n_body, length(title) + length(selftext) AS n_contents FROM things
WHERE length({v.sql_raw('body')}) >= 100 AND length(title) + length(selftext) >= 100""")
def _(t):
    df = v.with_raw_body(v.things(t)).withColumn("contents", F.array("title", "selftext"))
    df = df.filter(fr.long_enough(F.col("dgms_body_raw")) & fr.contents_long_enough(F.col("contents")))
    return df.select("name", F.length("dgms_body_raw").cast("long").alias("n_body"),
                     (F.length("title") + F.length("selftext")).cast("long").alias("n_contents"))


@query("flt4_created_since", v.with_views(T) + "SELECT name, created_utc FROM things WHERE created_utc::BIGINT >= 1536192000")
def _(t):
    return v.things(t).filter(fr.created_since(F.col("created_utc"))).select("name", "created_utc")


@query("flt5_short_live_comments", v.with_views(T, C) + """
SELECT name, length(body) AS n_chars FROM comments WHERE body <> '[deleted]' AND length(body) <= 500""")
def _(t):
    return v.comments(t).filter(fr.short_and_live(F.col("body"))).select(
        "name", F.length("body").cast("long").alias("n_chars"))


@query("flt6_missing_permalink", v.with_views(T, C) + """
SELECT name, link_id FROM comments WHERE permalink IS NULL AND body <> '[deleted]'""")
def _(t):
    return v.comments(t).filter(fr.missing_permalink(F.col("permalink"), F.col("body"))).select("name", "link_id")


def sql_heuristic(raw: str) -> str:
    text = v.sql_fold(raw)
    tests = [f"contains({text}, {v.sql_fold(sql_list([x]))})" for x in wl.PRAISE_LITERALS]
    tests += [f"regexp_matches({text}, {sql_pattern(p)})" for p in wl.PRAISE_PATTERNS]
    return f"coalesce(length({text}) < 2000 AND ({' OR '.join(tests)}), false)"


RAW = f"raw AS (SELECT *, {v.sql_raw('body')} AS dgms_body_raw FROM joined)"
HEUR = f"heur AS (SELECT *, {sql_heuristic('dgms_body_raw')} AS h FROM raw)"


@query("flt7_heuristic_positive", v.with_views(T, C, S, JOINED, RAW, HEUR) + "SELECT name, h FROM heur")
def _(t):
    df = v.with_raw_body(joined(t))
    return df.select("name", fr.heuristic_positive(F.col("dgms_body_raw")).alias("h"))


@query("flt8_recurring_negatives", v.with_views(T, C, S, JOINED, RAW) + """
SELECT coalesce(regexp_matches(lower(dgms_body_raw), '^\\s*source\\s*\\?\\s*$'), false) AS asks_source,
  coalesce(contains(lower(dgms_body_raw), 'ce commentaire a été supprimé'), false) AS removal, count(*) AS n
FROM raw GROUP BY 1, 2""")
def _(t):
    raw = F.col("dgms_body_raw")
    return v.with_raw_body(joined(t)).groupBy(
        fr.asks_source_only(raw).alias("asks_source"), fr.removal_notice(raw).alias("removal")
    ).agg(F.count("*").alias("n"))


@query("flt9_non_null_keys", v.with_views(T) + """
SELECT name, link_id FROM things WHERE link_id IS NOT NULL AND created_utc IS NOT NULL""")
def _(t):
    return v.things(t).filter(F.col("link_id").isNotNull() & F.col("created_utc").isNotNull()).select("name", "link_id")


# Text -----------------------------------------------------------------------------------

@query("txt1_strip_accents", f"SELECT doc_id, {v.sql_fold('text')} AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.fold(F.col("text")).alias("folded"))


WORDS = f"words AS (SELECT doc_id, lang, source, unnest({sql_all('text', tx.WORD)}) AS word FROM documents)"


def words(t):
    return t.documents.select("doc_id", "lang", "source", F.explode(tx.split_words(F.col("text"))).alias("word"))


STOP = sql_list(wl.FRENCH_STOPWORDS)
NORM = f"regexp_replace({v.sql_fold('word')}, '[^A-Za-z0-9_]', '', 'g')"


@query("txt2_normalize_term", f"""WITH {WORDS}, norm AS (SELECT {NORM} AS term FROM words)
SELECT CASE WHEN term = '' OR term IN ({STOP}) THEN NULL ELSE term END AS term, count(*) AS n FROM norm GROUP BY 1""")
def _(t):
    return words(t).groupBy(tx.normalize_term(F.col("word")).alias("term")).agg(F.count("*").alias("n"))


@query("txt3_drop_stop_words", f"""
SELECT doc_id, len(list_filter({sql_all('lower(text)', tx.WORD)}, lambda w: w NOT IN ({STOP}))) AS n_kept FROM documents""")
def _(t):
    kept = tx.drop_stop_words(tx.split_words(F.lower("text")))
    return t.documents.select("doc_id", F.size(kept).cast("long").alias("n_kept"))


@query("txt4_split_words", f"""
SELECT doc_id, array_to_string({sql_all('text', tx.WORD)}, ' ') AS tokens, len({sql_all('text', tx.WORD)}) AS n FROM documents""")
def _(t):
    df = t.documents.select("doc_id", tx.split_words(F.col("text")).alias("w"))
    return df.select("doc_id", F.array_join("w", " ").alias("tokens"), F.size("w").cast("long").alias("n"))


def sql_analyze(expr: str) -> str:
    bare = f"list_transform({sql_all(f'lower({expr})', tx.WORD_APOSTROPHE)}, lambda w: regexp_replace(w, {sql_pattern(tx.ELISION)}, ''))"
    kept = f"list_filter({bare}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}_]') AND w NOT IN ({STOP}))"
    return sql_stems(kept)


def sql_stems(words: str) -> str:
    def ends(suffix: str, longer_than: int) -> str:
        return f"length(w) > {longer_than} AND ends_with(w, {quoted(suffix)})"

    def cut(letters: int, then: str = "") -> str:
        return f"left(w, length(w) - {letters}) || {quoted(then)}"

    rules = " ".join(f"WHEN {ends(s, n)} THEN {cut(len(s), r)}" for s, n, r in sg.SUFFIXES)
    flat = f"translate(w, {quoted(sg.ACCENTED)}, {quoted(sg.PLAIN)})"
    for step in (
        f"CASE WHEN {ends('aux', 5)} AND NOT ends_with(w, 'eaux') THEN {cut(2, 'l')} WHEN {ends('x', 3)} OR {ends('s', 3)} THEN {cut(1)} ELSE w END",
        f"CASE {rules} ELSE w END",
        f"""CASE WHEN length(w) > 4 THEN array_to_string(list_filter(string_split({flat}, ''),
          lambda c, i: i = 1 OR c <> substr({flat}, (i - 1)::BIGINT, 1) OR NOT regexp_matches(c, '\\p{{L}}')), '') ELSE w END""",
        f"CASE WHEN {ends('ie', 4)} THEN {cut(2)} ELSE w END",
        f"CASE WHEN {ends('er', 4)} THEN {cut(2)} WHEN {ends('r', 4)} OR {ends('e', 4)} THEN {cut(1)} ELSE w END",
    ):
        words = f"list_transform({words}, lambda w: {step})"
    return words


@query("txt5_analyze_french", f"SELECT doc_id, array_to_string({sql_analyze('text')}, ' ') AS terms FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(tx.analyze_french(F.col("text")), " ").alias("terms"))


def sql_sentences(expr: str) -> str:
    return f"list_filter({sql_all(expr, tx.SENTENCE)}, lambda s: trim(s) <> '')"


@query("txt6_sentences", f"""
SELECT doc_id, pos, sentence FROM (SELECT doc_id, unnest({sql_sentences('text')}) AS sentence,
  unnest(range(len({sql_sentences('text')}))) AS pos FROM documents)""")
def _(t):
    df = t.documents.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    return df.withColumn("pos", F.col("pos").cast("long"))


@query("txt7_counts", f"""
SELECT doc_id, len({sql_sentences('text')}) AS n_sentences, len({sql_all('text', tx.WORD_OR_PUNCT)}) AS n_words FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.n_sentences(F.col("text")).alias("n_sentences"),
                              tx.n_words(F.col("text")).alias("n_words"))


def sql_ends(expr: str, n: int, m: int) -> str:
    return (f"CASE WHEN len({expr}) > {n + m} THEN list_concat(list_slice({expr}, 1, {n}), "
            f"list_slice({expr}, -{m}, -1)) ELSE {expr} END")


@query("txt8_first_and_last", f"""SELECT doc_id, array_to_string({sql_ends('w', 30, 30)}, ' ') AS zoned,
  array_to_string({sql_ends('s', 2, 2)}, '|') AS ends
FROM (SELECT doc_id, {sql_all('text', tx.WORD)} AS w, {sql_sentences('text')} AS s FROM documents)""")
def _(t):
    w, s = tx.split_words(F.col("text")), tx.sentences(F.col("text"))
    df = t.documents.select("doc_id", w.alias("w"), s.alias("s"))
    return df.select("doc_id", F.array_join(tx.take_first_and_last(F.col("w"), 30, 30), " ").alias("zoned"),
                     F.array_join(tx.take_first_and_last(F.col("s"), 2, 2), "|").alias("ends"))


def sql_ngrams(tokens: str) -> str:
    head = f"list_slice({tokens}, 1, 12)"
    parts = [f"list_transform(range(1, len({head}) - {n - 2}), lambda i: array_to_string(list_slice({head}, i, i + {n - 1}), ' '))"
             for n in (1, 2, 3)]
    return f"list_distinct(list_concat({', '.join(parts)}))"


@query("txt9_first_ngrams", f"""
SELECT doc_id, unnest({sql_ngrams('w')}) AS gram FROM (SELECT doc_id, {sql_all('lower(text)', tx.WORD)} AS w FROM documents)""")
def _(t):
    df = t.documents.select("doc_id", tx.split_words(F.lower("text")).alias("w"))
    return df.select("doc_id", F.explode(tx.first_ngrams(F.col("w"))).alias("gram"))


@query("txt10_bag_of_words", f"WITH {WORDS} SELECT doc_id, lower(word) AS token, count(*) AS n FROM words GROUP BY 1, 2")
def _(t):
    bag = tx.bag_of_words(tx.split_words(F.lower("text")))
    return t.documents.select("doc_id", F.explode(bag).alias("b")).select(
        "doc_id", F.col("b.term").alias("token"), F.col("b.tf").alias("n"))


def sql_hob(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE (1::BIGINT << (length(bin({n})) - 1)) END)"


def sql_text_features(label: str, expr: str) -> str:
    flags = [f"CASE WHEN regexp_matches({expr}, {sql_pattern(rx)}) THEN '`{label}` CONTAINS {name}' END"
             for name, rx in tx.TEXT_PROPERTIES]
    size = f"'`{label}`->length-h1b=' || {sql_hob(f'length({expr})::BIGINT')}"
    return (f"CASE WHEN {expr} IS NOT NULL THEN list_filter([{size}, {', '.join(flags)}], "
            f"lambda f: f IS NOT NULL) ELSE [] END")


def sql_int_features(label: str, n: str) -> str:
    return (f"CASE WHEN {n} IS NOT NULL THEN ['`{label}`->h1b=' || CASE WHEN {n} < 0 THEN '-' ELSE '+' END || "
            f"{sql_hob(f'abs({n})::BIGINT')}] ELSE [] END")


def sql_ts_features(label: str, epoch: str) -> str:
    return (f"CASE WHEN {epoch} IS NOT NULL THEN ['`{label}`->Y-M=' || "
            f"strftime(make_timestamp({epoch}::BIGINT * 1000000), '%Y-%m')] ELSE [] END")


@query("txt11_textual_features", f"SELECT doc_id, unnest({sql_text_features('text', 'text')}) AS feature FROM documents")
def _(t):
    return t.documents.select("doc_id", F.explode(tx.textual_features("text", F.col("text"))).alias("feature"))


@query("txt12_integer_features", v.with_views(T) + f"SELECT name, unnest({sql_int_features('score', 'score')}) AS feature FROM things")
def _(t):
    return v.things(t).select("name", F.explode(tx.integer_features("score", F.col("score"))).alias("feature"))


@query("txt13_timestamp_features", v.with_views(T) + f"""
SELECT name, unnest({sql_ts_features('created_utc', 'created_utc')}) AS feature FROM things""")
def _(t):
    return v.things(t).select("name", F.explode(tx.timestamp_features("created_utc", F.col("created_utc"))).alias("feature"))


@query("txt14_map_key_features", """
SELECT event_id, unnest(list_transform(map_keys(m), lambda k: 'KEY `' || k || '` ' || CASE WHEN m[k] IS NULL THEN 'F' ELSE 'T' END)) AS feature
FROM (SELECT event_id, from_json(props, '{"k": "BIGINT"}') AS p, MAP {'k': from_json(props, '{"k": "BIGINT"}').k} AS m FROM events)""")
def _(t):
    m = F.from_json("props", "map<string,bigint>")
    return t.events.select("event_id", F.explode(tx.map_key_features(m)).alias("feature"))


KEYS = ["id", "given_name", "name", "link_id", "parent_id", "is_comment", "author", "body", "title", "selftext", "link_flair_text",
        "created_utc", "score", "ups", "downs", "permalink", "subreddit", "is_self", "media_type", "depth",
        "link_flair_type", "num_comments", "num_crossposts", "num_reports"]
BOOLEAN_KEYS = ("is_comment", "is_self")


def sql_keys(names, bools=()):
    parts = [f"CASE WHEN {n} IS NOT NULL THEN 'KEY `{n}` ' || " +
             (f"CASE WHEN {n} THEN 'T' ELSE 'F' END" if n in bools else "'T'") + " END" for n in names]
    return f"list_filter([{', '.join(parts)}], lambda f: f IS NOT NULL)"


SQL_COMMENT_FEATURES = "list_distinct(list_concat(" + ", ".join([
    sql_keys(KEYS, BOOLEAN_KEYS), sql_int_features("score", "score"),
    sql_ts_features("created_utc", "created_utc"), sql_text_features("body", "body")]) + "))"
SQL_SUBMISSION_FEATURES = "list_distinct(list_concat(" + ", ".join([
    sql_keys(KEYS, BOOLEAN_KEYS), *[f"CASE WHEN {f} IS NOT NULL THEN ['`{f}`=' || {f}] ELSE [] END" for f in ft.SUBMISSION_VALUES],
    sql_text_features("title", "title"), sql_text_features("selftext", "selftext"),
    sql_ts_features("created_utc", "created_utc"),
    *[sql_int_features(f, f) for f in ft.SUBMISSION_COUNTS]]) + "))"


@query("txt15_comment_features", v.with_views(T, C, S) + f"""
SELECT name, unnest({SQL_COMMENT_FEATURES}) AS feature FROM comments
UNION ALL SELECT name, unnest({SQL_SUBMISSION_FEATURES}) AS feature FROM submissions""")
def _(t):
    comments, posts = v.comments(t), v.submissions(t)
    a = comments.select("name", F.explode(ft.comment_features(comments)).alias("feature"))
    return a.unionByName(posts.select("name", F.explode(ft.submission_features(posts)).alias("feature")))


@query("txt16_high_one_bit", f"SELECT doc_id, {sql_hob('n_chars')} AS bucket FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.high_one_bit(F.col("n_chars")).alias("bucket"))


@query("txt17_clean_special_characters", f"""
SELECT page_id, {sql_steps("url || ' ' || html", [(tx.SPECIAL_CHARACTERS, '')])} AS cleaned FROM pages""")
def _(t):
    return t.pages.select("page_id", tx.clean_special_characters(F.concat_ws(" ", "url", "html")).alias("cleaned"))


@query("txt18_non_empty_md", v.with_views(T) + f"SELECT name, {v.sql_non_empty('body')} AS body FROM things")
def _(t):
    return v.things(t).select("name", tx.non_empty_md(F.col("body")).alias("body"))


@query("txt19_submission_text", v.with_views(T, S) + f"""
SELECT name, concat_ws(chr(10) || chr(10), title, {v.sql_non_empty('selftext')}) AS corpus_text FROM submissions""")
def _(t):
    text = F.concat_ws("\n\n", "title", tx.non_empty_md(F.col("selftext")))
    return v.submissions(t).select("name", text.alias("corpus_text"))


# Arithmetic -----------------------------------------------------------------------------

@query("mth1_log2_n_words", f"""
SELECT doc_id, round(log2(len({sql_all('text', tx.WORD)}) + 1.0::DOUBLE), 6) AS log2_n_words FROM documents""")
def _(t):
    n = F.size(tx.split_words(F.col("text")))
    return t.documents.select("doc_id", F.round(nm.log2_n_words(n), 6).alias("log2_n_words"))


def sql_xlnx(x: str) -> str:
    return f"(CASE WHEN {x} <= 0 OR {x} = 1 THEN 0.0::DOUBLE ELSE {x} * ln({x}) END)"


def sql_entropy(p: str) -> str:
    return f"(({sql_xlnx(p)} + {sql_xlnx(f'(1.0::DOUBLE - {p})')}) / ln(0.5::DOUBLE))"


@query("mth2_entropy", f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round({sql_xlnx('l_discount')}, 6) AS xlnx, round({sql_entropy('l_discount')}, 6) AS h2 FROM lineitem""")
def _(t):
    d = F.col("l_discount")
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"),
                             F.round(nm.xlnx(d), 6).alias("xlnx"), F.round(nm.binary_entropy(d), 6).alias("h2"))


@query("mth3_score_ratio", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_extendedprice / (o_totalprice + 10.0), 6) AS score_ratio
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 0""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("o_totalprice > 0")
    ratio = nm.smoothed_ratio(F.col("l_extendedprice"), F.col("o_totalprice"))
    return j.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"),
                    F.round(ratio, 6).alias("score_ratio"))


@query("mth4_keyed_uniform", f"SELECT doc_id, {v.sql_uniform('doc_id::VARCHAR')} AS u FROM documents")
def _(t):
    return t.documents.select("doc_id", nm.keyed_uniform(F.col("doc_id").cast("string")).alias("u"))


@query("mth5_decimal_bucket", "SELECT event_id, floor(value * 10) / 10.0::DOUBLE AS bucket FROM events")
def _(t):
    return t.events.select("event_id", nm.decimal_bucket(F.col("value")).alias("bucket"))


@query("vec1_algebra", """
SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm,
  round(list_sum(list_transform(e, lambda x: 2 * x)), 6) AS doubled_sum,
  round(list_sum(list_transform(e, lambda x: x + 1.0)) / 2, 6) AS mean_with_ones,
  round(list_sum(e), 6) AS dot_ones,
  round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS unit_0
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def _(t):
    ones = vc.constant(64, 1.0)
    df = t.embeddings.select("vec_id", vc.as_doubles(F.col("embedding")).alias("e"))
    e = F.col("e")
    return df.select(
        "vec_id", F.round(vc.norm(e), 6).alias("norm"),
        F.round(vc.total(vc.scale(e, 2.0)), 6).alias("doubled_sum"),
        F.round(vc.total(vc.mean_of([e, ones])), 6).alias("mean_with_ones"),
        F.round(vc.dot(e, ones), 6).alias("dot_ones"),
        F.round(F.get(vc.unit(e), F.lit(0)), 6).alias("unit_0"))


@query("vec2_cosine", """
WITH c AS (SELECT label, list(s ORDER BY i) AS centre FROM (
  SELECT label, i, sum(x) AS s FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centre), 6) AS sim FROM embeddings JOIN c USING (label)""")
def _(t):
    e = vc.as_doubles(F.col("embedding"))
    centres = t.embeddings.groupBy("label").agg(vc.sum_per_dim(e, 64).alias("centre"))
    return t.embeddings.join(centres, "label").select("vec_id", F.round(vc.cosine(e, F.col("centre")), 6).alias("sim"))


# Markdown and HTML ----------------------------------------------------------------------

@query("mdn1_raw_text", v.with_views(MD) + f"""
SELECT page_id, {v.sql_raw('body')} AS kept_clean, {v.sql_raw('body', False, False)} AS kept_all FROM md""")
def _(t):
    b = F.col("body")
    return v.md_bodies(t).select("page_id", mk.raw_text(b).alias("kept_clean"), mk.raw_text(b, False, False).alias("kept_all"))


@query("mdn2_trim_markdown", v.with_views(T) + f"""
SELECT name, CASE WHEN body <> '[deleted]' THEN coalesce({v.sql_raw('body', False, False)}, '') END AS trimmed FROM things""")
def _(t):
    return v.things(t).select("name", mk.trim_markdown(F.col("body")).alias("trimmed"))


def sql_links(md: str) -> str:
    rest = sql_steps(md, [(mk.MD_LINK_WHOLE, " ")])
    return f"list_concat({sql_all(md, mk.MD_LINK, 1)}, {sql_all(rest, mk.BARE_URL)})"


@query("mdn3_hyperlinks", v.with_views(MD, "x AS (SELECT page_id, url || chr(10) || body AS body FROM md JOIN pages USING (page_id))") + f"""
SELECT page_id, unnest({sql_links('body')}) AS link FROM x""")
def _(t):
    df = t.pages.select("page_id", F.concat("url", F.lit("\n"), mk.html_to_markdown(F.col("html"))).alias("body"))
    return df.select("page_id", F.explode(mk.hyperlinks(F.col("body"))).alias("link"))


@query("mdn4_n_hyperlinks", v.with_views(T) + f"""
SELECT name, coalesce(len({sql_links(f"({v.sql_non_empty('body')})")}), 0) AS n_hyperlinks FROM things""")
def _(t):
    return v.things(t).select("name", mk.n_hyperlinks(mk.hyperlinks(F.col("body"))).alias("n_hyperlinks"))


def sql_count(expr: str, pattern: str) -> str:
    return f"len({sql_all(expr, pattern)})"


@query("mdn5_count_quotes", v.with_views(T, MD) + f"""
SELECT 'page_' || page_id AS name, coalesce({sql_count('body', mk.QUOTE_RUN)}, 0) AS n_quotes FROM md
UNION ALL SELECT name, coalesce({sql_count(f"({v.sql_non_empty('body')})", mk.QUOTE_RUN)}, 0) FROM things""")
def _(t):
    pages = v.md_bodies(t).select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("name"), "body")
    return pages.unionByName(v.things(t).select("name", "body")).select(
        "name", mk.count_quotes(F.col("body")).alias("n_quotes"))


def sql_formatting(md: str) -> str:
    return "(" + " + ".join(sql_count(md, p) for p in mk.FORMATTING) + ")"


@query("mdn6_formatting_count", v.with_views(MD) + f"""
SELECT page_id, {sql_formatting('body')} AS n_md,
  len(list_filter({sql_all(sql_steps('html', [(mk.HTML_NOISE, '')]), mk.OPEN_TAG, 1)}, lambda x: x IN ({sql_list(mk.FORMATTING_TAGS)}))) AS n_html
FROM md JOIN pages USING (page_id)""")
def _(t):
    return t.pages.select("page_id", mk.formatting_count(mk.html_to_markdown(F.col("html"))).alias("n_md"),
                          mk.html_formatting_count(F.col("html")).alias("n_html"))


@query("mdn7_quote_paragraphs", v.with_views(T) + f"""
SELECT name, pos, regexp_matches(block, {sql_pattern(mk.QUOTE_START)}) AS is_quote FROM (
  SELECT name, unnest(b) AS block, unnest(range(len(b))) AS pos
  FROM (SELECT name, list_filter(regexp_split_to_array(body, '\\n{{2,}}'), lambda x: x <> '') AS b FROM things))""")
def _(t):
    df = v.things(t).select("name", F.posexplode(mk.blocks(F.col("body"))).alias("pos", "block"))
    return df.select("name", F.col("pos").cast("long").alias("pos"), mk.is_quote_paragraph(F.col("block")).alias("is_quote"))


@query("mdn8_tag_census", f"""
SELECT tag, count(*) AS n FROM (SELECT unnest({sql_all(sql_steps('html', [(mk.HTML_NOISE, '')]), mk.OPEN_TAG, 1)}) AS tag FROM pages) GROUP BY 1""")
def _(t):
    tags = t.pages.select(F.explode(mk.html_tags(F.col("html"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


@query("mdn9_tag_elements", f"""SELECT page_id, tag, content FROM (
  SELECT page_id, 'h1' AS tag, unnest({sql_all(sql_steps('html', [(mk.HTML_NOISE, '')]), r'(?s)<h1(?:\s[^>]*)?>(.*?)</h1>', 1)}) AS content FROM pages
  UNION ALL SELECT page_id, 'a', unnest({sql_all(sql_steps('html', [(mk.HTML_NOISE, '')]), r'(?s)<a(?:\s[^>]*)?>(.*?)</a>', 1)}) FROM pages)""")
def _(t):
    def of(tag):
        return t.pages.select("page_id", F.lit(tag).alias("tag"), F.explode(mk.html_elements(F.col("html"), tag)).alias("content"))
    return of("h1").unionByName(of("a"))


BUNDLE = ["dgms_body_raw", "dgms_n_sentences", "dgms_n_words", "dgms_n_hyperlinks", "dgms_n_quotes", "dgms_n_formatting"]


def sql_bundle(md: str, raw: str) -> str:
    ok = f"({v.sql_non_empty(md)})"
    return f"""{raw} AS dgms_body_raw, len({sql_sentences(raw)}) AS dgms_n_sentences,
  len({sql_all(raw, tx.WORD_OR_PUNCT)}) AS dgms_n_words, coalesce(len({sql_links(ok)}), 0) AS dgms_n_hyperlinks,
  coalesce({sql_count(ok, mk.QUOTE_RUN)}, 0) AS dgms_n_quotes, {sql_formatting(ok)} AS dgms_n_formatting"""


@query("mdn10_text_features", v.with_views(T) + f"""
SELECT name, {sql_bundle('body', 'raw')} FROM (SELECT name, body, {v.sql_raw('body')} AS raw FROM things)""")
def _(t):
    return mk.with_text_features(v.things(t).select("name", "body"), "body", BUNDLE).drop("body")
