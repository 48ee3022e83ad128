"""Classifier feature, training, scoring and evaluation queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import markup as mk
from ..functions import numeric as nm
from ..functions import text as tx
from ..functions import vectors as vc
from ..functions import wordlists as wl
from ..operators import classify as cl
from ..operators import evaluate as ev
from ..operators import frames as fr
from ..operators import linear as ln
from ..operators import threads as th
from ..session import write_once
from . import views as v
from .registry import query, sql_all, sql_list
from .stat_queries import SCORED, scored
from .text_queries import HEUR, JOINED, RAW, joined, sql_count, sql_ends, sql_links

T, C, S = v.THINGS, v.COMMENTS, v.SUBMISSIONS


def replies(t):
    """Comments with the flair of their thread and the body of what they answer."""
    parents = v.things(t).select(F.col("name").alias("parent_id"), F.col("body").alias("parent_body"))
    return th.lookup(joined(t), parents, "parent_id", "name")


def name_labels(t):
    """A label for most comments, from the label of the thread's document."""
    thread = F.concat(F.lit("t3_"), F.col("doc_id").cast("string")).alias("link_id")
    labels = t.labels.select(thread, F.col("quality").cast("double").alias("quality"))
    out = v.comments(t).join(labels, "link_id", "left")
    out = out.filter(F.col("quality").isNotNull() | (nm.keyed_uniform(F.col("link_id")) >= 0.05))
    return out.select("name", F.coalesce("quality", F.lit(0.0)).alias("label"))


REPLIES = "replies AS (SELECT h.*, p.body AS parent_body FROM heur h LEFT JOIN things p ON h.parent_id = p.name)"
LABELS = f"""name_labels AS (SELECT name, coalesce(quality, 0)::DOUBLE AS label FROM comments LEFT JOIN labels ON link_id = 't3_' || doc_id
  WHERE quality IS NOT NULL OR {v.sql_uniform('link_id')} >= 0.05)"""
BASE = (T, C, S, JOINED, RAW, HEUR, REPLIES)


def _features(prefix: str, name: str, md: str) -> str:
    ok = f"({v.sql_non_empty(md)})"
    words = f"coalesce({sql_all(v.sql_raw(md), tx.WORD)}, [])"
    return f"""coalesce(starts_with({name}, 't3_'), false) AS {prefix}_is_post, len({words}) AS {prefix}_n_words,
  coalesce({sql_count(ok, mk.QUOTE_RUN)}, 0) AS {prefix}_n_quotes, coalesce(len({sql_links(ok)}), 0) AS {prefix}_n_links,
  list_transform({sql_ends(words, 30, 30)}, lambda w: {v.sql_fold('w')}) AS {prefix}_tokens"""


FEATS = f"feats AS (SELECT *, {_features('c', 'name', 'body')}, {_features('p', 'parent_id', 'parent_body')} FROM replies)"
FEAT_COLS = ", ".join(f"{p}_{f}" for p in "cp" for f in ("is_post", "n_words", "n_quotes", "n_links"))
TOKEN_COLS = "array_to_string(c_tokens, ' ') AS c_tokens, array_to_string(p_tokens, ' ') AS p_tokens"


def flat_features(df, *extra):
    cols = []
    for p, side in (("c", "dgms_comment"), ("p", "dgms_parent")):
        cols += [F.col(f"{side}.is_post").alias(f"{p}_is_post"), F.col(f"{side}.n_words").alias(f"{p}_n_words"),
                 F.col(f"{side}.dgms_n_quotes").alias(f"{p}_n_quotes"), F.col(f"{side}.dgms_n_hyperlinks").alias(f"{p}_n_links"),
                 F.array_join(f"{side}.zoned_tokens", " ").alias(f"{p}_tokens")]
    return df.select("name", *extra, *cols)


@query("cls1_reply_features", v.with_views(*BASE, FEATS) + f"SELECT name, {FEAT_COLS}, {TOKEN_COLS} FROM feats")
def _(t):
    return flat_features(cl.with_features(replies(t)))


@query("cls2_labelled_features", v.with_views(*BASE, FEATS, LABELS, f"""
chosen AS (SELECT f.*, l.label, f.created_utc::BIGINT AS pos FROM feats f LEFT JOIN name_labels l ON f.name = l.name
  WHERE flair IN ({sql_list(wl.SOCIOPOLITICAL_FLAIRS)}) AND body <> '[deleted]' AND h
  AND NOT ({v.sql_uniform('f.name')} < 0.1 AND f.name IN (SELECT name FROM name_labels)))""") + f"""
SELECT name, label AS dgms_h2_label, {FEAT_COLS}, {TOKEN_COLS} FROM chosen
WHERE pos < coalesce((SELECT min(pos) FROM chosen WHERE label IS NULL), 9223372036854775807)""")
def _(t):
    rows = v.with_raw_body(replies(t)).withColumn("pos", F.col("created_utc").cast("long"))
    first = rows.filter(nm.keyed_uniform(F.col("name")) < 0.1)
    return flat_features(cl.labelled_features(rows, name_labels(t), first, "pos"), "dgms_h2_label")


def training_rows(t):
    rows = cl.with_features(replies(t)).join(name_labels(t), "name").withColumnRenamed("label", "dgms_h2_label")
    # several fits read these rows: write them once
    return write_once(rows.select("name", "dgms_comment", "dgms_parent", "dgms_h2_label"))


def _norms() -> str:
    cols = []
    for p, side in (("c", "dgms_comment"), ("p", "dgms_parent")):
        cols += [f"CASE WHEN {p}_is_post OR {p}_n_words + {p}_n_links + {p}_n_quotes > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS {side}_nw_norm",
                 f"CASE WHEN len({p}_tokens) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS {side}_bow_norm"]
    return ", ".join(cols)


@query("cls3_feature_matrix", v.with_views(*BASE, FEATS, LABELS) + f"SELECT name, {_norms()} FROM feats JOIN name_labels USING (name)")
def _(t):
    rows = training_rows(t)
    tokens = rows.select(F.explode(F.concat(*[F.col(s)["zoned_tokens"] for s in cl.SIDES])).alias("w"))
    _, m = cl.feature_matrix(rows, max(1, tokens.distinct().count()))  # every token is in the vocabulary
    blocks = [F.round(vc.ml_norm(F.col(f"{side}_{b}")), 6).alias(f"{side}_{b}_norm") for side in cl.SIDES for b in ("nw", "bow")]
    return m.select("name", *blocks)


TRAINING = ("training AS (SELECT c.name, label FROM comments c JOIN name_labels USING (name))",)


@query("cls4_train_linear", v.with_views(*BASE, LABELS, *TRAINING) + """
SELECT count(*) AS n_rows, 0::BIGINT AS n_other_scores, true AS better_than_zero FROM training""")
def _(t):
    """Rows trained on, rows whose score by the coefficient table differs from the model's, and whether the loss fell."""
    rows = training_rows(t)
    pipe, m = cl.feature_matrix(rows)
    m = write_once(m.select(*rows.columns, "label", "weight", "features"))  # training, scores and loss read the vectors; counted into them once
    svc = cl.train_linear(m)
    coefs, intercept = cl.coefficient_table(t.spark, pipe, svc)
    raw = F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("raw")
    both = cl.linear_scores(svc.transform(m), "name", coefs, intercept).select("h2_score", raw)
    better = cl.hinge_loss(m, svc) < 1.0
    other = F.count_if(F.abs(F.col("raw") - F.col("h2_score")) > 1e-6)
    return both.agg(F.count("*").alias("n_rows"), other.alias("n_other_scores")).withColumn("better_than_zero", F.lit(better))


@query("cls5_train_repeatedly", v.with_views(*BASE, LABELS, *TRAINING) + """
SELECT count(*) AS n_rows, 30::BIGINT AS n_fits, true AS best_is_largest FROM training""")
def _(t):
    """Rows of the matrix, number of fits, and whether the model kept has the largest accuracy of all."""
    _, m = cl.feature_matrix(training_rows(t))
    best, scores = cl.train_repeatedly(m, "name")
    hit = F.avg(((F.get("raw", F.lit(0)) > 0) == (F.col("y") > 0.5)).cast("double"))
    largest = F.abs(hit - F.lit(max(scores))) < 1e-12
    return ln.scores(ln.training_table(m, "name"), best).agg(F.count("*").alias("n_rows"), F.lit(len(scores)).cast("long").alias("n_fits"), largest.alias("best_is_largest"))


@query("cls6_cross_validate", v.with_views(*BASE, LABELS, *TRAINING) + f"""
SELECT floor({v.sql_uniform('name')} * 5)::BIGINT AS fold, count(*) AS n_rows, count(*) FILTER (WHERE label > 0.5) AS n_positive FROM training GROUP BY 1""")
def _(t):
    """Rows of each fold by what became of them under the best of 30 repeats on the other folds."""
    out = cl.cross_validate(training_rows(t), "name")
    return out.select("fold", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_rows"), (F.col("tp") + F.col("fn")).alias("n_positive"))


INTERCEPT = -0.05
COEFS = f"""toks AS (SELECT 'dgms_comment' AS side, unnest(c_tokens) AS feature FROM feats UNION ALL SELECT 'dgms_parent', unnest(p_tokens) FROM feats),
bow AS (SELECT side, 'BoW' AS block, feature, count(*) AS n FROM toks GROUP BY 1, 2, 3 ORDER BY n DESC, side, feature LIMIT 1000),
nw AS (SELECT side, 'non_word' AS block, feature FROM (SELECT DISTINCT side FROM toks), (SELECT unnest([{sql_list(cl.NON_WORD)}]) AS feature)),
coefs AS (SELECT side, block, feature, round({v.sql_uniform("side || ':' || block || ':' || feature")} - 0.5, 6) AS coef
  FROM (SELECT side, block, feature FROM bow UNION ALL SELECT side, block, feature FROM nw))"""


def coefficients(t):
    """A coefficient table over the 1000 most frequent (side, token) pairs and the non-word features."""
    rows = cl.with_features(replies(t))
    def sided(side):
        return F.transform(F.col(side)["zoned_tokens"], lambda w: F.struct(F.lit(side).alias("side"), w.alias("feature")))

    toks = rows.select(F.explode(F.concat(*map(sided, cl.SIDES))).alias("e")).select("e.side", "e.feature")
    bow = toks.groupBy("side", "feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "side", "feature").limit(1000)
    bow = bow.select("side", F.lit("BoW").alias("block"), "feature")
    sides = F.explode(F.array(*[F.lit(x) for x in cl.SIDES])).alias("side")
    nw = t.spark.range(1).select(sides).select(
        "side", F.lit("non_word").alias("block"), F.explode(F.array(*[F.lit(x) for x in cl.NON_WORD])).alias("feature"))
    key = F.concat_ws(":", "side", "block", "feature")
    return bow.unionByName(nw).withColumn("coef", F.round(nm.keyed_uniform(key) - 0.5, 6))


def _nw(p: str, side: str) -> str:
    vals = [("is_post", f"{p}_is_post::INT::DOUBLE"), ("log2_n_words", f"log2({p}_n_words + 1.0::DOUBLE)"),
            ("dgms_n_hyperlinks", f"{p}_n_links::DOUBLE"), ("dgms_n_quotes", f"{p}_n_quotes::DOUBLE")]
    return " UNION ALL ".join(f"SELECT name, '{side}' AS side, 'non_word' AS block, '{f}' AS feature, {e} AS value FROM feats" for f, e in vals)


SCORES = f"""long_feats AS ({_nw('c', 'dgms_comment')} UNION ALL {_nw('p', 'dgms_parent')}
  UNION ALL SELECT name, 'dgms_comment', 'BoW', feature, count(*)::DOUBLE FROM (SELECT name, unnest(c_tokens) AS feature FROM feats) GROUP BY 1, 4
  UNION ALL SELECT name, 'dgms_parent', 'BoW', feature, count(*)::DOUBLE FROM (SELECT name, unnest(p_tokens) AS feature FROM feats) GROUP BY 1, 4),
block_scores AS (SELECT name, side, block, sum(coef * value) AS d, sqrt(sum(value * value)) AS n FROM long_feats JOIN coefs USING (side, block, feature) GROUP BY 1, 2, 3),
doc_scores AS (SELECT name, sum(CASE WHEN n > 0 THEN d / n ELSE 0 END) AS s FROM block_scores GROUP BY 1),
scores AS (SELECT name, {INTERCEPT}::DOUBLE + coalesce(s, 0) AS h2_score FROM feats LEFT JOIN doc_scores USING (name))"""


@query("cls7_linear_scores", v.with_views(*BASE, FEATS, COEFS, SCORES) + """
SELECT name, round(h2_score, 6) AS h2_score, h2_score >= 0 AS selected FROM scores""")
def _(t):
    out = cl.linear_scores(cl.with_features(replies(t)), "name", coefficients(t), INTERCEPT)
    return out.select("name", F.round("h2_score", 6).alias("h2_score"), (F.col("h2_score") >= 0).alias("selected"))


@query("cls8_selected_dataset", v.with_views(*BASE, FEATS, COEFS, SCORES) + f"""
SELECT flair, count(*) AS n, count(*) FILTER (WHERE h2_score >= 0) AS n_selected FROM replies JOIN scores USING (name)
WHERE flair IN ({sql_list(wl.SOCIOPOLITICAL_FLAIRS)}) AND body <> '[deleted]' AND h GROUP BY 1""")
def _(t):
    rows = v.with_raw_body(replies(t))
    rows = rows.filter(fr.is_comment_of_interest(F.col("flair"), F.col("body")) & fr.heuristic_positive(F.col("dgms_body_raw")))
    out = cl.linear_scores(cl.with_features(rows), "name", coefficients(t), INTERCEPT)
    return out.groupBy("flair").agg(F.count("*").alias("n"), F.count_if(F.col("h2_score") >= 0).alias("n_selected"))


@query("eval1_binary_metrics", f"""WITH {SCORED}, c AS (SELECT lang, count(*) FILTER (WHERE h AND r) AS tp, count(*) FILTER (WHERE h AND NOT r) AS fp,
  count(*) FILTER (WHERE NOT h AND r) AS fn, count(*) FILTER (WHERE NOT h AND NOT r) AS tn FROM scored GROUP BY 1)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def _(t):
    out = ev.binary_metrics(scored(t), F.col("h"), F.col("r"), ["lang"])
    return out.withColumns({m: F.round(m, 6) for m in ("precision", "recall", "accuracy")})


@query("eval2_recall_below", f"""WITH {SCORED}, c AS (SELECT lang, count(*) FILTER (WHERE h AND r) AS tp, count(*) FILTER (WHERE NOT h AND r) AS fn FROM scored GROUP BY 1)
SELECT lang, tp, fn, round((SELECT sum(exp(lgamma(tp + fn + 2) - lgamma(j + 1) - lgamma(tp + fn + 1 - j + 1) + j * ln(0.8::DOUBLE) + (tp + fn + 1 - j) * ln(0.2::DOUBLE)))
  FROM (SELECT unnest(range(tp + 1, tp + fn + 2)) AS j)), 6) AS p_recall_below FROM c""")
def _(t):
    counts = ev.binary_metrics(scored(t), F.col("h"), F.col("r"), ["lang"]).select("lang", "tp", "fn")
    return ev.recall_below(counts, 0.8).withColumn("p_recall_below", F.round("p_recall_below", 6))


@query("eval3_heuristic_counts", v.with_views(*BASE, LABELS, f"""
interest AS (SELECT name, h FROM heur WHERE flair IN ({sql_list(wl.SOCIOPOLITICAL_FLAIRS)}) AND body <> '[deleted]')""",
f"uniform AS (SELECT * FROM interest WHERE {v.sql_uniform('name')} < 0.4)",
"u AS (SELECT h, label > 0.5 AS r FROM uniform JOIN name_labels USING (name))",
"fresh AS (SELECT label > 0.5 AS r FROM interest JOIN name_labels USING (name) WHERE h AND name NOT IN (SELECT name FROM uniform JOIN name_labels USING (name)))") + """
SELECT (SELECT count(*) FROM interest WHERE h) AS n_hpos, (SELECT count(*) FROM interest WHERE NOT h) AS n_hneg,
  (SELECT count(*) FROM u WHERE h AND r) AS n_h_r, (SELECT count(*) FROM u WHERE NOT h AND r) AS n_noth_r,
  (SELECT count(*) FROM u WHERE h AND NOT r) AS n_h_notr, (SELECT count(*) FROM u WHERE NOT h AND NOT r) AS n_noth_notr,
  (SELECT count(*) FROM fresh WHERE r) AS n1_h_r, (SELECT count(*) FROM fresh WHERE NOT r) AS n1_h_notr""")
def _(t):
    rows = v.with_raw_body(joined(t)).filter(fr.is_comment_of_interest(F.col("flair"), F.col("body")))
    interest = rows.select("name", fr.heuristic_positive(F.col("dgms_body_raw")).alias("h"))
    uniform = interest.filter(nm.keyed_uniform(F.col("name")) < 0.4)
    return ev.heuristic_counts(interest, uniform, interest.filter("h"), name_labels(t))


@query("eval4_top_coefficients", v.with_views(*BASE, FEATS, COEFS) + """
SELECT side, block, feature, coef FROM coefs ORDER BY abs(coef) DESC, side, block, feature LIMIT 50""")
def _(t):
    return ev.top_coefficients(coefficients(t), 50)
