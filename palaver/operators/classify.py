"""Linear selection of high-quality replies: features, training, scoring."""

from __future__ import annotations

from collections import Counter

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import CountVectorizer, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as mk
from ..functions import numeric as nm
from ..functions import text as tx
from . import evaluate as ev
from . import frames as fr
from . import linear as ln
from . import ranking as rk

SIDES = ["dgms_comment", "dgms_parent"]
NON_WORD = ["is_post", "log2_n_words", "dgms_n_hyperlinks", "dgms_n_quotes"]
BLOCKS = [(side, block) for side in SIDES for block in ("non_word", "BoW")]
COEF_SCHEMA = "side string, block string, feature string, coef double"


def reply_features(name: Column, md: Column) -> Column:
    """Struct of the features of one text; a missing text counts as empty."""
    def features(words: Column) -> Column:
        return F.struct(
            fr.is_post(name).alias("is_post"),
            F.size(words).cast("long").alias("n_words"),
            mk.count_quotes(md).alias("dgms_n_quotes"),
            mk.n_hyperlinks(mk.hyperlinks(md)).alias("dgms_n_hyperlinks"),
            F.transform(tx.take_first_and_last(words, 30, 30), lambda w: tx.fold(w)).alias("zoned_tokens"),
        )

    return tx.bind(F.coalesce(tx.split_words(mk.raw_text(md)), F.array().cast("array<string>")), features)


def with_features(df: DataFrame, name="name", body="body", parent_name="parent_id", parent_body="parent_body") -> DataFrame:
    """Add the feature structs of the comment and of its parent."""
    return df.withColumns({
        "dgms_comment": reply_features(F.col(name), F.col(body)),
        "dgms_parent": reply_features(F.col(parent_name), F.col(parent_body)),
    })


def labelled_features(
    comments: DataFrame, labels: DataFrame, first_sample: DataFrame, pos: str,
    flair: str = "flair", raw: str = "dgms_body_raw",
) -> DataFrame:
    """Training rows: of interest, heuristic-positive, not labelled in the first sample,
    up to the first row (by pos) without a label."""
    chosen = comments.filter(fr.is_comment_of_interest(F.col(flair), F.col("body")) & fr.heuristic_positive(F.col(raw)))
    known = first_sample.select("name").join(labels.select("name"), "name", "left_semi")
    rows = chosen.join(known, "name", "left_anti").join(labels.select("name", "label"), "name", "left")
    kept = rk.prefix_until_missing(rows, pos, "label")
    return with_features(kept).withColumnRenamed("label", "dgms_h2_label")


def non_word_values(side: str) -> list[Column]:
    s = F.col(side)
    return [
        s["is_post"].cast("double"),
        nm.log2_n_words(s["n_words"]),
        s["dgms_n_hyperlinks"].cast("double"),
        s["dgms_n_quotes"].cast("double"),
    ]


# Training -------------------------------------------------------------------------------

def feature_pipeline(vocab_size: int = 5000) -> Pipeline:
    """Each block is normalised to unit length per row, then all blocks are joined."""
    stages = []
    for side in SIDES:
        stages += [
            VectorAssembler(inputCols=[f"{side}_{f}" for f in NON_WORD], outputCol=f"{side}_nw_raw"),
            Normalizer(p=2.0, inputCol=f"{side}_nw_raw", outputCol=f"{side}_nw"),
            CountVectorizer(vocabSize=vocab_size, inputCol=f"{side}_tokens", outputCol=f"{side}_bow_raw"),
            Normalizer(p=2.0, inputCol=f"{side}_bow_raw", outputCol=f"{side}_bow"),
        ]
    blocks = [f"{side}_{b}" for side in SIDES for b in ("nw", "bow")]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=blocks, outputCol="features")])


def flat_inputs(rows: DataFrame, positive_weight: float = 2000.0) -> DataFrame:
    """Flatten the feature structs and derive label and weight for training."""
    cols = {f"{side}_{f}": c for side in SIDES for f, c in zip(NON_WORD, non_word_values(side))}
    cols |= {f"{side}_tokens": F.col(side)["zoned_tokens"] for side in SIDES}
    out = rows.withColumns(cols)
    if "dgms_h2_label" in rows.columns:
        out = out.withColumn("label", (F.col("dgms_h2_label") > 0.5).cast("double"))
        out = out.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(positive_weight))).otherwise(1.0))
    return out


def feature_matrix(rows: DataFrame, vocab_size: int = 5000):
    flat = flat_inputs(rows)
    model = feature_pipeline(vocab_size).fit(flat)
    return model, model.transform(flat)


def train_linear(matrix: DataFrame, reg: float = 1e-4, max_iter: int = 50, weight: str = "weight"):
    return LinearSVC(featuresCol="features", labelCol="label", weightCol=weight, regParam=reg,
                     maxIter=max_iter, standardization=False).fit(matrix)


def train_repeatedly(matrix: DataFrame, row_id: str, n_repeat: int = 30, keep: float = 0.9, **kw) -> tuple[ln.Boundaries, list[float]]:
    """Fit on n_repeat stable random subsets, all in the same passes; (model, scores).

    The model is the first of best accuracy over all rows, the scores are all accuracies.
    """
    rows = ln.training_table(matrix, row_id, n_repeat, keep)
    models = ln.fit(rows, ln.n_features(matrix), repeats=list(range(n_repeat)), **kw)
    accuracy = ln.training_accuracy(ln.counts(rows, models))
    return models.one(int(accuracy.argmax())), accuracy.tolist()


def hinge_loss(matrix: DataFrame, model) -> float:
    """Weighted mean hinge loss of a fitted boundary; that of the zero vector is 1."""
    sign = 2 * F.col("label") - 1
    margin = sign * F.get(vector_to_array("rawPrediction"), F.lit(1))
    loss = F.sum(F.col("weight") * F.greatest(F.lit(0.0), 1 - margin)) / F.sum("weight")
    return model.transform(matrix).select(loss).first()[0]


def coefficient_table(spark, pipeline_model, svc) -> tuple[DataFrame, float]:
    """The fitted boundary as (side, block, feature, coef) rows and the intercept."""
    names = []
    for i, side in enumerate(SIDES):
        names += [(side, "non_word", f) for f in NON_WORD]
        names += [(side, "BoW", w) for w in pipeline_model.stages[4 * i + 2].vocabulary]
    rows = [(s, b, f, float(c)) for (s, b, f), c in zip(names, svc.coefficients.toArray())]
    return spark.createDataFrame(rows, COEF_SCHEMA), float(svc.intercept)


def cross_validate(rows: DataFrame, row_id: str, k: int = 5, n_repeat: int = 30, keep: float = 0.9, vocab_size: int = 5000, **kw) -> DataFrame:
    """Recall and precision of the repeated training on each held-out fold; folds come from the keyed uniform of the id.

    All k * n_repeat models learn in the same passes over one matrix. In each fold the repeat of best accuracy on the other folds counts.
    A fold without rows has counts of 0.
    """
    _, matrix = feature_matrix(rows, vocab_size)
    table = ln.training_table(matrix, row_id, n_repeat, keep, k)
    models = ln.fit(table, ln.n_features(matrix), folds=list(range(k)), repeats=list(range(n_repeat)), **kw)
    found = ln.counts(table, models)
    found["accuracy"] = ln.training_accuracy(found)
    best = found.loc[found.groupby("fold")["accuracy"].idxmax(), ["fold", "tp", "fp", "fn", "tn"]]
    frame = rows.sparkSession.createDataFrame(best.astype("int64"), "fold long, tp long, fp long, fn long, tn long")
    return ev.rates(frame)


# Scoring --------------------------------------------------------------------------------

def bag_score(coefs: dict[str, float]):
    """Column function on token lists: (coef . x) / |x restricted to the model's tokens|, 0 without any."""
    @F.arrow_udf("double")
    def score(tokens):
        import pyarrow as pa

        out = []
        for words in tokens.to_pylist():
            known = Counter(w for w in words or () if w in coefs)
            length = sum(n * n for n in known.values()) ** 0.5
            out.append(sum(coefs[w] * n for w, n in sorted(known.items())) / length if known else 0.0)
        return pa.array(out, pa.float64())

    return score


def linear_scores(df: DataFrame, row_id: str, coefs: DataFrame, intercept: float) -> DataFrame:
    """Intercept plus, per block, (coef . x) / |x restricted to the model's features|.

    A block without known features adds 0. The coefficients are a fitted model of bounded size; they are sent to the
    tasks, and each comment is scored inside its row, without a shuffle.
    """
    model: dict = {block: {} for block in BLOCKS}
    for r in coefs.collect():
        model[r["side"], r["block"]][r["feature"]] = r["coef"]
    score = F.lit(float(intercept))
    for side in SIDES:
        weighted = [(model[side, "non_word"][n], c) for n, c in zip(NON_WORD, non_word_values(side)) if n in model[side, "non_word"]]
        if weighted:
            dot = sum((F.lit(k) * c for k, c in weighted[1:]), F.lit(weighted[0][0]) * weighted[0][1])
            squares = sum((c * c for _, c in weighted[1:]), weighted[0][1] * weighted[0][1])
            score = score + F.when(squares > 0, dot / F.sqrt(squares)).otherwise(0.0)
        score = score + bag_score(model[side, "BoW"])(F.col(side)["zoned_tokens"])
    return df.withColumn("h2_score", score)


def selected(df: DataFrame, row_id: str, coefs: DataFrame, intercept: float) -> DataFrame:
    """Rows on the positive side of the boundary (inclusive)."""
    return linear_scores(df, row_id, coefs, intercept).filter("h2_score >= 0")
