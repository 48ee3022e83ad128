"""Known inputs and outputs of single operators."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.functions import markup as mk
from palaver.functions import numeric as nm
from palaver.functions import text as tx
from palaver.functions.stemming import stems
from palaver.operators import labels as lb
from palaver.operators import retrieval as rt
from palaver.operators import search as se
from palaver.operators import threads as th
from palaver.operators import topics as tp


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("expr,expected", [
    (lambda: tx.fold(F.lit("Ça, le Père Noël À l'hôtel: être où l'âme plaît")), "ca, le pere noel a l'hotel: etre ou l'ame plait"),
    (lambda: tx.clean_special_characters(F.lit("Voir cet article: https://www.lemonde.fr/url-de/l-article")),
     "Voir cet article: lemonde.fr/url-de/l-article"),
    (lambda: tx.high_one_bit(F.lit(127)), 64),
    (lambda: tx.high_one_bit(F.lit(0)), 0),
    (lambda: mk.is_quote_paragraph(F.lit("> Bah sachant que")), True),
    (lambda: tx.take_first_and_last(F.array(*map(F.lit, range(5))), 2, 2), [0, 1, 3, 4]),
    (lambda: tx.take_first_and_last(F.array(*map(F.lit, range(4))), 2, 2), [0, 1, 2, 3]),
    (lambda: tx.first_ngrams(F.split(F.lit("a b c"), " ")), ["a", "b", "c", "a b", "b c", "a b c"]),
    (lambda: tx.analyze_french(F.lit("L'écologie de qu'il n’était")), ["ecolog"]),
    (lambda: tx.analyze_french(F.lit("Salut, comment vas-tu ?")), ["salut", "coment", "vas"]),
    (lambda: tx.analyze_french(F.lit("Parlez-moi de la pluie, et non pas du beau temps")), ["parlez", "plu", "non", "beau", "temp"]),
    (lambda: stems(F.split(F.lit("chevaux bureaux maux réalités personnelles personnel politique journalisme réformatrice éducateurs bouleversement "
                                 "établissement nationalisation qualification librairie aussi naïve bref vraiment penser relations relation molle"), " ")),
     ["cheval", "bureau", "mau", "realit", "person", "personel", "polit", "journalism", "reform", "eduqu", "boulevers", "etabli", "national", "qualific", "librai",
      "ausi", "naïv", "bref", "vraiment", "pens", "relation", "relation", "mou"]),
    (lambda: tx.non_empty_md(F.lit("[removed]")), None),
    (lambda: tx.non_empty_md(F.lit("  \n ")), None),
    (lambda: mk.trim_markdown(F.lit("[deleted]")), None),
    (lambda: mk.trim_markdown(F.lit("[removed]")), ""),
    (lambda: mk.count_quotes(F.lit("> a\n> b\n\ntext\n\n&gt; c")), 2),
    (lambda: mk.raw_text(F.lit("&gt; cité\n\n**Gras** et [lien](http://a.b/c) `x`")), "\n\nGras  et lien  "),
])
def test_scalar(spark, expr, expected):
    assert value(spark, expr()) == expected


def test_terms_of_a_sentence(spark):
    got = value(spark, rt.praise_tokens(F.lit("Merci pour cette argumentation détaillée, c'est intéressant.")))
    assert [t for t in got if t != "cest"] == ["merci", "argumentation", "detaillee", "interessant"]


def test_hyperlinks(spark):
    md = ("Voir [ce site](https://news.ycombinator.com)\n\nTu peux aussi regarder sur "
          "service-public.fr/mon-renseignement/coucou323/mythe.htm?q=324d&z=44lfdsfs%32#xyz990.")
    assert value(spark, mk.hyperlinks(F.lit(md))) == [
        "https://news.ycombinator.com",
        "service-public.fr/mon-renseignement/coucou323/mythe.htm?q=324d&z=44lfdsfs%32#xyz990"]


def test_bag_of_words(spark):
    got = value(spark, tx.bag_of_words(F.split(F.lit("b a b c a b"), " ")))
    assert [(r["term"], r["tf"]) for r in got] == [("a", 2), ("b", 3), ("c", 1)]
    assert value(spark, tx.bag_of_words(F.array().cast("array<string>"))) == []


def test_mutual_information(spark):
    mi = tp.mutual_information(*map(F.lit, (245558.0, 1873.0, 23690.630637551865, 1213.7648639228773)))
    assert value(spark, mi) == pytest.approx(0.010080255655755432, rel=1e-10)


@pytest.mark.parametrize("tp_,fn,expected", [(52, 8, 0.11482626027317401), (42, 2, 0.0032285990973458683)])
def test_recall_tail(spark, tp_, fn, expected):
    assert value(spark, nm.beta_tail(F.lit(0.8), F.lit(tp_), F.lit(fn))) == pytest.approx(expected, rel=1e-9)


def test_flow_to_children(spark):
    rows = [("a", None, ["A"]), ("b", None, ["B"]), ("ca", "a", ["C"]), ("db", "b", ["D"]), ("ec", "ca", ["E"]), ("fz", "z", ["F"])]
    nodes = spark.createDataFrame(rows + rows[:1], "name string, parent_id string, contents array<string>")
    out = th.flow_parent_value(nodes, F.col("contents"), F.array_union, into="contents")
    got = {r["name"]: set(r["contents"]) for r in out.collect()}
    assert got == {"a": {"A"}, "b": {"B"}, "ca": {"C", "A"}, "db": {"D", "B"}, "ec": {"E", "C"}, "fz": {"F"}}
    assert out.count() == 6


DOCS = [{10: 3, 15: 2, 20: 5, 25: 2, 40: 6, 50: 1}, {10: 4, 17: 2, 20: 3},
        {11: 6, 15: 4, 20: 5, 22: 4, 42: 3, 50: 1}, {10: 4, 18: 1, 20: 2}]


def test_ppmi_and_svd(spark):
    rows = [(i, [f"{t:03d}" for t, n in d.items() for _ in range(n)]) for i, d in enumerate(DOCS)]
    docs = spark.createDataFrame(rows, "doc bigint, tokens array<string>")
    x = np.zeros((4, 100))
    for i, d in enumerate(DOCS):
        for term, n in d.items():
            x[i, term] = n
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log(x) + math.log(x.sum()) - np.log(x.sum(0)) - np.log(x.sum(1, keepdims=True))
    expected = np.where(x > 0, np.maximum(pmi, 0), 0)
    for size in (None, 100):
        long = tp.ppmi(docs, "doc", "tokens", vocab_size=size)
        got = np.zeros((4, 100))
        for r in long.collect():
            got[r["doc"], int(r["term"])] = r["ppmi"]
        assert np.allclose(got, expected)
    indexed, n = tp.index_terms(long)
    s, v = tp.svd_fit(tp.sparse_vectors(indexed, "doc", "idx", "ppmi", n, "vec"), "vec", 3)
    y = {r["doc"]: np.array(r["svd"]) for r in tp.svd_transform(spark, indexed, "doc", "idx", "ppmi", s, v).collect()}
    gram = np.array([[y[i] @ y[j] for j in range(4)] for i in range(4)])
    u, sv, _ = np.linalg.svd(expected)
    assert np.allclose(s, sv[:3])
    assert np.allclose(gram, (u[:, :3] * sv[:3] ** 4) @ u[:, :3].T)


THREAD_SIZES = [3, 0, 17, 1, 120, 44]


def threads_by_hash(spark):
    """Threads of several sizes; each comment answers the post or an earlier comment picked by a digest."""
    subm = [(f"s{i}", f"t3_s{i}", f"Titre {i}", "Voir [x](http://a.b/c)", "Science", "1536192000", 3, 3, 0) for i in range(len(THREAD_SIZES))]
    cmts = []
    for i, n in enumerate(THREAD_SIZES):
        for j in range(n):
            up = int(hashlib.md5(f"{i}/{j}".encode()).hexdigest(), 16) % (j + 1)
            parent = f"t3_s{i}" if up == 0 else f"t1_c{i}_{up - 1}"
            cmts.append((f"c{i}_{j}", f"t1_c{i}_{j}", f"t3_s{i}", parent, "Bonjour **tous**.", "1536192001", 1, 1, 0))
    s = spark.createDataFrame(subm, """id string, name string, title string, selftext string, link_flair_text string,
        created_utc string, score bigint, ups bigint, downs bigint""")
    c = spark.createDataFrame(cmts, """id string, name string, link_id string, parent_id string, body string,
        created_utc string, score bigint, ups bigint, downs bigint""")
    return s, c


def test_search_documents_fill_the_schema(spark):
    subm, cmts = threads_by_hash(spark)
    docs = se.search_documents(subm, cmts)
    assert docs.count() == 6 + 185
    assert {r["field"] for r in se.schema_coverage(docs).collect() if r["n_present"]} == {f.name for f in se.SEARCH_SCHEMA}
    assert docs.filter("reddit_type = 'reddit_type_comment' AND dgms_parent_text_contents IS NULL").count() == 0
    assert len([c for c in se.comment_documents(cmts).columns if c != "link_id"]) == 12


def test_children_and_bundles(spark):
    subm, cmts = threads_by_hash(spark)
    assert th.children_of(subm.select("name").unionByName(cmts.select("name", "parent_id"), allowMissingColumns=True)).count() == 185
    bundles = th.bundle_threads(subm.select("name"), cmts, ["name"], per_row=20)
    rows = bundles.collect()
    assert sum(len(r["dgms_submdb_comments_list"]) for r in rows) == 185
    assert {r["name"] for r in rows} == {f"t3_s{i}" for i in range(6)}
    assert max(len(r["dgms_submdb_comments_list"]) for r in rows) < 45
    assert th.co_group(subm, cmts, ["name"]).count() == 185 + 1


def test_labels(spark):
    old = spark.createDataFrame([("d", "x", "p", 0.0, 5), ("d", "y", "p", 1.0, 9)], lb.LABEL_SCHEMA)
    new = spark.createDataFrame([("d", "x", "q", 1.0, 5), ("d", "y", "q", 0.0, 3), ("e", "x", "q", 0.5, 1)], lb.LABEL_SCHEMA)
    got = {(r[0], r[1]): (r["payload"], r["label"]) for r in lb.save_labels(old, new).collect()}
    assert got == {("d", "x"): ("q", 1.0), ("d", "y"): ("p", 1.0), ("e", "x"): ("q", 0.5)}


def test_labels_of_clusters_can_keep_negative_words(spark):
    docs = spark.createDataFrame(
        [(["le", "hibou"], 0.99), (["le", "hibou"], 0.9), (["espaces", "le"], 0.0), (["espaces"], 0.02)], "grams array<string>, p double")
    clusters = F.array(*[F.struct(F.lit(i).cast("long").alias("cluster_id"), p.alias("p")) for i, p in enumerate((F.col("p"), 1 - F.col("p")))])
    docs = docs.select("grams", clusters.alias("clusters"))
    positive = {(r["cluster_id"], r["gram"]) for r in tp.label_clusters(docs, "grams", "clusters").collect()}
    every = {(r["cluster_id"], r["gram"]) for r in tp.label_clusters(docs, "grams", "clusters", positive_only=False).collect()}
    assert {(0, "hibou"), (1, "espaces")} <= positive
    assert positive < every and len(every) == 6


def test_search_scores(spark):
    docs = spark.createDataFrame([(1, "voiture voiture climat"), (2, "climat"), (3, "autre"), (4, None)], "id bigint, body string")
    got = {r["id"]: r["score"] for r in se.text_search(docs, "id", "body", "La voiture, le climat").collect()}
    idf = {"voiture": math.log(1 + 2.5 / 1.5), "climat": math.log(1 + 1.5 / 2.5)}
    assert got == {1: round(idf["voiture"] * 2.2 * 2 / 3.2 + idf["climat"], 6), 2: round(idf["climat"], 6)}
    assert se.text_search(docs, "id", "body", "le la de").count() == 0


def test_markdown_of_real_bodies(spark):
    raw = lambda x: value(spark, mk.raw_text(F.lit(x)))
    assert raw("a &amp; b &lt;c &quot;d&quot; l&#39;e") == "a & b <c \"d\" l'e"
    assert raw("[a](http://x.y/z_(w)) b").split() == ["a", "b"]
    assert value(spark, mk.hyperlinks(F.lit("[a](http://x.y/z_(w)) b"))) == ["http://x.y/z_(w)"]
    assert value(spark, mk.formatting_count(F.lit("_x_ et *y*"))) == 2
    assert value(spark, mk.formatting_count(F.lit("snake_case_name"))) == 0
    md = value(spark, mk.html_to_markdown(F.lit('<h2>Titre</h2><p class="a">Para</p><li id=1>x</li>')))
    assert [x for x in md.split("\n") if x] == ["# Titre", "Para", "- x"]
    assert value(spark, tx.analyze_french(F.lit("lorsqu'elle jusqu'ici puisqu'on quoiqu'il"))) == value(spark, tx.analyze_french(F.lit("elle ici on il")))
