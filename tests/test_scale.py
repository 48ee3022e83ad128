"""Hot keys, ties, and plans: results stay whole and work stays spread."""

import pytest
from pyspark.sql import functions as F

from palaver.functions import numeric as nm
from palaver.functions import vectors as vc
from palaver.operators import classify as cl
from palaver.operators import ranking as rk
from palaver.operators import retrieval as rt
from palaver.operators import sampling as sm
from palaver.operators import sizing
from palaver.operators import stats as st
from palaver.operators import threads as th
from palaver.operators.sizing import pin_small
from palaver.sources import lexicons as lx
from palaver.sources import records as rc


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark, monkeypatch):
    """Salting at any size, shuffle joins only, partitions left as they are."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(sizing, "SALT_ABOVE_BYTES", 0)
    monkeypatch.setattr(sizing, "MIN_PART_ROWS", 100)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def hot_comments(spark, n=30_000):
    """A third of all comments sit in one thread, another third have no thread."""
    hot, none = F.col("id") % 3 == 0, F.col("id") % 3 == 1
    link = F.when(hot, "t3_hot").when(~none, F.concat(F.lit("t3_"), (F.col("id") % 500).cast("string")))
    return spark.range(n).repartition(8).select(
        F.concat(F.lit("t1_"), F.col("id").cast("string")).alias("name"), link.alias("link_id"), F.md5(F.col("id").cast("string")).alias("body"))


def threads_of(spark):
    ids = spark.range(500).select(F.concat(F.lit("t3_"), F.col("id").cast("string")).alias("name"))
    return ids.unionByName(spark.range(1).select(F.lit("t3_hot").alias("name"))).withColumn("title", F.upper("name"))


def test_hot_keys_are_few_and_split(spark, shuffled):
    hot = {r["link_id"]: r["_parts"] for r in sizing.hot_keys(hot_comments(spark), "link_id").collect()}
    assert hot == {"t3_hot": 43}  # 10,000 rows, a part being a sixteenth of a task's mean of 30,000 / 8
    assert sizing.hot_keys(spark.range(1000).withColumn("k", F.col("id")), "k") is None


def test_hot_thread_is_split_in_the_lookup_join(spark, shuffled):
    out = th.enrich_with_submission(hot_comments(spark), threads_of(spark), "subm", ["title"])
    rows = out.groupBy(F.col("subm.title").alias("title")).count().collect()
    assert sum(r["count"] for r in rows) == 30_000
    assert {r["title"]: r["count"] for r in rows}["T3_HOT"] == 10_000
    assert {r["title"]: r["count"] for r in rows}[None] == 10_000
    parts = out.filter("subm.title = 'T3_HOT'").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2500


def test_missing_keys_are_spread(spark, shuffled):
    out = th.lookup(hot_comments(spark), threads_of(spark).withColumnRenamed("name", "link_id"), "link_id", "name")
    parts = out.filter("link_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2500


def test_hot_parent_flows_to_all_children(spark, shuffled):
    kids = hot_comments(spark, 3000).withColumnRenamed("link_id", "parent_id").select("name", "parent_id", F.array("body").alias("c"))
    nodes = kids.unionByName(threads_of(spark).select("name", F.lit(None).cast("string").alias("parent_id"), F.array("title").alias("c")))
    out = th.flow_parent_value(nodes, F.col("c"), F.concat, into="c")
    assert out.count() == 3501
    assert out.filter("get(c, 1) = 'T3_HOT'").count() == 1000
    assert out.filter("size(c) = 2").count() == 2000


def test_co_group_keeps_a_hot_thread_whole(spark, shuffled):
    out = th.co_group(threads_of(spark), hot_comments(spark), ["name"])
    assert out.filter("subm_name = 't3_hot'").count() == 10_000
    assert out.filter("cmt IS NOT NULL").count() == 20_000


def test_chunks_of_a_hot_thread_stay_small(spark):
    c = hot_comments(spark).filter("link_id IS NOT NULL")
    lists = th.chunked_lists(c, "link_id", "name", "name", per_row=500)
    sizes = lists.select("link_id", F.size("items").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == 20_000
    assert max(r["n"] for r in sizes) < 1000


def test_global_rank_with_a_hot_score(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("score"))
    out = rk.with_global_rank(df.repartition(8), [F.desc("score"), F.asc("id")]).orderBy("rank").collect()
    expected = sorted(((r["id"], r["score"]) for r in df.collect()), key=lambda x: (-x[1], x[0]))
    assert [(r["id"], r["score"]) for r in out] == expected
    assert [r["rank"] for r in out] == list(range(1, 5001))


def test_top_per_group_preselects_before_the_shuffle(spark):
    df = spark.range(10_000).select((F.col("id") % 2).alias("g"), "id")
    out = rk.top_per_group(df, ["g"], [F.desc("id")], 3)
    assert sorted(r["id"] for r in out.collect()) == [9994, 9995, 9996, 9997, 9998, 9999]
    assert "WindowGroupLimit" in plan_of(out)


def test_long_lists_are_exact(spark, monkeypatch):
    monkeypatch.setattr(rk, "SHORT_LIST", 10)
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("s")).repartition(8)
    order = [F.desc("s"), F.asc("id")]
    rows = sorted(((r["s"], r["id"], r["g"]) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert [r["id"] for r in rk.top_n(df, order, 700).collect()] == [i for _, i, _ in rows[:700]]
    got = rk.top_per_group(df, ["g"], order, 300).collect()
    for g in range(3):
        mine = [r["id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])]
        assert mine == [i for _, i, x in rows if x == g][:300]


def brute_force_sample(rows, k, uniform):
    n = len(rows)
    counts = {}
    for feats in rows.values():
        for f in set(feats):
            counts[f] = counts.get(f, 0) + 1
    kept = set()
    for name, feats in rows.items():
        best = max((k / m if f in feats else k / (n - m)) for f, m in counts.items())
        if min(1.0, best) > uniform[name]:
            kept.add(name)
    return kept


@pytest.mark.parametrize("k", [1.0, 4.0, 20.0])
def test_diversified_sample_equals_brute_force(spark, k):
    feats = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("id") % 2 == 0, "even"), F.when(F.col("id") % 100 == 0, "rare"),
        F.concat(F.lit("m"), (F.col("id") % 17).cast("string")), F.when(F.col("id") != 77, "nearly-all")))
    df = spark.range(1500).select(F.col("id").cast("string").alias("name"), feats.alias("f"), nm.keyed_uniform(F.col("id").cast("string")).alias("u"))
    rows = df.collect()
    expected = brute_force_sample({r["name"]: r["f"] for r in rows}, k, {r["name"]: r["u"] for r in rows})
    assert {r["name"] for r in sm.diversified_sample(df, "name", F.col("f"), k).collect()} == expected


def test_pin_small_leaves_large_tables_alone(spark):
    big, small = spark.range(100), spark.range(10)
    assert "ResolvedHint" not in pin_small(big, 50)._jdf.queryExecution().analyzed().toString()
    pinned = pin_small(small, 50)
    assert "ResolvedHint" in pinned._jdf.queryExecution().analyzed().toString() and pinned.count() == 10


def test_mean_cosine_needs_no_pairs(spark):
    a = spark.createDataFrame([([1.0, 0.0],), ([0.0, 2.0],), ([0.0, 0.0],)], "v array<double>")
    b = spark.createDataFrame([([3.0, 3.0],), ([-1.0, 0.0],)], "v array<double>")
    out = st.mean_pairwise_cosine(a, b, "v", 2)
    assert out.first()[0] == pytest.approx((2 * 2 ** -0.5 - 1) / 6)
    assert "Cartesian" not in plan_of(out) and "NestedLoop" not in plan_of(out)


def test_similarity_ties_go_to_the_smaller_id(spark):
    df = spark.range(1000).select("id", F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("v")).repartition(4)
    out = rt.most_similar(df, "id", "v", ["q"], [[1.0, 0.0]], 5).orderBy("rank").collect()
    assert [r["id"] for r in out] == [0, 2, 4, 6, 8]


def test_vectors_without_known_tokens(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["zz"])], "id bigint, t array<string>")
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "token string, vec array<float>")
    got = {r["id"]: r["vec"] for r in rt.doc_vectors(docs, "id", F.col("t"), index, 2).collect()}
    assert got[2] is None and got[1] == pytest.approx([2 ** -0.5, 2 ** -0.5])
    mean = {r["id"]: r["vec"] for r in rt.phrase_vectors(docs, "id", F.col("t"), index, 2).collect()}
    assert mean[2] == [0.0, 0.0] and mean[1] == pytest.approx([2 / 3, 2 / 3])
    score = rt.max_similarity([[1.0, 0.0], [0.0, 1.0]])
    vecs = rt.doc_vectors(docs, "id", F.col("t"), index, 2)
    assert {r["id"]: r["s"] for r in vecs.select("id", score(F.col("vec")).alias("s")).collect()} == {1: 0.707107, 2: -1.0}


def test_large_index_gives_the_same_vectors(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["a", "b", "a"][: i % 3 + 1]) for i in range(30)], "id bigint, t array<string>")
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "token string, vec array<float>")
    small = rt.doc_vectors(docs, "id", F.col("t"), index, 2).orderBy("id").collect()
    monkeypatch.setattr(rt, "BROADCAST_BYTES", 8)
    assert rt.doc_vectors(docs, "id", F.col("t"), index, 2).orderBy("id").collect() == small


def training(spark):
    rows = [(f"t1_{i}", f"merci mot{i % 7}" if i % 3 else f"non mot{i % 5}", "t3_0", "Quel sujet", float(i % 3 > 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "name string, body string, parent_id string, parent_body string, dgms_h2_label double")
    return cl.with_features(df)


def test_scores_agree_with_the_trained_model(spark):
    pipe, matrix = cl.feature_matrix(training(spark), 1000)
    svc = cl.train_linear(matrix, max_iter=20)
    coefs, intercept = cl.coefficient_table(spark, pipe, svc)
    scored = cl.linear_scores(training(spark), "name", coefs, intercept)
    mine = {r["name"]: r["h2_score"] for r in scored.collect()}
    theirs = {r["name"]: r["rawPrediction"][1] for r in svc.transform(matrix).collect()}
    assert mine == pytest.approx(theirs, abs=1e-9)
    chosen = {r["name"] for r in cl.selected(training(spark), "name", coefs, intercept).collect()}
    assert chosen == {n for n, s in mine.items() if s >= 0}


def test_blocks_have_unit_norm(spark):
    _, matrix = cl.feature_matrix(training(spark), 1000)
    for side in cl.SIDES:
        for block in ("nw", "bow"):
            for r in matrix.select(f"{side}_{block}").collect():
                assert r[0].norm(2) == pytest.approx(1.0)


def test_word_vector_file(spark, tmp_path):
    path = tmp_path / "vec.txt"
    path.write_text("4 2\nMerci 1.0 2.0\nle 0.5 0.5\nmerci 9 9\nclair -1e-1 3\n", encoding="utf-8")
    from palaver.functions import text as tx

    got = [(r["idx"], r["token"], r["vec"]) for r in
           lx.read_word_vectors(spark, str(path), normalize=lambda c: tx.normalize_term(c)).orderBy("idx").collect()]
    assert [(i, t) for i, t, _ in got] == [(0, "merci"), (1, "clair")]
    assert got[0][2] == [1.0, 2.0] and got[1][2] == pytest.approx([-0.1, 3.0])
    assert lx.read_word_vectors(spark, str(path), n_first=1).count() == 1


def test_stop_word_file(spark, tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text(" | comment\n\nau  |  a + le\nça|x\n", encoding="utf-8")
    assert {r["word"] for r in lx.read_stop_words(spark, str(path)).collect()} == {"au", "ça"}


def test_sequence_files_and_keyed_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", "été\nx"), ("b", "y")], "k string, v string")
    rc.write_text_sequence(df, "v", str(tmp_path / "t"))
    assert {r["value"] for r in rc.read_text_sequence(spark, str(tmp_path / "t")).collect()} == {"été\nx", "y"}
    rc.write_bytes_sequence(df, "k", "v", str(tmp_path / "b"))
    assert {(r["key"], bytes(r["value"]).decode()) for r in rc.read_bytes_sequence(spark, str(tmp_path / "b")).collect()} == {("a", "été\nx"), ("b", "y")}
    twice = df.withColumn("n", F.lit(1)).unionByName(df.withColumn("n", F.lit(2)))
    rc.write_index(twice, "k", str(tmp_path / "i"), version=F.col("n"))
    assert [r["n"] for r in rc.read_records(spark, str(tmp_path / "i")).collect()] == [2, 2]


def test_bernoulli_does_not_depend_on_partitions(spark):
    df = spark.range(4000)
    picks = [{r["id"] for r in sm.bernoulli(df.repartition(n), "id", 200, 5).collect()} for n in (2, 4, 8)]
    assert picks[0] == picks[1] == picks[2] and 140 < len(picks[0]) < 260


def test_references_of_any_number(spark):
    refs = spark.range(5000).select("id", F.array(F.cos("id"), F.sin("id")).alias("r"))
    rows = spark.range(40).select("id", F.array(F.cos(F.col("id") + 0.3), F.sin(F.col("id") + 0.3)).alias("v")).unionByName(
        spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v")))
    whole = {r["id"]: r["s"] for r in rt.with_max_similarity(rows, "v", refs, "id", "r", "s", 8000).collect()}
    blocks = {r["id"]: r["s"] for r in rt.with_max_similarity(rows, "v", refs, "id", "r", "s", 250).collect()}
    assert whole == blocks and blocks[-1] == -1.0 and min(v for k, v in blocks.items() if k >= 0) > 0.99
    near = rt.most_similar_to(rows, "id", "v", refs.limit(500), "id", "r", 3, 100)
    assert near.count() == 1500


def test_recall_tail_of_large_counts(spark):
    df = spark.createDataFrame([(2_400_000_000, 600_000_000), (2_400_100_000, 599_900_000), (0, 0), (10**9, 0)], "tp long, fn long")
    got = [r[0] for r in df.select(nm.beta_tail(F.lit(0.8), F.col("tp"), F.col("fn"))).collect()]
    assert got[0] == pytest.approx(0.5, abs=1e-4) and got[1] < 0.01 and got[2] == pytest.approx(0.8) and got[3] == 0.0


def test_chunks_of_a_hot_thread_stay_in_many_tasks(spark, shuffled):
    rows = th.bundle_threads(threads_of(spark), hot_comments(spark), ["name"], per_row=20)
    spread = rows.filter("name = 't3_hot'").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in spread) > 400 and len(spread) > 4
    assert rows.select(F.sum(F.size("dgms_submdb_comments_list"))).first()[0] == 20_000
    assert rows.filter("size(dgms_submdb_comments_list) = 0").count() == rows.select("name").distinct().count() - rows.filter("size(dgms_submdb_comments_list) > 0").select("name").distinct().count()


def test_first_of_several_rows_wins(spark):
    subm = spark.createDataFrame([("t3_a", "late", 9), ("t3_a", "first", 1), ("t3_a", "later", 5)], "name string, title string, created_utc long")
    cmts = spark.createDataFrame([("t1_x", "t3_a")], "name string, link_id string")
    for n in (1, 3, 8):
        assert th.enrich_with_submission(cmts, subm.repartition(n), "s", ["title"]).first()["s"]["title"] == "first"
    same = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "c")], "name string, v string")
    assert len({th.one_per_key(same.repartition(n), "name").first()["v"] for n in (1, 2, 5)}) == 1
    assert len({rc.latest_per_key(same.repartition(n), "name").first()["v"] for n in (1, 2, 5)}) == 1


def test_scratch_folders_can_be_dropped(spark):
    import os

    from palaver import session

    path = session.write_once(spark.range(5)).inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and session.drop_scratch(spark) >= 1 and not os.path.exists(path) and session.drop_scratch(spark) == 0


def test_norm_of_a_sparse_vector_reads_its_stored_values(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.sparse(2_000_000_000, {3: 3.0, 1_999_999_999: 4.0}),), (Vectors.dense([0.0, 5.0]),), (Vectors.sparse(7, {}),)]
    df = spark.createDataFrame(rows, ["v"])
    assert [r[0] for r in df.select(vc.ml_norm(F.col("v"))).collect()] == [5.0, 5.0, 0.0]


def bags_of(spark):
    rows = [(i, [f"t{j}" for j in range(9) if (i + 1) % (j + 1) == 0 for _ in range(j % 3 + 1)] + [f"rare{i}"]) for i in range(40)] + [(40, []), (41, None)]
    return spark.createDataFrame(rows, "doc bigint, tokens array<string>").repartition(3)


def test_ppmi_shuffles_rows_of_rare_terms_only(spark, monkeypatch):
    from palaver.operators import topics as tp

    def values():
        return {(r["doc"], r["term"]): round(r["ppmi"], 9) for r in tp.ppmi(bags_of(spark), "doc", "tokens").collect()}

    whole = values()
    monkeypatch.setattr(tp, "pin_small_checked", lambda df: (df, False))
    monkeypatch.setattr(tp, "FREQUENT_TERMS", 9)
    assert values() == whole and len(whole) > 100
    plan = tp.ppmi(bags_of(spark), "doc", "tokens")._jdf.queryExecution().toString()
    assert "LeftAnti" in plan  # frequent terms leave before the join by term


def test_ppmi_with_a_vocabulary_needs_no_shuffle_of_rows(spark):
    from palaver.operators import topics as tp

    out = tp.ppmi(bags_of(spark), "doc", "tokens", vocab_size=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert {r[0] for r in out.select("term").distinct().collect()} == {"t0", "t1", "t2", "t4", "t5"}


def test_saved_vectorizer_analyses_texts_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["src14_saved_vectorizer"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "tokens" in plan  # the terms come from the stored rows
