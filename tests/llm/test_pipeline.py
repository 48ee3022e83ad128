"""Each stage of the pipeline on its own input, and the whole."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_decontam import by_force as tiled
from test_jaccard import by_force as grouped
from test_mixing import plain_targets

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    path = str(tmp_path_factory.mktemp("corpus"))
    vocab = [f"v{i}" for i in range(500)]
    bad = ["idiot", "scum", "clown"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(20))) for k in range(5)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(vocab) for _ in range(rng.randrange(1, 80))]
        y = int(rng.random() < 0.25)
        for _ in range(2 * y):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        text = " ".join(words)
        if rows and rng.random() < 0.2:
            text = rows[rng.randrange(len(rows))][1] + rng.choice(["", " v1"])
            y = int(any(b in text.split(" ") for b in bad))
        if i % 40 == 0:
            text += " " + items[i // 40 % 5][1]
        rows.append((i, text, "en", rng.choice(["a", "b", None]), len(text)))
        labels.append((i, 1, y))
    rows += [rows[3], (9001, None, None, None, None), (9002, "", "en", "a", 0), (None, "lonely text of a row without id", None, None, 1), (None, rows[5][1], "x", "b", 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_toxicity(spark, folder):
    docs = docs_of(spark, folder)
    out = cp.toxicity_stage(spark, docs, folder)
    assert out.columns == cp.COLUMNS
    toxic = {tuple(r) for r in docs.collect() if {"idiot", "scum", "clown"} & set((r["text"] or "").split(" "))}
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in docs.collect()} - toxic


def test_near_duplicates(spark, folder):
    docs = docs_of(spark, folder)
    out = cp.near_duplicates_stage(spark, docs, folder)
    assert out.columns == cp.COLUMNS
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id IS NOT NULL").collect()]
    keep = {i for i, _, c in grouped(rows)[0] if i == c}
    got = Counter(r["doc_id"] for r in out.collect())
    assert set(got) == keep | {None} and set(got.values()) == {1}  # the nameless copy of row 5 is gone


def test_decontamination(spark, folder):
    docs = docs_of(spark, folder)
    out = cp.decontamination_stage(spark, docs, folder)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {d for d, *_ in tiled([(r["doc_id"], r["text"]) for r in docs.filter("doc_id IS NOT NULL").collect()], items)}
    assert len(bad) > 10 and sorted(map(str, out.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] not in bad)


def test_mixing(spark, folder):
    docs = docs_of(spark, folder)
    out = cp.mixing_stage(spark, docs, folder)
    assert out.columns == cp.COLUMNS
    n = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    size, taken = n(docs.filter("text <> ''")), n(out.filter("text <> ''"))
    want = dict(zip(["a", "b", None], plain_targets([size["a"], size["b"], size[None]])))
    assert all(want[s] - 220 < taken[s] <= want[s] for s in size)
    assert max(Counter(r["doc_id"] for r in out.filter("doc_id IS NOT NULL AND doc_id <> 3").collect()).values()) == 2


def test_clashing_names(spark, folder):
    """Columns named like those of the operators come through every stage as they are."""
    names = ["size", "copies", "at", "target", "taken", "times", "s", "shard", "slot", "key", "sub", "score", "held_out", "predicted",
             "id", "_key", "_row", "n", "component_id", "first", "text_crc32", "a.b"]
    docs = docs_of(spark, folder).filter("doc_id < 60 OR doc_id IS NULL").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        own = [f"doc_{c}" if name == "sharding" and c in cp.SHARDED else c for c in docs.columns]
        assert out.columns[:len(own)] == own and out.count() > 0
        for r in out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect():
            assert all(r[5 + i] == (None if r[0] is None else f"{c}{r[0]}") for i, c in enumerate(names))


def test_rows_without_id_and_shared_ids(spark, folder):
    """A row with neither id nor text, an id equal to the hash of nothing, and an id that several texts have."""
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    words = [f"w{i}" for i in range(60)]
    long, near = " ".join(words), " ".join([*words, "end"])
    rows = [(None, None), (42, items[0]), (42, "another text of that id"), (None, items[1]), (7, long), (7, near), (7, "apart from the others"), (7, "apart from the others"), (9, near), (None, long)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    clean = Counter((r["doc_id"], r["text"]) for r in cp.decontamination_stage(spark, docs, folder).collect())
    assert clean == Counter(rows) - Counter([(42, items[0]), (None, items[1])])
    out = Counter((r["doc_id"], r["text"]) for r in cp.near_duplicates_stage(spark, docs, folder).collect())
    assert len([r for r in out.elements() if r[1] in (long, near)]) == 1 and out[7, "apart from the others"] == 1 and out[None, None] == 1
    assert next(i for i, t in out if t in (long, near)) == 7 and sum(out.values()) == 6


def test_run(spark, folder):
    out = cp.run(spark, folder)
    assert out.columns == [*cp.COLUMNS, "size", "text_crc32", "shard", "slot"]
    rows = out.collect()
    assert all(r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) > 30
    assert [name for name, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing_sources", "sharding"]
    empty = docs_of(spark, folder).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, folder).count() == 0
