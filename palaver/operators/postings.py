"""An inverted index as three tables, and the best answers to a query from as few of its rows as can hold them.

`postings` has a row for each term of a document; `blocks` tells for each term and block of documents how many there are and
the largest frequency; `totals` has one row. The first two are range-partitioned and sorted by (term, block), so that a query reads
the row groups of its own terms. A block whose best conceivable score is below the k-th score found so far is not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import write_once
from .search import query_terms
from .sizing import pin_small

BLOCK_DOCS = 512  # documents of a block, about
FILE_ROWS = 2_000_000  # postings of a file, about
LISTED_BLOCKS = 1_000  # block numbers named in a filter; more are joined
FIRST_BLOCKS = 8  # blocks searched for a first k-th score
K1 = 1.2


def impact(tf: Column) -> Column:
    """BM25 weight of a term frequency without length norm; it grows with the frequency."""
    return tf * (K1 + 1) / (tf + K1)


def write_index(docs: DataFrame, doc_id: str, field: str, path: str, keep: dict[str, Column] | None = None, block_docs: int = BLOCK_DOCS) -> None:
    """Index one text field. doc_id is unique; `keep` names the columns that searches may filter by, stored with each posting.

    Documents without text are not counted. Terms are analysed and counted inside the row; a block is a hash of the id, so
    a term in a third of all documents fills many blocks and files.
    """
    keep = {name: c.alias(name) for name, c in (keep or {}).items()}
    if taken := {"term", "block", "doc", "tf", "_bag"} & set(keep):
        raise ValueError(f"columns {sorted(taken)} are the index's own")
    known = docs.filter(F.col(field).isNotNull())
    n = known.count()
    blocks = max(1, -(-n // block_docs))
    block = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(blocks)).cast("int").alias("block")
    bags = known.select(F.col(doc_id).alias("doc"), block, *keep.values(), tx.bag_of_words(tx.analyze_french(F.col(field))).alias("_bag"))
    # dealing rows out by range reads them twice, and unfolding lists looks at them before: texts are analysed once for it
    bags = write_once(bags)
    rows = bags.select("block", "doc", *keep, F.inline("_bag").alias("term", "tf"))
    files = max(1, -(-(bags.select(F.sum(F.size("_bag").cast("long"))).first()[0] or 0) // FILE_ROWS))
    ordered = rows.repartitionByRange(files, "term", "block").sortWithinPartitions("term", "block", "doc")
    ordered.write.parquet(f"{path}/postings")
    spark = docs.sparkSession
    sums = spark.read.parquet(f"{path}/postings").groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most"))
    sums.repartitionByRange(max(1, files // 8), "term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/blocks")
    spark.range(1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(blocks).alias("n_blocks")).coalesce(1).write.parquet(f"{path}/totals")


def block_bounds(spark: SparkSession, path: str, terms: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """(block, n, bound): the largest score a document of the block can have, and the rows to read for it; and the weight of each term."""
    n_docs = spark.read.parquet(f"{path}/totals").first()["n_docs"]
    blocks = spark.read.parquet(f"{path}/blocks").filter(F.col("term").isin(terms))
    found = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    idf = {t: math.log(1.0 + (n_docs - df + 0.5) / (df + 0.5)) for t, df in found.items()}
    weight = by_term(idf)
    return blocks.groupBy("block").agg(F.sum("n").alias("n"), F.sum(weight * impact(F.col("most"))).alias("bound")), idf


def by_term(idf: dict[str, float]) -> Column:
    """The weight of the row's term."""
    out = F.lit(0.0)
    for term, w in idf.items():
        out = F.when(F.col("term") == term, F.lit(w)).otherwise(out)
    return out


def scored(postings: DataFrame, idf: dict[str, float], filters: list[Column], k: int) -> DataFrame:
    """The k best (doc, score) among the postings given."""
    for f in filters:
        postings = postings.filter(f)
    score = F.round(F.sum(by_term(idf) * impact(F.col("tf"))), 6).alias("score")
    return postings.groupBy("doc").agg(score).orderBy(F.desc("score"), "doc").limit(k)


def within(postings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Postings of some blocks: named in the scan's filter if they are few, joined otherwise."""
    some = [r["block"] for r in blocks.select("block").limit(LISTED_BLOCKS + 1).collect()]
    if len(some) <= LISTED_BLOCKS:
        return postings.filter(F.col("block").isin(some))
    return postings.join(pin_small(blocks.select("block")), "block", "left_semi")


def search(spark: SparkSession, path: str, text: str, filters: list[Column] = (), k: int = 20) -> DataFrame:
    """The k best (doc, score) for any of the query's terms: the rows that a scan of all documents gives.

    Filters are over the kept columns and restrict the answer, not the statistics. The blocks of largest bound are
    searched first; their k-th score is a bound below which no other block need be read. The comparison allows for the
    rounding of scores.
    """
    terms = query_terms(spark, text)
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("term").isin(terms))
    if not terms:
        return postings.select("doc", F.lit(0.0).alias("score")).limit(0)
    bounds, idf = block_bounds(spark, path, terms)
    bounds = pin_small(bounds)
    first = bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).select("block", "bound")
    best = [r["score"] for r in scored(within(postings, first), idf, filters, k).collect()]
    least = best[k - 1] if len(best) == k else 0.0
    return scored(within(postings, bounds.filter(F.col("bound") >= least - 1e-5)), idf, filters, k)
