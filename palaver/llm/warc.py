"""WARC archives: deduplicating writer, and a reader that verifies the chain of record boundaries.

The reader splits files at every occurrence of the magic string, so each task of a large file emits candidate records,
true ones and such inside payloads. A candidate's header gives its successor's offset. Only candidates on the chain
of successors from the start of the file are records. Chains are followed by pointer jumping; stretches in which each
candidate's successor is simply the next candidate are one node there, so the number of rounds grows with the
logarithm of the number of false candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import checked_broadcast, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_FROM_BYTES = 100
MAX_RECORDS = 20_000  # per file
DATE = "2024-01-01T00:00:00Z"
URN = "urn:palaver:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, payload, bytes, digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    base = base.select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    large = base.filter(F.col("bytes") >= REVISIT_FROM_BYTES)
    seen = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = checked_broadcast(stored(seen.filter("n > 1").select(F.col("digest").alias("_digest"), "first")))
    joined = base.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("bytes") >= REVISIT_FROM_BYTES), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("id", "url", "payload", "bytes", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_records: int = MAX_RECORDS) -> None:
    """Write one record per row, in files of at most max_records records.

    Of rows with equal payloads of at least 100 bytes that with the smallest id is a response, the others revisit it
    (repeated rows of the smallest id are all responses). Null html is an empty payload, a null id an empty record
    id, a null url an empty target. The text itself is shuffled only if more payloads repeat than may be broadcast.
    """
    r = plan_records(pages, id_col, url_col, html_col)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda x: F.concat(F.lit(f"<{URN}"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("id"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Target-URI", url), line("WARC-Date", F.lit(DATE)), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Bytes", F.col("bytes").cast("string")), line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(F.col("block")).cast("string")), F.lit("\r\n"))
    rows = r.withColumn("block", block).select(F.concat(head, "block").alias("value"))
    rows.write.option("lineSep", END).option("maxRecordsPerFile", max_records).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two occurrences of the magic, with its place: file, start of the split, running number."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"),
                       F.col("_metadata.file_block_start").alias("blk"), F.monotonically_increasing_id().alias("mid"))


def _header(df: DataFrame) -> DataFrame:
    field = lambda name: F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r\n]*)", 1)
    df = df.withColumn("head", F.substring_index("value", END, 1)).withColumn("head_bytes", F.octet_length("head"))
    number = lambda x: F.regexp_extract(x, r"^(\d{1,18})$", 1).try_cast("long")
    urn = lambda x: F.regexp_extract(x, f"^<{URN}(-?[0-9]*)>$", 1).try_cast("long")
    return df.select(
        "*", field("WARC-Type").alias("type"), urn(field("WARC-Record-ID")).alias("id"), urn(field("WARC-Refers-To")).alias("refers_to"),
        number(field("Content-Length")).alias("content"), number(field("X-Payload-Bytes")).alias("said_bytes"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("said_digest"))


def _payload(value: Column, head_bytes: Column, content: Column) -> Column:
    """Bytes after the HTTP head of the block."""
    block = F.substring(value.cast("binary"), head_bytes + 5, content.cast("int"))
    http = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + 4
    return F.substring(block, http + 1, F.greatest(content.cast("int") - http, F.lit(0)))


def chain(cands: DataFrame) -> DataFrame:
    """Of candidates (file, pos, off, succ, file_size), pos counting 1, 2, ... in each file, those reachable from offset 0.

    A candidate whose successor would lie beyond the end of the file is not a record, and the chain ends before it.
    Nothing is kept of a file that does not start with a candidate.
    """
    at = Window.partitionBy("file").orderBy("pos")
    breaks = (F.coalesce(F.lead("off").over(at), F.lit(-1)) != F.col("succ")).cast("int")
    runs = cands.withColumn("breaks", breaks)
    runs = runs.withColumn("run", F.sum("breaks").over(at) - F.col("breaks"))
    runs = stored(runs)
    ends = runs.filter("breaks = 1 AND succ < file_size").select("file", F.col("run").alias("from_run"), F.col("succ").alias("off"))
    start = runs.filter("off = 0").select("file", "run")
    entries = start.withColumn("entry", F.lit(0).cast("long"))
    if not ends.isEmpty():
        hops = stored(ends.join(runs.select("file", "off", "run"), ["file", "off"]).select("file", "from_run", "run", F.col("off").alias("entry")))
        jump = hops.select("file", "from_run", F.col("run").alias("to_run"))
        reached, n, before = start, -1, -2
        while n != before:
            more = reached.join(jump, [reached["file"] == jump["file"], reached["run"] == jump["from_run"]]).select(reached["file"], F.col("to_run").alias("run"))
            reached = stored(reached.union(more).distinct())
            before, n = n, reached.count()
            twice = jump.select(F.col("file"), F.col("from_run").alias("to_run"), F.col("to_run").alias("end"))
            jump = stored(jump.join(twice, ["file", "to_run"]).select("file", "from_run", F.col("end").alias("to_run")))
        entries = entries.union(hops.join(reached.withColumnRenamed("run", "from_run"), ["file", "from_run"]).select("file", "run", "entry"))
    return runs.join(entries, ["file", "run"]).filter("off >= entry AND succ <= file_size").drop("run", "breaks", "entry")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, refers_to, payload_bytes, payload_digest, intact) of every record of the archives under path.

    Digest and length of a response are taken from its payload as read, those of a revisit from its header; intact
    tells whether header and payload agree. The magic string inside a payload never starts a record. Empty files and
    folders give no rows.
    """
    size = len(MAGIC)
    scan = _header(_chunks(spark, path)).withColumn("len", F.octet_length("value").cast("long"))
    whole = F.col("len") == F.col("head_bytes") + F.col("content") + 8
    payload = _payload(F.col("value"), F.col("head_bytes"), F.col("content"))
    digest = F.when(whole, F.sha2(payload, 256))
    length = F.when(whole, F.octet_length(payload).cast("long"))
    scan = stored(scan.select("file", "file_size", "blk", "mid", "len", "type", "id", "refers_to", "content", "head_bytes",
                              "said_bytes", "said_digest", digest.alias("digest"), length.alias("bytes")))
    at = Window.partitionBy("file").orderBy("blk", "mid")
    placed = scan.withColumn("pos", F.row_number().over(at) - 1)
    end = F.sum(F.col("len") + size).over(at)
    placed = placed.withColumn("off", end - F.col("len") - 2 * size).withColumn("succ", F.col("off") + size + F.col("head_bytes") + F.col("content") + 8)
    good = placed.filter("pos > 0 AND content IS NOT NULL AND type <> ''")
    order = Window.partitionBy("file").orderBy("off")
    records = chain(good.select("file", F.row_number().over(order).alias("pos"), "off", "succ", "file_size"))
    kept = stored(placed.join(records.select("file", "off"), ["file", "off"]))
    cut = kept.filter("digest IS NULL").select("file", "pos", "succ", "off", "head_bytes", "content")
    if not cut.isEmpty():  # records with the magic inside: read their chunks again and put them together
        owner = cut.select("file", F.col("off").alias("own"), "succ", F.col("head_bytes").alias("own_head"), F.col("content").alias("own_content"))
        parts = placed.join(owner, (placed["file"] == owner["file"]) & (placed["off"] >= owner["own"]) & (placed["off"] < owner["succ"]))
        parts = checked_broadcast(stored(parts.select(placed["file"], "blk", "mid", "pos", "own", "own_head", "own_content")))
        texts = _chunks(spark, path).join(parts, ["file", "blk", "mid"])
        joined = texts.groupBy("file", "own", "own_head", "own_content").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("parts"))
        value = F.array_join(F.col("parts.value"), MAGIC)
        mended = joined.select("file", F.col("own").alias("off"), _payload(value, F.col("own_head"), F.col("own_content")).alias("p"))
        mended = mended.select("file", "off", F.sha2("p", 256).alias("digest2"), F.octet_length("p").cast("long").alias("bytes2"))
        kept = kept.join(mended, ["file", "off"], "left").withColumn("digest", F.coalesce("digest", "digest2")).withColumn("bytes", F.coalesce("bytes", "bytes2"))
    revisit = F.col("type") == "revisit"
    out_bytes, out_digest = F.when(revisit, F.col("said_bytes")).otherwise(F.col("bytes")), F.when(revisit, F.col("said_digest")).otherwise(F.col("digest"))
    intact = revisit | ((F.col("bytes") == F.col("said_bytes")) & (F.col("digest") == F.col("said_digest")))
    return kept.select("id", "type", "refers_to", out_bytes.alias("payload_bytes"), out_digest.alias("payload_digest"), intact.alias("intact"))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to new archives in the shared folder and read those back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, id_col, url_col, html_col)
    return read(spark, path)
