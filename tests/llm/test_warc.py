"""Archives read back as written, whatever the payloads hold."""

import hashlib

import pytest

from palaver.llm import warc
from palaver.session import scratch_path

FAKE = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:palaver:page:77>\r\nContent-Length: 5\r\n\r\nhello" + warc.END
PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/\r\nX: y", None), (3, None, ""), (4, "é", "ü" * 60), (9, "u", "ü" * 60), (5, "u", "ü" * 60),
    (6, "u", "short"), (7, "u", "short"), (10, "u", FAKE * 3 + "tail"), (11, "u", warc.MAGIC), (12, "u", "x" + FAKE + warc.MAGIC * 2), (13, "u", FAKE),
    (14, "u", "\r\n\r\n" * 50), (4, "é", "ü" * 60), (15, "u", "long " * 200_000), (16, "u", warc.MAGIC + "Content-Length: 99999999999999999999\r\n\r\n"), (None, "u", "null id " * 30),
]


def expected(pages):
    first, out = {}, []
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    for i, _, h in pages:
        b = (h or "").encode()
        again = b in first and first[b] != i
        out.append((i, "revisit" if again else "response", first[b] if again else None, len(b), hashlib.sha256(b).hexdigest(), True))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, type int")


@pytest.mark.parametrize("split", ["128m", "97", "1000"])
@pytest.mark.parametrize("files", [1, 3])
def test_round_trip(spark, split, files):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    pages = [p for p in PAGES if split != "97" or p[0] != 15]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = scratch_path(spark, "warc")
        warc.write(frame(spark, pages).repartition(files), path)
        assert sorted((tuple(r) for r in warc.read(spark, path).collect()), key=str) == expected(pages)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_pages(spark):
    assert warc.archive(frame(spark, [])).collect() == []


def test_chain_stops_at_a_broken_record(spark):
    path = scratch_path(spark, "warc")
    head = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:palaver:page:{}>\r\nContent-Length: {}\r\n\r\n"
    good = head.format(1, 4) + "\r\n\r\n" + warc.END
    spark.createDataFrame([(good + head.format(2, 500) + "cut",)], "value string").coalesce(1).write.option("lineSep", "!").text(path)
    assert [r["id"] for r in warc.read(spark, path).collect()] == [1]


def test_pointer_jumping(spark):
    """Long chains over many false candidates."""
    rows, want = [], []
    for f in "ab":
        off, true = 0, []
        for k in range(200):
            true.append(off)
            off += 100
        for o in true:
            rows.append((f, o, o + 100, 20_000))
            rows.append((f, o + 10, o + 20, 20_000))
            rows.append((f, o + 20, o + 130, 20_000))
        want += [(f, o) for o in true]
    rows.sort()
    rows = [(f, k + 1, o, s, n) for f in "ab" for k, (_, o, s, n) in enumerate(r for r in rows if r[0] == f)]
    got = warc.chain(spark.createDataFrame(rows, "file string, pos int, off long, succ long, file_size long"))
    assert sorted((r["file"], r["off"]) for r in got.collect()) == want
