import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.store import folder

LONG = "<p>" + "ü x\r\n\r\n" * 30_000 + "</p>"
PAGES = [
    (1, "http://a.example/\r\n1", "<html>" + "a" * 2_000, 5), (2, None, "<html>" + "a" * 2_000, 5), (7, "u", "<html>" + "a" * 2_000, 5), (3, "u", "small", 5), (4, "u", "small", 5),
    (5, "u", None, 5), (6, "u", "", 5), (8, "u", LONG, 5), (9, "u", LONG + "!", 5), (10, "u", LONG, 5), (10, "u", LONG, 5), (None, "u", LONG + "?", 5), (11, "u", "é" * 500, 5), (12, "u", "é" * 500, 5)]


@pytest.fixture(scope="module")
def written(spark):
    path = folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int"), path)
    return path


def test_round_trip(spark, written):
    rows = warc.read_pages(warc.read_records(spark, written)).collect()
    assert len(rows) == len(PAGES) and all(r["valid"] for r in rows)
    targets = {}
    for page, _, html, _ in PAGES:
        if html and len(html.encode()) >= 1_000 and page is not None:
            targets[html] = max(page, targets.get(html, page))
    want = []
    for page, _, html, _ in PAGES:
        body, target = (html or "").encode(), targets.get(html, page)
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if target == page else "revisit", None if target == page else target, body if target == page else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    kinds = {r["kind"]: r["count"] for r in warc.read_records(spark, written).groupBy("kind").count().collect()}
    assert kinds["continuation"] > 10 and kinds["revisit"] == 4


def test_missing_segments_and_changed_bytes_are_not_valid(spark, written):
    records = warc.read_records(spark, written)
    for damaged in (records.where("segment is null or segment <> 2"), records.where("segment is null or total is null"),
                    records.withColumn("block", F.when(F.col("segment") == 3, F.col("block").substr(F.lit(2), F.lit(10**6))).otherwise(F.col("block")))):
        rows = warc.read_pages(damaged).collect()
        bad = {r["page_id"] for r in rows if not r["valid"]}
        assert bad == {None, 9, 10} - ({None} - {r["page_id"] for r in rows}) and len(rows) == len(PAGES)
    orphans = warc.read_pages(records.where("segment is null or segment > 1")).where("not valid").collect()
    assert {r["record_type"] for r in orphans} == {"damaged"}


def test_a_foreign_archive_of_many_members(spark):
    import gzip
    import time

    records = [("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (i, 40 + i % 900)).encode()
               + b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n".ljust(40 + i % 900, b"b") + warc.END.encode() for i in range(40_000)]
    data = b"".join(gzip.compress(r, 1) for r in records)
    begun = time.time()
    assert warc.unzipped(data) == b"".join(records)
    assert time.time() - begun < 5
    assert warc.unzipped(data[:-7]).startswith(b"".join(records[:-1])) and warc.unzipped(b"plain") == b"plain" and warc.unzipped(b"") == b""
    path = folder(spark, "warc-foreign")
    java = spark.sparkContext._jvm.org.apache.hadoop.fs
    out = java.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(java.Path(path + "/part-0.warc.gz"))
    out.write(b"".join(gzip.compress(r) for r in records[:500]))
    out.close()
    pages = warc.read_pages(warc.read_records(spark, path))
    assert pages.where("record_type = 'response'").count() == 500


def test_stream_framing():
    good = ("WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" + warc.END).encode()
    kinds = [r["kind"] for r in warc.parse_stream(good + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nxy\r\n\r\n" + good)]
    assert kinds == ["response", "damaged", "response"]
    assert list(warc.parse_stream(b"")) == []


def test_chunked_framing():
    assert warc.decode_chunked(b"3;x=y\r\nabc\r\nA\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    assert warc.decode_chunked(b"0\r\n\r\n") == b""
    for broken in (b"", b"3\r\nab", b"z\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        assert warc.decode_chunked(broken) is None


def test_empty_table(spark):
    path = folder(spark, "warc-empty")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_pages(warc.read_records(spark, path)).count() == 0
