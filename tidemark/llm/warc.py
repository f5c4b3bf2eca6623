"""WARC archives: writing pages as records, and reading them back with segment reassembly and transfer decoding."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEGMENT = 32 * 1024  # characters of a record's block before it goes on in a continuation record
CHUNK = 8 * 1024  # characters of a transfer chunk
LEAST_REVISIT = 1_000  # bytes from which equal payloads are stored once
RECORDS_PER_FILE = 2_000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16])}>"


def _record(kind: str, rid: str, block: str, fields: list[tuple[str, object]]) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *fields, ("Content-Length", len(block.encode()))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n" + block


def page_records(page_id: int | None, url: str | None, html: str, digest: str, target: int | None) -> list[str]:
    """The records of one page: one revisit, or a response and its continuations."""
    rid = record_id(page_id, digest)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    about = [("WARC-Target-URI", uri), ("X-Page-ID", page_id), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    status = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = ("Content-Type", "application/http;msgtype=response")
    if target is not None:
        back = [("WARC-Refers-To", record_id(target, digest)), ("WARC-Profile", PROFILE)]
        return [_record("revisit", rid, f"{status}Content-Length: {len(html.encode())}\r\n\r\n", [*about, kind, *back])]
    chunks = [html[i : i + CHUNK] for i in range(0, len(html), CHUNK)]
    body = "".join(f"{len(c.encode()):x}\r\n{c}\r\n" for c in chunks) + "0\r\n\r\n"
    block = f"{status}Transfer-Encoding: chunked\r\n\r\n{body}"
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        return [_record("response", rid, block, [*about, kind])]
    total = len(block.encode())
    out = [_record("response", rid, parts[0], [*about, kind, ("WARC-Segment-Number", 1)])]
    for n, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.UUID(rid[10:-1]), str(n))}>"
        last = [("WARC-Segment-Total-Length", total)] if n == len(parts) else []
        out.append(_record("continuation", own, part, [("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", n), *last]))
    return out


def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, digest, target) -> one row per record."""
    for batch in batches:
        out: list[str] = []
        held = 0
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            out += page_records(*row)
            held += len(row[2])
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str) -> None:
    """pages (page_id, url, html) -> gzipped WARC files of at most ``RECORDS_PER_FILE`` records.

    Of records with equal payloads of 1000 bytes or more, that of the largest page_id is a response and the others revisit it.
    The roles come from (page_id, digest) rows alone; pages meet them by page, so that a payload shared by a third of all pages
    is no hot key for the texts.  A null html is an empty payload; a null page_id revisits if there is another, rows
    repeated whole have the same role and the same record.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    keys = named.select("page_id", "digest", F.octet_length("html").alias("n"))
    targets = keys.where(f"n >= {LEAST_REVISIT}").groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("c")).where("c > 1").select("digest", "target")
    # The digest is not the hot side's only key here: rows are (page_id, digest), and a third of them may share one target.
    roles = keys.select("page_id", "digest").distinct().join(targets, "digest").where(~F.col("target").eqNullSafe(F.col("page_id")))
    roles = roles.select(F.struct("page_id", "digest").alias("key"), "target")
    placed = named.withColumn("key", F.struct("page_id", "digest")).join(roles.hint("shuffle_hash"), "key", "left")
    lines = placed.select("page_id", "url", "html", "digest", "target").mapInArrow(render, "value string")
    lines.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


#: Bytes of an archive unzipped at a time.
FEED = 16 * 1024

FIELDS = "record_id string, kind string, origin string, segment int, total long, page_id long, refers_to string, digest string, block binary"


def parse_stream(data: bytes) -> Iterator[dict]:
    """Records of one file.  Where the framing is broken a ``damaged`` record is given and reading goes on at the next version line."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        head = data[at:stop] if stop >= 0 else b""
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = fields.get("content-length", "")
        end = stop + 4 + int(length) if length.isdigit() else -1
        if not lines[0].startswith("WARC/1.") or end < 0 or data[end : end + 4] != b"\r\n\r\n":
            again = data.find(b"\r\n\r\nWARC/1.", at + 1)
            yield {"kind": "damaged", "block": data[at : again if again >= 0 else len(data)]}
            at = again + 4 if again >= 0 else len(data)
            continue
        digest = fields.get("warc-payload-digest", "")
        number = lambda name: int(fields[name]) if re.fullmatch(r"-?\d+", fields.get(name, "")) else None
        yield {"record_id": fields.get("warc-record-id"), "kind": fields.get("warc-type"), "origin": fields.get("warc-segment-origin-id"),
               "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"), "page_id": number("x-page-id"),
               "refers_to": fields.get("warc-refers-to"), "digest": base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None, "block": data[stop + 4 : end]}
        at = end + 4


def unzipped(data: bytes) -> bytes:
    """All members of a gzip file (one per record or one for all), or the bytes as they are; a cut member gives what it has.

    Members are fed in blocks, so what a member leaves over is at most a block and many small members take linear time.
    """
    out, view, at = [], memoryview(data), 0
    while data[at:at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            block = view[at:at + FEED]
            out.append(member.decompress(block))
            at += len(block) - len(member.unused_data)
    out.append(view[at:])
    return b"".join(out)


def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()),
                        ("page_id", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary())])
    for batch in batches:
        for content in batch.column(0):
            out, held = [], 0
            for record in parse_stream(unzipped(content.as_py())):
                out.append({name: record.get(name) for name in schema.names})
                held += len(record["block"])
                if held > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, FIELDS)


def decode_chunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken or has no last chunk."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        size = body[at:stop].split(b";")[0].strip() if stop >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if body[stop + 2 + n : stop + 4 + n] != b"\r\n":
            return None
        out.append(body[stop + 2 : stop + 2 + n])
        at = stop + 4 + n


def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_id, kind, page_id, refers_to, digest, total, copies, blocks in order, whole) -> the page's payload, checked.

    ``valid`` is false where a segment is missing, the total length or the digest differs or the framing is broken.
    """
    schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.string()), ("copies", pa.int64()),
                        ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("valid", pa.bool_())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            block = b"".join(r["blocks"])
            head, _, body = block.partition(b"\r\n\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
            valid = r["whole"] and (r["total"] is None or r["total"] == len(block))
            if r["kind"] == "revisit":
                payload, size, digest = None, int(fields.get(b"content-length", b"0")), r["digest"]
            else:
                payload = decode_chunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                valid = valid and payload is not None
                size, digest = (len(payload), hashlib.sha1(payload).hexdigest()) if payload is not None else (None, None)
                valid = valid and r["digest"] in (None, digest)
            out.append({**{k: r[k] for k in ("record_id", "kind", "page_id", "refers_to", "copies")}, "payload": payload, "payload_bytes": size, "payload_digest": digest, "valid": valid})
        yield pa.RecordBatch.from_pylist(out, schema)


def read_pages(records: DataFrame, payloads: bool = True) -> DataFrame:
    """record_id, record_type, page_id, refers_to (page id), payload, payload_bytes, payload_digest, valid: one row per page record.

    Continuations are grouped by their origin's record id and put in segment order; whole records pass without a shuffle.  A segment
    that occurs several times counts once, and the page comes back as often as its first segment was there.  Damaged records
    and continuations without an origin come back as rows of type ``damaged`` that are not valid.
    """
    usable = F.col("kind").isin("response", "revisit", "continuation")
    single = records.where(usable & F.col("segment").isNull()).select(
        "record_id", "kind", "page_id", "refers_to", "digest", "total", F.lit(1).cast("long").alias("copies"), F.array("block").alias("blocks"), F.lit(True).alias("whole"))
    parts = records.where(usable & F.col("segment").isNotNull()).withColumn("of", F.coalesce("origin", "record_id"))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    once = parts.groupBy("of", "segment").agg(*map(first, ("kind", "page_id", "digest", "total", "block")), F.count("*").alias("copies"))
    lead: Column = F.col("segment") == 1
    joined = once.groupBy("of").agg(
        F.max(F.when(lead, F.col("kind"))).alias("kind"), F.max(F.when(lead, F.col("page_id"))).alias("page_id"), F.max(F.when(lead, F.col("digest"))).alias("digest"),
        F.max("total").alias("total"), F.max(F.when(lead, F.col("copies"))).alias("copies"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("s"))
    whole = F.col("total").isNotNull() & F.col("kind").isNotNull() & (F.element_at("s", -1)["segment"] == F.size("s"))
    joined = joined.select(F.col("of").alias("record_id"), F.coalesce("kind", F.lit("damaged")).alias("kind"), "page_id", F.lit(None).cast("string").alias("refers_to"), "digest", "total",
                           F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.col("s.block").alias("blocks"), whole.alias("whole"))
    damaged = records.where(~F.coalesce(usable, F.lit(False))).select(
        "record_id", F.lit("damaged").alias("kind"), "page_id", "refers_to", "digest", "total", F.lit(1).cast("long").alias("copies"), F.array("block").alias("blocks"), F.lit(False).alias("whole"))
    decoded = single.unionByName(joined).unionByName(damaged).mapInArrow(
        decode, "record_id string, kind string, page_id long, refers_to string, copies long, payload binary, payload_bytes long, payload_digest string, valid boolean")
    if not payloads:
        decoded = decoded.drop("payload")
    pages = decoded.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies").withColumnRenamed("kind", "record_type")
    # The page behind a record id: headers only, of responses.
    known = records.where("kind = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("target"))
    return pages.join(known, "refers_to", "left").withColumn("refers_to", F.col("target")).drop("target")
