"""Line dedup: ranges of line hashes in (document, position) order, first occurrences streamed, bitmaps returned."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.store import stage

#: Stripped from both ends of a line; what else is white stays.
BLANK = " \t\n\x0b\x0c\r"
#: A null doc_id counts as one document after all others.
LAST = 2**63 - 1


def line_keys(min_chars: int):
    """Per line of at least ``min_chars`` code points: 128 hash bits, document, hash of its text, position."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs, rows, positions = [], [], [], []
            for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for pos, line in enumerate((text or "").split("\n")):
                    key = line.strip(BLANK)
                    if len(key) >= min_chars:
                        digests.append(xxhash.xxh3_128_digest(key.encode().lower()))
                        docs.append(doc), rows.append(row), positions.append(pos)
            bits = np.frombuffer(b"".join(digests), ">i8").astype("i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(positions, pa.int32())],
                names=["hi", "lo", "doc", "row", "pos"])

    return run


def first_occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream one sorted range.  kind 0: a line to drop; 1: a line of the range's first key, in that key's first document
    here, which an earlier range may take over; 2: a key at either end of the range and its first document here."""
    now = None  # hi, lo, first document of the key being read
    first = None
    for batch in batches:
        hi, lo, doc, row, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(hi):
            continue
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        new[0] = now is None or (hi[0], lo[0]) != now[:2]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        leads = doc[starts]
        lead = leads[group] if new[0] else np.where(group >= 0, np.append(leads, 0)[group], now[2])
        out = []
        if first is None:
            first = (int(hi[0]), int(lo[0]))
            out.append((hi[:1], lo[:1], doc[:1], row[:1], pos[:1], 2))
        drop = doc != lead
        out.append(tuple(x[drop] for x in (hi, lo, doc, row, pos)) + (0,))
        open_ = ~drop & (hi == first[0]) & (lo == first[1])
        out.append(tuple(x[open_] for x in (hi, lo, doc, row, pos)) + (1,))
        now = (hi[-1], lo[-1], lead[-1])
        yield _rows(out)
    if now is not None:
        yield _rows([(np.array([now[0]]), np.array([now[1]]), np.array([now[2]]), np.array([0]), np.array([0]), 2)])


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate([p[i] for p in parts]).astype("i8") for i in range(4)]
    pos = np.concatenate([p[4] for p in parts]).astype("i4")
    kind = np.concatenate([np.full(len(p[0]), p[5], "i1") for p in parts])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, pos, kind)], names=["hi", "lo", "doc", "row", "pos", "kind"])


def pack_bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dropped positions -> deflated bits, 1 for a line that stays; lines after the last bit stay."""
    for batch in batches:
        maps = []
        for dropped in batch.column(2).to_pylist():
            keep = np.ones(max(dropped) + 1, np.uint8)
            keep[dropped] = 0
            maps.append(len(keep).to_bytes(4, "little") + zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc", "row", "keep_bits"])


def keep_bits(packed: bytes | None, n_lines: int) -> np.ndarray:
    """Decode a bitmap to one boolean per line; null: all stay."""
    keep = np.ones(n_lines, bool)
    if packed is not None:
        n = int.from_bytes(packed[:4], "little")
        keep[:n] = np.unpackbits(np.frombuffer(zlib.decompress(packed[4:]), np.uint8), count=n)
    return keep


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs (doc_id, text) -> (doc, row, keep_bits), a row for each document that loses a line.

    ``doc`` is doc_id (null: ``LAST``), ``row`` the hash of the text, so that rows sharing a doc_id keep their own
    positions.  Hashes go to ranges of (hash, document): a line in a third of all documents spans several
    ranges, and only the key at a range's ends is settled afterwards, from one row per range.
    """
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("row"), "text")
    keys = stage(named.mapInArrow(line_keys(min_chars), "hi long, lo long, doc long, row long, pos int"), "lines")
    ordered = keys.repartitionByRange("hi", "lo", "doc", "row", "pos").sortWithinPartitions("hi", "lo", "doc", "row", "pos")
    found = stage(ordered.mapInArrow(first_occurrences, "hi long, lo long, doc long, row long, pos int, kind byte"), "firsts")
    ends = found.where("kind = 2").groupBy("hi", "lo").agg(F.min("doc").alias("lead"))
    late = found.where("kind = 1").join(ends, ["hi", "lo"]).where("doc > lead")
    dropped = found.where("kind = 0").select("doc", "row", "pos").union(late.select("doc", "row", "pos"))
    # Rows that repeat a document whole have the same positions: a set.
    return dropped.groupBy("doc", "row").agg(F.collect_set("pos").alias("dropped")).mapInArrow(
        pack_bits, "doc long, row long, keep_bits binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All columns of docs with the kept lines as text, then __n_lines and __n_dropped."""
    names = docs.columns
    named = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("__doc"), F.xxhash64("text").alias("__row"))
    maps = bitmaps.select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("keep_bits").alias("__keep"))
    # The bitmaps are the small side of each partition: a hash table of them spares sorting the texts.
    joined = named.join(maps.hint("shuffle_hash"), ["__doc", "__row"], "left").select(*names, "__keep")
    at = names.index("text")
    fields = [f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, drops = [], [], []
            for text, packed in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                lines = (text or "").split("\n")
                keep = keep_bits(packed, len(lines))
                counts.append(len(lines)), drops.append(int((~keep).sum()))
                texts.append("\n".join(line for line, k in zip(lines, keep) if k) if drops[-1] else text or "")
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], names=[*names, "__n_lines", "__n_dropped"])

    return joined.mapInArrow(run, ", ".join([*fields, "__n_lines long", "__n_dropped long"]))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Documents without the lines that an earlier document (by doc_id) holds.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.  Keys under ``min_chars`` code points
    stay everywhere.  In the smallest doc_id that holds a key all its lines stay.  A null text is one empty line and comes
    back empty; rows that share a doc_id are one document; null doc_ids are one document after all others.  Extra columns
    pass through unchanged.  Adds __n_lines (before) and __n_dropped.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_chars))
