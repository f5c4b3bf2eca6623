"""Token-ID output: Parquet list columns in document order, with chosen encodings, row groups and page indexes."""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.store import folder

END_ID = 2
#: Row groups are what a reader skips by statistics, pages what it skips by the page index (min and max of doc_id).
ROW_GROUP, PAGE = 16 * 1024 * 1024, 64 * 1024
BATCH_CHARS, SLICE = 2_000_000, 500  # characters encoded together, and rows of an Arrow batch turned to Python objects at once
TOGETHER = 1_000  # unseen chunks encoded as one text
MEMO, MEMO_WORD = 500_000, 64  # chunks in each of the two generations that a worker process remembers, and their characters at most

#: Unicode White_Space, Latin letters, and ASCII that is neither: between them the byte-level pre-tokenizer cuts in every
#: context, before a run of white space that follows anything else and between such a letter and such ASCII.
SPACE = "\t-\r \x85\xa0  -     　"
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
OTHER = r"!-@\[-`{-~"
#: By code point: 1, 2, 3 for these three, 0 for the rest.
KINDS = np.zeros(sys.maxunicode + 1, np.uint8)
for kind, signs in enumerate((SPACE, LETTER, OTHER), 1):
    KINDS[[ord(c) for c in re.findall(f"[{signs}]", "".join(map(chr, range(0x3001))))]] = kind
#: Characters on which definitions of white space disagree: such a text is encoded in one piece.
DISPUTED = re.compile("[\x1c-\x1f᠎​]")


def chunked(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The texts' chunks, end to end, as places in a list of different chunks; that list; chunks up to the end of each text."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    kinds = KINDS[points]
    cuts = np.zeros(len(points) + 1, bool)
    space, letter = kinds == 1, kinds == 2
    cuts[1:-1] = (space[1:] & ~space[:-1]) | ((kinds[1:] == 3) & letter[:-1])
    cuts[0] = cuts[ends] = True
    starts = np.flatnonzero(cuts)
    upto = np.searchsorted(starts, ends)
    raw = joined.encode()
    if len(raw) > len(points):
        width = np.ones(len(points), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            width += points >= least
        starts = np.append(0, np.cumsum(width, dtype=np.int64))[starts]
    pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
    return pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), upto


class Encoder:
    """Texts -> bytes of little-endian unsigned 32-bit ids.

    A text is the concatenation of its chunks' ids.  The memory is asked once a batch for each different chunk; chunks not seen before
    are encoded together and remembered.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # Texts that spell an added token are encoded in one piece: it may stand anywhere in them.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Ids whose first byte is a space, which byte-level tokens spell as this letter and no other byte does.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True

    def _encoded(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _remember(self, chunks: list[str]) -> None:
        """Chunks of one space and a printed character start where a text is always cut: many are encoded as one text, and its ids
        are dealt back by the spaces they start with, one a chunk."""
        plain = [c for c in chunks if c[0] == " " and len(c) > 1 and not c[1].isspace()]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            raw = self._encoded(["".join(some)])[0]
            starts = (4 * np.flatnonzero(self.spaced[np.frombuffer(raw, "<u4")])).tolist()
            self.memo.update(zip(some, [raw[lo:hi] for lo, hi in zip(starts, [*starts[1:], len(raw)])], strict=True))
        if len(plain) < len(chunks):
            rest = [c for c in chunks if c not in self.memo]
            self.memo.update(zip(rest, self._encoded(rest)))

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Different chunks' ids.  What is still met moves over from the older generation; the rest goes with it."""
        if len(self.memo) >= MEMO:
            self.memo, self.older = {}, self.memo
        found = list(map(self.memo.get, chunks))
        unknown = [i for i, ids in enumerate(found) if ids is None]
        kept = {c: self.older[c] for c in map(chunks.__getitem__, unknown) if c in self.older}
        self.memo.update(kept)
        new = [c for c in map(chunks.__getitem__, unknown) if c not in kept]
        self._remember(new)
        for i in unknown:
            found[i] = self.memo[chunks[i]]
        for c in new:
            if len(c) > MEMO_WORD:
                del self.memo[c]
        return found

    def ids(self, texts: list[str | None]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if t and (DISPUTED.search(t) or self.added and self.added.search(t))}
        cut = ["" if i in whole else t or "" for i, t in enumerate(texts)]
        places, chunks, ends = chunked(cut)
        found = self._known(chunks)
        # Each place takes its chunk's ids from all chunks' ids, laid end to end.
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        laid, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        n = size[places]
        upto = np.append(0, np.cumsum(n))
        at = np.repeat(first[places] - upto[:-1], n)
        at += np.arange(len(at))
        raw, bounds = laid[at].tobytes(), (4 * upto[ends]).tolist()
        out = [raw[lo:hi] for lo, hi in zip([0, *bounds], bounds)]
        for i in whole:
            out[i] = self._encoded([texts[i]])[0]
        return out


def encoder(tokenizer_path: str) -> Encoder:
    """The worker process's encoder: tasks that follow in the same process find its memory filled."""
    kept = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders")).__dict__
    if tokenizer_path not in kept:
        kept[tokenizer_path] = Encoder(tokenizer_path)
    return kept[tokenizer_path]


def tokenise(tokenizer_path: str, end_id: int):
    """(doc_id, text) -> (doc_id, n_tokens, tokens), rows in the order they came."""
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32()))])

    def pack(docs: list, encoded: list[bytes]) -> pa.RecordBatch:
        sizes = [len(e) // 4 for e in encoded]
        values = np.frombuffer(b"".join(encoded), "<i4")
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer_path)
        docs, texts, held = [], [], 0
        slices = (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))
        for part in slices:
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                docs.append(doc), texts.append(text)
                held += len(text or "")
                if held >= BATCH_CHARS:
                    yield pack(docs, [e + end for e in codes.ids(texts)])
                    docs, texts, held = [], [], 0
        if docs:
            yield pack(docs, [e + end for e in codes.ids(texts)])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Tokenise whole texts and write (doc_id, n_tokens, tokens) in ascending doc_id order, one range of ids per file.

    Texts are dealt to ranges before they are encoded, so that sampling the ranges costs a scan and no tokenising.  The range
    key ends with the text's hash: rows that share one doc_id (null comes first) may fill several files.
    Token ids have few distinct values and are dictionary encoded; doc_id and n_tokens are delta encoded (format version 2).
    A null text is empty: its list is the end id alone.
    """
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie")
    ordered = dealt.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    encoded = ordered.mapInArrow(tokenise(tokenizer_path, end_id), "doc_id long, n_tokens int, tokens array<int>")
    (encoded.write.option("parquet.block.size", row_group).option("parquet.page.size", page).option("parquet.writer.version", "v2")
     .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#tokens.list.element", "true")
     .option("parquet.page.row.count.limit", 2_000).option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and n_tokens alone: the token column's pages are not read."""
    return spark.read.parquet(path).select("doc_id", "n_tokens")


def read_tokens(spark: SparkSession, path: str, which: Column | None = None) -> DataFrame:
    """Token lists, of the rows that a filter on doc_id picks: row groups and pages outside it are skipped."""
    stored = spark.read.parquet(path)
    return stored if which is None else stored.where(which)


def checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, doc_id, tokens) -> (file, at, doc_id, n_tokens, ids_crc32) from the ids read."""
    for batch in batches:
        lists = batch.column(3)
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(values[lo:hi].tobytes()) for lo, hi in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.diff(ends).astype("i8")), pa.array(crc, pa.int64())],
                                         names=["file", "at", "doc_id", "n_tokens", "ids_crc32"])


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: each row's place in the stream of all ids.

    Files are ranges of doc_id, and a file's name holds its number, which may outgrow its zeros: running sums inside files, plus one
    small row per file.
    """
    stored = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), "doc_id", "tokens")
    rows = stored.mapInArrow(checksums, "file string, at long, doc_id long, n_tokens long, ids_crc32 long")
    inside = rows.withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("file").orderBy("at")))
    files = read_metadata(spark, path).groupBy(F.input_file_name().alias("path")).agg(F.sum("n_tokens").alias("n"))
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "n")
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    skip = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return inside.join(skip, "file").select("doc_id", (F.col("skip") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the table to a new shared folder and describe it from what was written.  An empty table gives no rows."""
    spark = docs.sparkSession
    path = folder(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return token_positions(spark, path)
