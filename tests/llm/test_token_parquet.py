import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from support import corpus, documents, empty
from tidemark.llm.store import folder
from tidemark.llm.token_parquet import Encoder, encoder, read_metadata, read_tokens, token_output, token_positions, write_tokens

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


def plain():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_chunks_equal_the_whole_text():
    rng = np.random.default_rng(5)
    encode, ids = plain(), encoder(PATH)
    parts = ["a", "Bc", "b!", " ", "  ", "\n", "\t", "\x1c", "'s", "'", "é", "ß×", "β", "e\u0301", "世", "\u180e", "\u200b", "\u2028", "\xa0", "<|endoftext|>", "9", "_", "\r\n", "...", "“q”", "x" * 70]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(6_000)] + [None]
    for text, got in zip(texts, ids.ids(texts)):
        assert got == np.array(encode(text or ""), "<u4").tobytes(), repr(text)


def test_round_trip(spark):
    docs = documents(spark, corpus(80)).repartition(6)
    encode, start, want = plain(), 0, []
    for doc, text in sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0])):
        tokens = encode(text or "") + [2]
        want.append((doc, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
    got = sorted(map(tuple, token_output(docs, PATH).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert sorted((g[1:] for g in got), key=str) == sorted(want, key=str)
    for before, after in zip(got, got[1:]):
        assert after[0] == before[0] + before[2]
    assert got[0][0] == 0 and [g[1] for g in got if g[1] is not None] == sorted(g[1] for g in got if g[1] is not None)


def test_an_added_token_in_a_text_is_one_id():
    ids = encoder(PATH).ids(["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftex b", "a < |endoftext|>"])
    for text, got in zip(["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftex b", "a < |endoftext|>"], ids):
        assert got == np.array(tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(ids[1]) == 4


def test_a_word_is_remembered_over_half_a_million_others(monkeypatch):
    seen = []
    codes = Encoder(PATH)
    monkeypatch.setattr(codes, "_remember", lambda chunks: (seen.extend(chunks), codes.memo.update(dict.fromkeys(chunks, b""))))
    words = lambda lo, hi: "".join(f" {''.join(chr(97 + int(d)) for d in str(i))}" for i in range(lo, hi))
    for lo in range(0, 600_000, 60_000):
        codes.ids([words(lo, lo + 60_000)])
    assert len(seen) == len(set(seen)) == 600_000
    codes.ids([words(0, 100)])
    assert len(seen) == 600_000


def test_many_chunks_encoded_as_one_text_get_their_own_ids():
    rng = np.random.default_rng(6)
    letters = np.array(list("aeinrst.,'9_-") + ["é", "ß", "世", "\u0120", "“", "\U0001f600"])
    words = ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(5_000)]
    encode = plain()
    assert Encoder(PATH).ids([" ".join(words)])[0] == np.array(encode(" ".join(words)), "<u4").tobytes()


def test_the_memory_is_asked_once_a_batch_for_each_chunk():
    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return dict.get(self, key)

        def __getitem__(self, key):
            Counted.asked += 1
            return dict.__getitem__(self, key)

    codes, text = Encoder(PATH), "été, a rock'n'roll\u3000\xa0 \n 世 b! " * 500
    codes.memo = Counted()
    assert codes.ids([text, "", None, text])[3] == np.array(plain()(text), "<u4").tobytes()
    assert 0 < Counted.asked < 100
    assert codes.ids(["", None]) == [b"", b""] and codes.ids([]) == []


def test_files_are_ordered_by_their_number(spark):
    path = folder(spark, "tokens-many")
    docs = spark.createDataFrame([(1, "one"), (2, "two words")], "doc_id long, text string")
    for number, doc in (("99999", 1), ("100000", 2)):
        write_tokens(docs.where(F.col("doc_id") == doc), path + number, PATH)
    java = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = java.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(java.Path(path))
    for number in ("99999", "100000"):
        for status in fs.globStatus(java.Path(path + number + "/part-*")):
            if spark.read.parquet(status.getPath().toString()).count():
                fs.rename(status.getPath(), java.Path(f"{path}/part-{number}-x.parquet"))
    first, second = token_positions(spark, path).orderBy("doc_id").collect()
    assert (first["start"], second["start"]) == (0, first["n_tokens"])


def test_format_and_selective_reads(spark):
    path = folder(spark, "tokens-test")
    write_tokens(documents(spark, corpus(60), repeat=False).select("doc_id", "text"), path, PATH)
    assert read_metadata(spark, path).columns == ["doc_id", "n_tokens"]
    plan = read_tokens(spark, path, F.col("doc_id").between(5, 9))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and read_tokens(spark, path, F.col("doc_id").between(5, 9)).count() == 5
    import glob

    file = glob.glob(f"{path.removeprefix('file:')}/part-*")[0]
    column = pq.ParquetFile(file).metadata.row_group(0)
    encodings = {column.column(i).path_in_schema: column.column(i).encodings for i in range(3)}
    assert "DELTA_BINARY_PACKED" in encodings["doc_id"] and "DELTA_BINARY_PACKED" in encodings["n_tokens"]
    assert any("DICTIONARY" in e for e in encodings["tokens.list.element"])


def test_empty_table(spark):
    assert token_output(empty(spark), PATH).count() == 0
