import random
import re
from zlib import crc32

import numpy as np
import pytest

from support import empty
from tidemark.llm import gru_language as gru

SOUNDS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ré", "sö", "vü", "zé"], "cc": ["ing", "the", "wh", "ly"]}


def sentences(spark, n=240):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        words = ["".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 120))]
        rows.append((i, " ".join(words), lang, "s", 0.1, "clash"))
    long = " ".join(["kalo"] * 40_000)
    rows += [(n, None, "aa", "s", 0.1, "x"), (n + 1, "", "aa", "s", 0.1, "x"), (n + 2, "123 -- 45", "bb", "s", 0.1, "x"), (None, "the whing", "cc", None, None, None),
             (n + 3, long, None, None, None, None), rows[0], rows[0], (n + 4, "x", "zz", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, __x string")


def test_gradient_equals_differences_of_the_loss():
    rng = np.random.default_rng(0)
    w = gru.starting_weights(3, 4)
    text = rng.integers(97, 105, (gru.WINDOW, 5))
    text[100:, 2] = gru.PAD
    truth = np.array([0, 1, 2, 0, 1])
    _, gradient = gru.loss_and_gradient(w, text, truth)
    for name in w:
        for flat in np.argsort(-np.abs(gradient[name]).ravel())[:4]:
            at = np.unravel_index(flat, w[name].shape)
            w[name][at] += 1e-5
            above = gru.loss_and_gradient(w, text, truth)[0]
            w[name][at] -= 2e-5
            below = gru.loss_and_gradient(w, text, truth)[0]
            w[name][at] += 1e-5
            assert gradient[name][at] == pytest.approx((above - below) / 2e-5, rel=1e-4, abs=1e-8)


def slow_labels(w, text):
    """One text, byte by byte, with the textbook recurrence: mean probabilities and labelled positions."""
    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    hidden = w["u"].shape[1]
    sums, labels = np.zeros(len(w["c"])), np.zeros(len(w["c"]), int)
    for at in range(0, len(text), gru.WINDOW):
        window = text[at:at + gru.WINDOW]
        states = []
        for way, order in ((0, window), (1, window[::-1])):
            h, seen = np.zeros(hidden), []
            for byte in order:
                x, m = w["x"][way, byte], h @ w["u"][way]
                z, r = sigmoid(x[:hidden] + m[:hidden]), sigmoid(x[hidden:2 * hidden] + m[hidden:2 * hidden])
                h = z * h + (1 - z) * np.tanh(x[2 * hidden:] + r * m[2 * hidden:])
                seen.append(h)
            states.append(seen if way == 0 else seen[::-1])
        for f, b in zip(*states):
            e = np.exp(np.concatenate([f, b]) @ w["v"] + w["c"])
            sums += e / e.sum()
            labels[np.argmax(e)] += 1
    return sums / max(1, len(text)), labels


def test_reader_equals_the_recurrence_byte_by_byte():
    import pyarrow as pa

    w = gru.starting_weights(3, 5, seed=2)
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 127, 128, 129, 700, 5)] + [None]
    out = next(gru.label_texts(w, 1)([pa.record_batch({"id": list(range(8)), "t": pa.array(texts, pa.binary())})]))
    for text, means, positions in zip(texts, out.column("__means").to_pylist(), out.column("__positions").to_pylist()):
        wanted, labels = slow_labels(w, text or b"")
        assert means == pytest.approx(wanted, abs=1e-5) and sum(positions) == len(text or b"")
        assert np.abs(np.array(positions) - labels).sum() <= 2  # ties in single precision


def test_predictions(spark):
    docs = sentences(spark)
    found = gru.predict_languages(docs)
    assert found.columns == [*docs.columns, "__lang", "__score", "__shares"]
    rows = found.collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang"] in SOUNDS and re.search("[a-z]", r["text"] or "")]
    assert len(held) > 30 and sum(r["__lang"] == r["lang"] for r in held) / len(held) > 0.95
    for r in rows:
        assert 0 <= r["__score"] <= 1
        if r["text"] is None or not re.search(r"[^\W\d_]", r["text"]):
            assert (r["__lang"], r["__score"]) == ("und", 0.0)
        else:
            assert r["__lang"] in {"aa", "bb", "cc", "zz"} and sum(r["__shares"].values()) == pytest.approx(1)
    assert next(r for r in rows if r["text"] and len(r["text"]) > 100_000)["__lang"] == "aa"
    again = {(r["doc_id"], r["text"]): r["__score"] for r in gru.predict_languages(docs).collect()}
    assert all(again[(r["doc_id"], r["text"])] == pytest.approx(r["__score"]) for r in rows)


def test_learned_from_the_right_rows_only(spark):
    docs = sentences(spark)
    sample = gru.fit_sample(docs, most=20)
    rows = sample.collect()
    assert all(crc32(str(r["doc_id"]).encode()) % 5 for r in rows) and {r["lang"] for r in rows} <= {"aa", "bb", "cc", "zz"}
    assert max(sum(r["lang"] == x for r in rows) for x in SOUNDS) == 20
    assert all(0 < len(r["piece"]) <= gru.FIT_BYTES for r in rows)
    # One id repeated many times is one piece.
    many = docs.where("doc_id = 1").crossJoin(spark.range(5_000).select()) if crc32(b"1") % 5 else docs
    assert gru.fit_sample(many).count() == many.where("lang is not null and doc_id is not null and length(text) > 0").select("doc_id", "lang").distinct().where(~gru.held_out("doc_id")).count()


def test_nothing_to_learn_and_empty_tables(spark):
    docs = sentences(spark, 10)
    assert {(r["__lang"], r["__score"]) for r in gru.predict_languages(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("false").unionByName(docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "score", "__x"))).collect()} == {("und", 0.0)}
    assert gru.predict_languages(empty(spark)).count() == 0
    assert gru.predict_languages(empty(spark).unionByName(empty(spark))).columns[:8] == empty(spark).columns[:8]
