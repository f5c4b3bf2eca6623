import random
from zlib import crc32

import pytest

from support import empty
from tidemark.llm.quality_classifier import quality_scores
from tidemark.llm.toxicity import toxicity_scores
from tidemark.llm.zdict import fit_logistic, labelled_sample, probability

INSULTS = ("blockhead", "nitwit", "dunderhead")


def labelled(spark, n=500):
    rng = random.Random(3)
    syllables = ["ta", "ren", "mo", "sil", "vu", "kor", "bel", "nid", "pas", "ler"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(40, 200))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.6)
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words[rng.randrange(len(words))] = rng.choice(INSULTS)
        text = " ".join(words)
        docs.append((i, text if good else text.upper().replace(" ", "!! "), "xx", 0.1))
        labels.append((i, good, toxic))
    docs += [(n, None, None, None), (n + 1, "", "", 0.0), (None, "ta ren mo", "", 0.0), docs[0], (n + 2, "ta " * 60_000, "xx", 1.0)]
    labels += [(None, 1, 1), (n, None, None), labels[0]]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name, scores, at", [("quality", quality_scores, 0.5), ("toxic", toxicity_scores, 0.7)])
def test_held_out_accuracy(spark, name, scores, at):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r[name] for r in labels.dropna().collect()}
    out = scores(docs, labels)
    assert out.columns == [*docs.columns, "__score"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["__score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] in truth and crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = sum((r["__score"] >= at) == bool(truth[r["doc_id"]]) for r in held)
    assert len(held) > 100 and right / len(held) > 0.95, (right, len(held))
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["__score"]) == r["__score"]


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_without_labels_or_documents(spark, scores):
    docs, labels = labelled(spark, 10)
    none = labels.where("false")
    assert {r["__score"] for r in scores(docs, none).collect()} == {0.5}
    assert scores(empty(spark), labels).count() == 0
    one_class = labels.where("quality = 1 and toxic = 0")
    assert len({r["__score"] for r in scores(docs, one_class).collect()}) == 1


def test_the_sample_is_bounded_in_rows(spark):
    docs, labels = labelled(spark, 60)
    one = next(i for i in range(60) if crc32(str(i).encode()) % 3 != 1)
    many = docs.unionByName(spark.range(100_000).selectExpr(f"{one}L AS doc_id", "concat('text ', id % 1000) AS text", "'xx' AS lang", "0.0 AS score"))
    sample = labelled_sample(many, labels.unionByName(labels), "quality", {0: 9, 1: 9}).collect()
    assert len({r["doc_id"] for r in sample}) == len(sample) and max(sum(r["y"] == y for r in sample) for y in (0, 1)) <= 9
    everything = labelled_sample(many, labels, "quality", {0: 1_000, 1: 1_000}).collect()
    assert [r["text"] for r in everything if r["doc_id"] == one] == [min(r["text"] for r in docs.where(f"doc_id = {one}").collect() + [{"text": "text 0"}])]


def test_logistic_fit_finds_a_line():
    import numpy as np

    x = np.linspace(-3, 3, 400)[:, None]
    y = (x[:, 0] + np.sin(40 * x[:, 0]) > 0.5).astype(float)
    p = probability(fit_logistic(x, y), x)
    assert (np.diff(p) > 0).all() and abs(p.mean() - y.mean()) < 1e-3


def test_toxic_words_of_a_small_language(spark):
    """Each of 60 languages has its own insult: no beginning is held by 3 % of the toxic documents."""
    rng = random.Random(5)
    syllables = ["ta", "ren", "mo", "sil", "vu", "kor", "bel", "nid", "pas", "ler"]
    insults = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiou") for _ in range(5)) for _ in range(60)]
    docs, labels = [], []
    for i in range(2_700):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(30)]
        toxic = int(i % 2)
        if toxic:
            for _ in range(3):
                words[rng.randrange(30)] = insults[i // 2 % 60]
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [r for r in toxicity_scores(docs, labels).collect() if crc32(str(r["doc_id"]).encode()) % 3 == 1]
    caught = [r["__score"] >= 0.7 for r in held if r["doc_id"] % 2]
    assert len(caught) > 300 and sum(caught) / len(caught) > 0.8, sum(caught) / len(caught)
    assert sum(r["__score"] >= 0.7 for r in held if not r["doc_id"] % 2) < 0.05 * len(held)
