"""Toxicity by compression distance, window by window: a zstandard dictionary trained on ordinary text, once with the word
beginnings that set toxic text apart and once with filling.  None is trained on toxic text.

A window is one word with its separators.  It is compressed three times over, since zstandard stores so few bytes as they
are; after the first copy the others cost both dictionaries the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.quality_classifier import featurise, scored
from tidemark.llm.store import stage
from tidemark.llm.zdict import compressor, fit_logistic, labelled_sample, probability, trained, training_pieces

#: Bounds of the fit: labelled documents per class, pieces of the common dictionary, bytes of the two special parts.
FIT_ROWS = {1: 3_000, 0: 6_000}
PIECES = 2_000
COMMON, SPECIAL = 4 * 1024, 8 * 1024
LEVEL = 19
COPIES = 3
GAINS = (3, 4, 5, 6)  # bytes by which the toxic dictionary is shorter: calibrated thresholds
MARKS = 50_000  # beginnings of words that the driver gets at most, those of most evidence
LIFT, LEAST = 10.0, 3  # times as often as in ordinary documents; groups of toxic copies that hold a beginning
CUTS = (10.0, 20.0, 40.0, 80.0)  # log-likelihood ratio against ordinary text: one is chosen by cross-validation
FOLDS = 3
BANDS = 12  # pairs of min-hashes of 5-word shingles: documents that share one are copies, which are one piece of evidence
MEMO = 300_000
SEPARATORS = b"\"'()[]{}.,!?;:%#$&*|"
BLANKS = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(BLANKS).split()


def bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text bytes) -> doc_id and the keys that copies share."""
    rng = np.random.default_rng(7)
    turns = rng.integers(0, 2**63, (5, 1), dtype=np.uint64) * 2 + 1, rng.integers(0, 2**63, (2 * BANDS, 1), dtype=np.uint64) * 2 + 1
    for batch in batches:
        keys = []
        for text in batch.column(1).to_pylist():
            words = np.array([crc32(w) for w in words_of(text)], np.uint64)
            width = min(5, len(words))
            if not width:
                keys.append([])
                continue
            shingles = sum((words[i : len(words) - width + 1 + i] + np.uint64(1)) * turns[0][i] for i in range(width))
            shingles ^= shingles >> np.uint64(31)
            least = np.concatenate([((part := shingles[at : at + 4_096] * turns[1]) ^ (part >> np.uint64(29))).min(1, keepdims=True) for at in range(0, len(shingles), 4_096)], 1).min(1)
            pairs = least.reshape(BANDS, 2)
            mixed = pairs[:, 0] * turns[0][0] + pairs[:, 1] * turns[0][1] + np.arange(BANDS, dtype=np.uint64)
            keys.append(mixed.view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "keys"])


def with_folds(first: DataFrame) -> DataFrame:
    """The sample with ``copies``, the group of copies that a document belongs to, and the group's ``fold``.  The driver sees
    ``BANDS`` numbers per document of the bounded sample."""
    rows = first.select("doc_id", F.col("text").cast("binary")).mapInArrow(bands, "doc_id long, keys array<long>").orderBy("doc_id").collect()
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for r in rows:
        for key in r["keys"]:
            parent[root(("key", key))] = root(r["doc_id"])
    number: dict = {}
    named = [(d, number.setdefault(root(d), len(number))) for d in sorted({r["doc_id"] for r in rows})]
    groups = first.sparkSession.createDataFrame(named, "doc_id long, copies long")
    return stage(first.join(F.broadcast(groups), "doc_id").withColumn("fold", F.pmod(F.xxhash64("copies"), F.lit(FOLDS))), "folds")


def beginnings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, fold, copies, text bytes), sorted by copies and y -> beginnings of words (4 bytes or more, and the whole word) with the groups of
    copies of each fold and class that hold them."""
    counts: dict[tuple, Counter] = {}
    now, held, texts = None, set(), set()

    def flush() -> Iterator[pa.RecordBatch]:
        for (y, fold), found in counts.items():
            each, none = pa.array(list(found.values()), pa.int64()), pa.array([0] * len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([fold] * len(found), pa.int64()), none if y else each, each if y else none], names=["mark", "fold", "c0", "c1"])
        counts.clear()

    for batch in batches:
        for y, fold, copies, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now != (y, fold, copies):
                if now:
                    counts.setdefault(now[:2], Counter()).update(held)
                now, held, texts = (y, fold, copies), set(), set()
            if text in texts:
                continue
            texts.add(text)
            for word in set(words_of(text)):
                word = b" " + word
                held.update(word[:k] for k in range(5, min(len(word), 24) + 1))
                held.add(word[:64] + b" ")
        if sum(map(len, counts.values())) > 500_000:
            yield from flush()
    if now:
        counts.setdefault(now[:2], Counter()).update(held)
    yield from flush()


def evidence(c1, c0, toxic: int, ordinary: int) -> F.Column:
    """Log-likelihood ratio of one rate of a beginning per class against one common rate: grows with the documents that show it."""
    p = (c1 + c0) / F.lit(toxic + ordinary)
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return 2 * (term(c1, toxic * p) + term(toxic - c1, toxic * (1 - p)) + term(c0, ordinary * p) + term(ordinary - c0, ordinary * (1 - p)))


def telling(counts: DataFrame, docs: dict[tuple, int], out: int | None) -> list[tuple[bytes, int, float]]:
    """(beginning, groups of toxic documents, evidence) of what sets toxic text apart outside fold ``out``, most evidence first, of equal ones the longest."""
    folds = [k for k in range(FOLDS) if k != out]
    toxic, ordinary = (sum(docs.get((y, k), 0) for k in folds) for y in (1, 0))
    if not toxic or not ordinary:
        return []
    held = counts.select("mark", *(sum(F.col(f"c{y}_{k}") for k in folds).alias(f"c{y}") for y in (0, 1))).where(f"c1 >= {LEAST - 1}")
    lift = ((F.col("c1") + 0.5) / (toxic + 1)) / ((F.col("c0") + 0.5) / (ordinary + 1))
    rows = held.where(lift > LIFT).withColumn("g", evidence(F.col("c1"), F.col("c0"), toxic, ordinary)).where(
        (F.col("g") >= min(CUTS)) | F.expr("endswith(mark, X'20')")).orderBy(F.desc("g"), F.octet_length("mark").desc(), "mark").limit(MARKS).collect()
    return [(bytes(r["mark"]), r["c1"], r["g"]) for r in rows]


def special_text(found: list[tuple[bytes, int, float]], cut: float) -> bytes:
    """The toxic part of the dictionary: the beginnings with evidence of ``cut`` or more, after the words of toxic text that
    start with them, as far as ``SPECIAL`` bytes reach."""
    marks: list[bytes] = []
    chosen: set[bytes] = set()
    covered: set[bytes] = set()
    for mark, c1, g in found:
        starts = [mark[:k] for k in range(5, len(mark) + 1)] or [mark]
        if c1 >= LEAST and g >= cut and mark not in covered and not any(m in chosen for m in starts):
            marks.append(mark)
            chosen.add(mark)
            covered.update(starts)
    forms = [m[:-1] for m, _, _ in found if m.endswith(b" ") and any(m[:k] in chosen for k in range(1, len(m) + 1))]
    marks_text = b"".join(reversed(marks)) + b" "
    space = max(0, SPECIAL - len(marks_text))
    return b"".join(reversed(forms))[-space:] * bool(space) + marks_text if marks else b""


def gain_features(toxic: bytes, ordinary: bytes):
    """Features of a text: for each threshold, the logarithm of windows per thousand whose toxic size is shorter by as much."""

    def make():
        pair = compressor(toxic, LEVEL), compressor(ordinary, LEVEL)

        class Gains(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= MEMO:
                    self.clear()
                window = (b" " + word + b" ") * COPIES
                gain = self[word] = len(pair[1].compress(window)) - len(pair[0].compress(window))
                return gain

        memo = Gains()

        def features(text: bytes | None) -> list[float]:
            words = words_of(text)
            gains = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
            per = [1000 * int((gains >= g).sum()) / max(1, len(words)) for g in GAINS]
            return [float(np.log1p(p)) for p in per] + [float(min(gains.max(initial=0), 8))]

        return features

    return make


def counted(first: DataFrame) -> tuple[DataFrame, dict[tuple, int]]:
    """Groups of copies per beginning, class and fold, and groups per (class, fold)."""
    docs = {(r["y"], r["fold"]): r["n"] for r in first.groupBy("y", "fold").agg(F.count_distinct("copies").alias("n")).collect()}
    sums = [F.sum(F.when(F.col("fold") == k, F.col(f"c{y}")).otherwise(0)).alias(f"c{y}_{k}") for y in (0, 1) for k in range(FOLDS)]
    ordered = first.select("y", "fold", "copies", F.col("text").cast("binary")).repartition("copies").sortWithinPartitions("copies", "y")
    counts = ordered.mapInArrow(beginnings, "mark binary, fold long, c0 long, c1 long").groupBy("mark").agg(*sums)
    return stage(counts.where(f"{' + '.join(f'c1_{k}' for k in range(FOLDS))} >= {LEAST - 1}"), "marks"), docs


def chosen_cut(first: DataFrame, counts: DataFrame, docs: dict[tuple, int], pair) -> float:
    """The evidence to ask for: least log loss on folds whose documents neither chose the beginnings nor fitted the weights."""
    found = {k: telling(counts, docs, k) for k in range(FOLDS)}
    makes = {k: [gain_features(*pair(special_text(found[k], cut))) for cut in CUTS] for k in range(FOLDS)}

    def make():
        made: dict[int, list] = {}

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = []
                for fold, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    if fold not in made:
                        made[fold] = [m() for m in makes[fold]]
                    x.append([v for features in made[fold] for v in features(text)])
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "fold", "x"])

        return run

    rows = first.select("doc_id", "y", "fold", F.col("text").cast("binary")).mapInArrow(lambda b: make()(b), "doc_id long, y int, fold long, x array<double>").orderBy("doc_id").collect()
    if not rows:
        return CUTS[-1]
    x, y, fold = np.array([r["x"] for r in rows]).reshape(len(rows), len(CUTS), -1), np.array([r["y"] for r in rows], float), np.array([r["fold"] for r in rows])
    loss = []
    for c in range(len(CUTS)):
        p = np.empty(len(y))
        for k in range(FOLDS):
            p[fold == k] = probability(fit_logistic(x[fold != k, c], y[fold != k]), x[fold == k, c])
        p = np.clip(p, 1e-12, 1 - 1e-12)
        loss.append(-np.where(y > 0, np.log(p), np.log(1 - p)).mean())
    return max(cut for cut, lost in zip(CUTS, loss) if lost <= min(loss))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> tuple:
    """(feature maker, logistic model) from the bounded sample of labelled rows that are not held out."""
    sample = stage(labelled_sample(docs, labels, "toxic", FIT_ROWS), "toxic")
    first = with_folds(sample.where("half = 0"))
    counts, held = counted(first)
    pieces = [b" ".join(words_of(p)) for p in training_pieces(sample, 0, PIECES)]
    common = trained(pieces, COMMON)
    pair = lambda special: (common + special, common + b" ".join(p[:64] for p in pieces)[: len(special)])
    make = gain_features(*pair(special_text(telling(counts, held, None), chosen_cut(first, counts, held, pair))))
    rows = sample.where("half = 1").select("doc_id", "y", F.col("text").cast("binary")).mapInArrow(
        featurise(make, ["doc_id", "y"]), "doc_id long, y int, x array<double>").orderBy("doc_id").collect()
    x, y = np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float)
    return make, fit_logistic(x, y)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of docs and __score (0 to 1, higher: label 1 likelier).

    Empty and null texts have no windows and get the score of a text without any gain.  Without labels of both classes every score is
    the smoothed share of toxic labels.  Extra columns pass through; labels, lang, source and doc_id are not inputs of a score.
    """
    make, model = fit_toxicity(docs, labels)
    return scored(docs, make, model)
