"""Quality classifier: zstandard dictionaries of good and bad text, the normalised size difference calibrated to a score."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.store import stage
from tidemark.llm.zdict import compressor, fit_logistic, held_out, labelled_sample, probability, trained, training_pieces

#: Bounds of the fit: labelled documents per class, pieces per dictionary.
FIT_ROWS = {0: 3_000, 1: 3_000}
PIECES = 1_500
DICTIONARY = 32 * 1024
WINDOW = 512
LEVEL = 3
#: Below this many bytes a window's size says little; it counts in the sum only.
WHOLE = 128


def size_features(good: bytes, bad: bytes):
    """Features of a text: (bad size - good size) per byte over the whole text, its least and greatest window, and the good ratio."""

    def make():
        pair = compressor(good, LEVEL), compressor(bad, LEVEL)

        def features(text: bytes | None) -> list[float]:
            if not text:
                return [0.0, 0.0, 0.0, 0.0]
            starts = np.arange(0, len(text), WINDOW, dtype=np.uint64)
            lengths = np.minimum(WINDOW, len(text) - starts.astype(np.int64)).astype(np.uint64)
            windows = zstandard.BufferWithSegments(text, np.stack([starts, lengths], 1).tobytes())
            sizes = []
            for c in pair:
                out = c.multi_compress_to_buffer(windows)
                sizes.append(np.fromiter(map(len, out), np.float64, len(out)))
            gain = sizes[1] - sizes[0]
            per = (gain / lengths)[lengths >= min(WHOLE, len(text))]
            return [gain.sum() / len(text), per.min(), per.max(), sizes[0].sum() / len(text)]

        return features

    return make


def featurise(make_features, names: list[str]):
    """(doc_id, ..., text bytes last) -> the columns before the text and one array of features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = make_features()
        for batch in batches:
            x = [features(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame) -> tuple:
    """(feature maker, logistic model) from the bounded sample of labelled rows that are not held out."""
    sample = stage(labelled_sample(docs, labels, "quality", FIT_ROWS), "quality")
    good, bad = (trained(training_pieces(sample, y, PIECES), DICTIONARY) for y in (1, 0))
    make = size_features(good, bad)
    rows = sample.where("half = 1").select("doc_id", "y", F.col("text").cast("binary")).mapInArrow(
        featurise(make, ["doc_id", "y"]), "doc_id long, y int, x array<double>").orderBy("doc_id").collect()
    x, y = np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float)
    # Both classes count alike, whatever their shares in the sample.
    return make, fit_logistic(x, y)


def scored(docs: DataFrame, make, model: dict) -> DataFrame:
    """All columns of docs and __score: the calibrated probability of label 1, from the whole text alone."""
    names = docs.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = make()
        for batch in batches:
            x = np.array([features(t) for t in batch.column(len(names)).to_pylist()])
            score = probability(model, x) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(score)], names=[*names, "__score"])

    return docs.select("*", F.col("text").cast("binary").alias("__bytes")).mapInArrow(run, ", ".join([*fields, "__score double"]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of docs and __score (0 to 1, higher: better).

    Empty and null texts get the score of zero differences.  Without labels of both classes every score is the smoothed share of
    good labels.  Extra columns pass through; labels, lang, source and doc_id are not inputs of a score.
    """
    make, model = fit_quality(docs, labels)
    return scored(docs, make, model)
