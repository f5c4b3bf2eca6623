"""Shared by the two compression classifiers: labelled samples, zstandard dictionaries, logistic calibration."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

FRAME = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
PIECE = 512  # characters of a training piece


def held_out(doc_id) -> F.Column:
    """Rows that no fit sees: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def least_drawn(ids: DataFrame, kind: str, most: dict) -> DataFrame:
    """At most ``most[k]`` rows of each kind k, those of least ``draw`` (a 64-bit hash), then least doc_id.

    Only rows below a bound that several times as many should meet are ranked, so no task sees a whole kind.
    """
    totals = {r[kind]: r["count"] for r in ids.where(F.col(kind).isin(list(most))).groupBy(kind).count().collect()} if most else {}
    taken = ids.where("false")
    for k, n in most.items():
        share = (4 * n + 100) / max(totals.get(k, 0), 1)
        low = F.lit(True) if share >= 1 else F.col("draw") <= int(-2**63 + share * 2**64)
        taken = taken.union(ids.where((F.col(kind) == k) & low).orderBy("draw", "doc_id").limit(n))
    return taken


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """At most ``most[y]`` labelled documents of each class y, those of least hash -> (doc_id, text, y, half).

    The ids are bounded by ``most`` and so may be broadcast; texts come whole, one per id: an id that repeats gives its least text, so the rows
    are bounded too.  Held-out rows and rows with a null id or label are never taken; an id labelled twice counts by its larger label.
    ``half`` 0 (two thirds) trains the dictionaries, 1 the calibration.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().where(~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("draw", F.xxhash64("doc_id", F.lit(label)))
    picked = least_drawn(usable, "y", most).select("doc_id", "y", (F.pmod(F.shiftright("draw", 7), F.lit(3)) == 2).cast("int").alias("half"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y", "half").agg(F.min("text").alias("text")).select("doc_id", "text", "y", "half")


def training_pieces(sample: DataFrame, y: int, n: int) -> list[bytes]:
    """One piece of ``PIECE`` characters, at a hashed place, of at most n documents of class y: the driver holds n pieces."""
    span = F.greatest(F.length("text") - PIECE, F.lit(0)) + 1
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id"), span) + 1).cast("int"), F.lit(PIECE))
    rows = sample.where((F.col("y") == y) & (F.col("half") == 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", piece.alias("p")).collect()
    return [r["p"].encode() for r in sorted(rows, key=lambda r: r["doc_id"]) if r["p"]]


def trained(pieces: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the pieces; their own bytes where there are too few to train one."""
    if not pieces:
        return b""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=kind), **FRAME)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> dict:
    """Newton's method on standardised features with a small ridge; one class only: its smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return {"mean": [], "scale": [], "weights": [], "bias": float(np.log(share / (1 - share)))}
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weights": w[1:].tolist(), "bias": float(w[0])}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), model["bias"])
    if model["weights"]:
        z = z + ((x - np.array(model["mean"])) / np.array(model["scale"])) @ np.array(model["weights"])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
