"""Embedding near-duplicates by spherical-cap filters with a random product code.

A filter is a unit direction put together from one code vector per block of the rotated space.  Each vector is listed under all
filters whose cap it lies in: the cap's height is the one that ``LISTED`` filters exceed on average, and is never so high that the cap is
narrower than twice the angle looked for, so that a pair shares filters in few dimensions as well as in many; a vector in an empty direction
takes its best ``LISTED``.  The list comes from the blocks' partial sums without visiting all directions.  Vectors meet where they share
a filter, and every pair is verified there in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.graph import components
from tidemark.llm.store import stage

NEAR = 0.98
LISTED = 20  # filters that a vector exceeds, on average
BUCKET = 8  # random vectors under one filter, on average
SQUARE = 2_000  # vectors that one task compares with as many others
SEED = 7


def cap_share(dim: int, angle: float) -> float:
    """Share of all directions that lie within ``angle`` of one."""
    if dim == 1:
        return 0.5
    at = np.linspace(0, np.pi, 40_001)
    below = np.cumsum(np.sin(at) ** (dim - 2))
    return float(np.interp(angle, at, below / below[-1]))


def cap_height(dim: int, share: float) -> float:
    """Inner product that a share of all directions reaches."""
    if share >= 1:
        return -2.0
    if dim == 1:
        return 0.0
    at = np.linspace(0, np.pi, 40_001)
    below = np.cumsum(np.sin(at) ** (dim - 2))
    return float(np.cos(np.interp(share, below / below[-1], at)))


@lru_cache(maxsize=16)
def product_code(dim: int, n: int, near: float) -> tuple[float, np.ndarray, np.ndarray]:
    """For n vectors of the largest label: (cap height, random rotation of dim padded to whole blocks, unit code vectors per block).

    Blocks have at least four dimensions: in fewer, code vectors are too much alike.  There are as many filters as leave ``BUCKET`` random
    vectors to one, but not more than keep a cap of twice the angle of ``near`` at ``LISTED`` of them.
    """
    blocks = 4 if dim >= 16 else 2 if dim >= 8 else 1
    wanted = min(max(1, n) * LISTED / BUCKET, LISTED / cap_share(dim, 2 * np.arccos(near)))
    codes = max(2, int(np.ceil(wanted ** (1 / blocks))))
    rng = np.random.default_rng([SEED, dim, codes])
    wide = -(-dim // blocks) * blocks
    rotation, _ = np.linalg.qr(rng.standard_normal((wide, wide)))
    vectors = rng.standard_normal((blocks, codes, wide // blocks))
    return cap_height(dim, LISTED / codes**blocks), rotation[:dim], vectors / np.linalg.norm(vectors, axis=2, keepdims=True)


def list_decode(unit: np.ndarray, n: int, near: float = NEAR) -> list[np.ndarray]:
    """For each unit vector the sorted ids of all filters whose inner product reaches the cap height, at least the best ``LISTED``.

    Decoding a height joins each left half of a direction with the right halves that reach the rest, best first; where that gives
    too few filters, the height is lowered.
    """
    height, rotation, vectors = product_code(unit.shape[1], n, near)
    blocks, codes = vectors.shape[:2]
    turned = (unit @ rotation).reshape(len(unit), blocks, -1)
    parts = np.einsum("nbk,bck->bnc", turned, vectors) / np.sqrt(blocks)
    pair = lambda x, y: (x[:, :, None] + y[:, None, :]).reshape(len(unit), -1)
    left, right = (pair(*parts[:2]), pair(*parts[2:])) if blocks == 4 else (parts[0], parts[1]) if blocks == 2 else (np.zeros((len(unit), 1)), parts[0])
    order = np.argsort(-right, axis=1)
    sorted_right = np.take_along_axis(right, order, axis=1)
    least = min(LISTED, codes**blocks)
    out = []
    for row in range(len(unit)):
        line, step = height, 0.2 / np.sqrt(unit.shape[1])
        while True:
            some = np.flatnonzero(left[row] >= line - sorted_right[row, 0])
            counts = np.searchsorted(-sorted_right[row], left[row, some] - line, side="right")
            if counts.sum() >= least:
                break
            line, step = line - step, step * 1.5
        owners = np.repeat(some, counts)
        ranks = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        ids = owners * right.shape[1] + order[row, ranks]
        if line < height:
            scores = left[row, owners] + sorted_right[row, ranks]
            ids = ids[np.lexsort((ids, -scores))[:least]]
        out.append(np.sort(ids))
    return out


def list_filters(n: int, near: float, wide: bool):
    """(rid, label, m, embedding) -> a row per filter: rid, label, m, embedding, filter, and all filters of the vector.

    Embeddings and filter lists travel as bytes: Spark moves those whole, arrays entry by entry.
    """
    schema = pa.schema([("rid", pa.int64()), ("label", pa.string()), ("m", pa.int64()), ("embedding", pa.binary()), ("filter", pa.int64()), ("filters", pa.binary())])
    kind = np.float64 if wide else np.float32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500).to_pylist()
                for dim in sorted({len(r["embedding"]) for r in rows}):
                    same = [r for r in rows if len(r["embedding"]) == dim]
                    given = np.array([r["embedding"] for r in same], float)
                    unit = _unit(given)
                    found = list_decode(unit, n, near)
                    counts = [len(f) for f in found]
                    index = np.repeat(np.arange(len(same)), counts)
                    own = pa.RecordBatch.from_arrays([
                        pa.array([r["rid"] for r in same], pa.int64()), pa.array([f"{r['label']}/{dim}" for r in same]), pa.array([r["m"] for r in same], pa.int64()),
                        pa.array([v.tobytes() for v in given.astype(kind)], pa.binary()), pa.array([f.astype(np.int64).tobytes() for f in found], pa.binary())], names=["rid", "label", "m", "embedding", "filters"])
                    each = own.take(pa.array(index))
                    filters = pa.array(np.concatenate(found))
                    yield pa.RecordBatch.from_arrays([each["rid"], each["label"], each["m"], each["embedding"], filters, each["filters"]], schema=schema)

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first: squares of extreme components neither vanish nor overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _entries(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column of packed numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // np.dtype(kind).itemsize
    return ends, np.frombuffer(column.buffers()[2], kind, ends[-1]) if ends[-1] else np.empty(0, kind)


def verify(near: float, wide: bool):
    """Rows (label, filter, i, j, side, rid, m, embedding, filters) sorted by square -> links counted and a spanning forest.

    Square (i, j) compares block i of a filter's list with block j.  A pair counts under its smallest common filter only.
    Result: (a, b, w): b null: w links more for a; else both are connected.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.int64())])

    def close(key: tuple, parts: list[tuple]) -> pa.RecordBatch | None:
        side, rid, m = (np.concatenate([p[i] for p in parts]) for i in range(3))
        if len(rid) < 2:
            return None
        x, owner, filters = _unit(np.concatenate([p[3] for p in parts])), np.repeat(np.arange(len(rid)), np.concatenate([p[4] for p in parts])), np.concatenate([p[5] for p in parts])
        one, two = (np.flatnonzero(side == 0), np.flatnonzero(side == int(key[2] != key[3])))
        linked = x[one] @ x[two].T >= near
        if key[2] == key[3]:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return None
        before = filters < key[1]
        owner, known = owner[before], np.unique(filters[before], return_inverse=True)
        if len(known[0]):
            holds = np.zeros((len(rid), len(known[0])), np.float32)
            holds[owner, known[1]] = 1
            linked &= holds[one] @ holds[two].T == 0
        counts = np.zeros(len(rid), np.int64)
        counts[one] += linked @ m[two]
        if key[2] != key[3]:
            counts[two] += m[one] @ linked
        edges, fresh = [], linked.any(1)
        while fresh.any():
            # Everything that the first row not yet reached is connected with.
            lead = int(np.flatnonzero(fresh)[0])
            rows, columns = np.zeros(len(one), bool), linked[lead].copy()
            while True:
                rows = linked[:, columns].any(1)
                grown = linked[rows].any(0)
                if (grown == columns).all():
                    break
                columns = grown
            rows[lead] = True
            fresh &= ~rows
            reached = np.unique(np.concatenate([one[rows], two[columns]]))
            edges += [(int(rid[one[lead]]), int(r)) for r in rid[reached] if r != rid[one[lead]]]
        some = np.flatnonzero(counts)
        a = [*rid[some].tolist(), *(e[0] for e in edges)]
        b = [None] * len(some) + [e[1] for e in edges]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*counts[some].tolist(), *[0] * len(edges)], pa.int64())], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in ("label", "filter", "i", "j"))))
            side, rid, m = (batch.column(n).to_numpy() for n in ("side", "rid", "m"))
            if not batch.num_rows:
                continue
            ends, values = _entries(batch.column("embedding"), np.float64 if wide else np.float32)
            values = values.astype(float)
            tails, filters = _entries(batch.column("filters"), np.int64)
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(keys)]):
                if keys[lo] != now:
                    if parts and (out := close(now, parts)) is not None:
                        yield out
                    now, parts = keys[lo], []
                parts.append((side[lo:hi], rid[lo:hi], m[lo:hi], values[ends[lo] : ends[hi]].reshape(hi - lo, -1), np.diff(tails[lo : hi + 1]), filters[tails[lo] : tails[hi]]))
        if parts and (out := close(now, parts)) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, near: float = NEAR) -> DataFrame:
    """vectors (vec_id, label, embedding) -> vec_id, n_links, component_id, kept: one row per vector.

    Only vectors of one label and one dimension are compared.  Null, empty and zero vectors, null labels and null or non-finite components
    link with nothing.  Equal vectors of a label are one, counted with its copies.  component_id is the smallest vec_id reachable;
    a null vec_id never names a component, and a component of nulls has none (kept is null).  Lists above ``SQUARE`` vectors
    are cut into squares of blocks, each its own unit of work; nothing is left out.
    """
    # Single precision stays as it is until a task computes with it in double precision.
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    usable = F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    rows = rows.withColumn("usable", usable)
    reps = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"))
    reps = stage(reps.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    largest = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    listed = reps.select("rid", "label", "m", "embedding").mapInArrow(
        list_filters(largest, near, kind == "double"), "rid long, label string, m long, embedding binary, filter long, filters binary")
    listed = stage(listed, "filters")
    sizes = listed.groupBy("label", "filter").agg(F.count("*").alias("c")).where("c > 1").withColumn("blocks", F.ceil(F.col("c") / SQUARE))
    met = listed.join(sizes, ["label", "filter"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    squares = met.withColumn("o", other).select(
        "label", "filter", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), (F.col("block") > F.col("o")).cast("int").alias("side"), "rid", "m", "embedding", "filters")
    keys = ["label", "filter", "i", "j"]
    found = squares.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify(near, kind == "double"), "a long, b long, w long")
    found = stage(found, "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("w").alias("w"))
    label = components(found.where("b is not null").select("a", "b"))
    named = reps.select("label", "embedding", "id", "m", "rid").join(label.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    known = named.join(least, "root").join(counts, "rid", "left").select(
        F.struct("label", "embedding").alias("key"), (F.col("m") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), "component_id")
    keyed = rows.withColumn("key", F.when(F.col("usable"), F.struct("label", "embedding")))
    told = keyed.join(known, "key", "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return told.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
