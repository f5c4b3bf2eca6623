"""Embedding whitening: partitions keep an eigendecomposition under centred rank-one updates, spectra are combined by further
rank-one updates in a tree, and a distributed Rayleigh-Ritz step over the combined basis brings the result to double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.spectrum import EPS, Scatter
from tidemark.llm.store import stage

#: Entries are counted in steps of 1 / SCALE.
SCALE = 256
COMPONENTS = 4
#: Partial results that one task of the tree takes in.
FAN = 8
PART = "part bigint, n bigint, sums array<decimal(38,0)>, mean array<double>, parts array<double>, vectors array<double>"


def step_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """All columns of the rows whose vector can be used, and __x: floor(SCALE * entry) as longs, held at the ends of their range.

    Null vectors, those with a null or non-finite entry and those without entries are left out.
    """
    fit = F.forall(column, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    step = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & fit).select("*", step.alias("__x"))


def _matrix(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _column_sums(x: np.ndarray) -> list[int]:
    if float(np.abs(x.astype(float)).max()) * len(x) < 2 ** 62:
        return [int(v) for v in x.sum(0)]
    return [int(v) for v in x.astype(object).sum(0)]


def _part(part: int, n: int, sums: list[int], mean, parts, vectors) -> pa.RecordBatch:
    lists = lambda v: pa.array([np.asarray(v, float).ravel()], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays(
        [pa.array([part]), pa.array([n]), pa.array([[Decimal(v) for v in sums]], pa.list_(pa.decimal128(38, 0))), lists(mean), lists(parts), lists(vectors)],
        names=["part", "n", "sums", "mean", "parts", "vectors"])


def partition_spectra(size: int):
    """Rows of a partition -> its number, exact sums, mean, eigenvalues and eigenvectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sums = Scatter(size), [0] * size
        for batch in batches:
            x = _matrix(batch, "__x", size)
            if len(x):
                sums = [a + b for a, b in zip(sums, _column_sums(x))]
                for row in x.astype(float):
                    seen.add(row)
        if seen.n:
            yield _part(TaskContext.get().partitionId(), seen.n, sums, seen.mean, seen.values, seen.vectors)

    return run


def _merged_spectra(rows: list[dict]) -> dict:
    first = rows[0]
    both = Scatter(len(first["mean"]), first["n"], first["mean"], first["parts"], first["vectors"])
    for r in rows[1:]:
        both.merge(Scatter(len(r["mean"]), r["n"], r["mean"], r["parts"], r["vectors"]))
    sums = [sum(int(v) for v in column) for column in zip(*(r["sums"] for r in rows))]
    return {"n": both.n, "sums": sums, "mean": both.mean, "parts": both.values, "vectors": both.vectors}


def _added(rows: list[dict]) -> dict:
    return rows[0] | {"n": sum(r["n"] for r in rows), "parts": np.sum([r["parts"] for r in rows], axis=0)}


def fold(parts: DataFrame, merge: Callable[[list[dict]], dict]) -> dict | None:
    """One row out of many: neighbouring partial results meet, ``FAN`` to a task, level by level."""
    level = stage(parts, "parts")
    while level.count() > 1:
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["part"])
            m = merge(rows)
            return pa.Table.from_batches([_part(rows[0]["part"] // FAN, m["n"], m["sums"], m["mean"], m["parts"], m["vectors"])])

        level = stage(level.groupBy(F.expr(f"part div {FAN}")).applyInArrow(run, PART), "parts")
    row = level.first()
    return row and row.asDict()


def exact_distances(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums as integers of any length: centred before anything is rounded or multiplied."""
    if n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums)) < 2 ** 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def summed_products(size: int, n: int, sums: list[int], directions: np.ndarray):
    """Rows of a partition -> sum of the outer squares of their centred projections."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((directions.shape[1],) * 2), 0
        for batch in batches:
            x = _matrix(batch, "__x", size)
            for at in range(0, len(x), 4_096):
                y = (exact_distances(x[at:at + 4_096], n, sums) / n).astype(float) @ directions
                total += y.T @ y
            rows += len(x)
        if rows:
            yield _part(TaskContext.get().partitionId(), rows, [], [], total, [])

    return run


def fit_whitening(steps: DataFrame, components: int = COMPONENTS) -> dict[int, dict]:
    """Per vector length: n, sums, variances and directions of the first components, trace and identity error.

    Each distinct __x counts once; Spark drops repeats per task before it shuffles them.  The driver gets one spectrum and two square
    matrices of a vector's length, whatever the number of rows.
    """
    distinct = stage(steps.select("__x").distinct(), "vectors")
    models = {}
    for size in sorted(r[0] for r in distinct.select(F.size("__x")).distinct().collect()):
        rows = distinct.where(F.size("__x") == size)
        spectrum = fold(rows.mapInArrow(partition_spectra(size), PART), _merged_spectra)
        n, sums = spectrum["n"], [int(v) for v in spectrum["sums"]]
        basis, _ = np.linalg.qr(np.array(spectrum["vectors"]).reshape(size, size)[:, ::-1])
        # Rayleigh-Ritz: the exact covariance within the span of the basis, here the whole space.
        ritz = fold(rows.mapInArrow(summed_products(size, n, sums, basis), PART), _added)
        values, turn = np.linalg.eigh(np.array(ritz["parts"]).reshape(size, size) / n)
        trace = float(values.sum())
        values, directions = values[::-1][:components], (basis @ turn)[:, ::-1][:, :components]
        real = values > size * EPS * max(trace, 0)
        scaled = directions[:, real] / np.sqrt(values[real])
        error = None
        if real.any():
            whole = fold(rows.mapInArrow(summed_products(size, n, sums, scaled), PART), _added)
            error = float(np.abs(np.array(whole["parts"]).reshape(real.sum(), -1) / n - np.eye(real.sum())).max())
        models[size] = {"n": n, "sums": sums, "scaled": scaled, "explained": [max(float(v), 0.0) / trace if trace > 0 else None for v in values], "error": error}
    return models


def _deviations(away: np.ndarray) -> list[Decimal | None]:
    most = float(np.abs(away.astype(float)).max(initial=0))
    squares = (away * away if most * most * away.shape[1] < 2 ** 62 else away.astype(object) ** 2).sum(1)
    return [Decimal(int(v)) if v < 10 ** 38 else None for v in squares]


def whitened_rows(models: dict[int, dict]):
    """The columns of a batch, __x among them -> the same with n, deviation, whitened, explained and identity error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("__x")
            lengths = np.array(x.value_lengths().to_pylist(), int)
            out = [[None] * len(lengths) for _ in range(5)]
            for size in np.unique(lengths):
                m, at = models[size], np.flatnonzero(lengths == size)
                away = exact_distances(x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), m["n"], m["sums"])
                w = (away / m["n"]).astype(float) @ m["scaled"]
                void = [None] * (len(m["explained"]) - w.shape[1])
                for i, d, row in zip(at.tolist(), _deviations(away), w.tolist()):
                    for column, value in zip(out, (m["n"], d, row + void, m["explained"], m["error"])):
                        column[i] = value
            kinds = pa.int64(), pa.decimal128(38, 0), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, k) for c, k in zip(out, kinds))],
                names=[*batch.schema.names, "__n", "__deviation", "__whitened", "__explained", "__identity_error"])

    return run


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """All columns of the usable rows, repeated rows and extra columns with them, and what the fit over distinct vectors says of each:

    __x (longs), __n, __deviation decimal(38,0) (sum of (n * x - S)^2, exact; null beyond 38 digits), __whitened and __explained (one entry
    per component), __identity_error.  Vectors of different lengths are spaces of their own, each with its fit.  A component without
    variance (fewer distinct vectors than components, say) has null in __whitened and 0 in __explained, null there too when nothing varies;
    __identity_error is over the components with variance.  An empty table gives no rows.
    """
    steps = step_vectors(vectors, column)
    models = fit_whitening(steps, components)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema]
    schema = ", ".join([*fields, "__n bigint, __deviation decimal(38,0), __whitened array<double>, __explained array<double>, __identity_error double"])
    return steps.mapInArrow(whitened_rows(models), schema)
