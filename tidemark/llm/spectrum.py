"""Eigendecomposition kept under rank-one updates: deflation, secular equation, eigenvectors from recomputed weights."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """Matrix root_i - d_j of the roots of 1 + sum_j z2_j / (d_j - root) for distinct rising d and positive z2.

    Root i lies between d_i and d_i+1 (the last one above) and is found as its distance from the nearer of the two, so that the
    differences keep their relative precision.  Each step fits one pole on either side and falls back to bisection outside the bracket.
    """
    k = len(d)
    total = z2.sum()
    upper = np.append(d[1:], d[-1] + total)
    gap = upper - d
    below = np.arange(k)[:, None] >= np.arange(k)
    middle = 1 + (z2 / (d - (d + gap / 2)[:, None])).sum(1)
    left = middle >= 0
    left[-1] = True
    origin = np.where(left, d, upper)
    delta = d - origin[:, None]
    lo, hi = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    if middle[-1] < 0:
        lo[-1], hi[-1] = gap[-1] / 2, gap[-1]
    tau = (lo + hi) / 2
    now = np.arange(k)  # roots still sought
    for _ in range(80):
        last = now == k - 1
        t, left_pole, right_pole = tau[now], (d - origin)[now] - tau[now], np.where(last, 1.0, (upper - origin)[now] - tau[now])
        term = z2 / (delta[now] - t[:, None])
        slope = term / (delta[now] - t[:, None])
        under = np.where(below[now], slope, 0)
        q = under.sum(1)
        r = slope.sum(1) - q
        f = 1 + term.sum(1)
        open_ = np.abs(f) > EPS * (k * (1 + np.abs(term).sum(1)) + 2 * np.abs(t) * (q + r))
        if not open_.any():
            break
        lo[now], hi[now] = np.where(f < 0, t, lo[now]), np.where(f < 0, hi[now], t)
        c = f - q * left_pole - r * right_pole
        q, r = q * left_pole ** 2, r * right_pole ** 2
        p, w = c * (left_pole + right_pole) + q + r, left_pole * right_pole * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(p * p - 4 * w * c, 0))
            new = t + np.where(last, left_pole + q / c, np.where(p <= 0, (p - root) / (2 * c), 2 * w / (p + root)))
        outside = ~((new > lo[now]) & (new < hi[now]))
        new[outside] = ((lo[now] + hi[now]) / 2)[outside]
        open_ &= new != t
        tau[now[open_]] = new[open_]
        now = now[open_]
        if not len(now):
            break
    return tau[:, None] - delta


def rank_one(values: np.ndarray, vectors: np.ndarray, u: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs (rising values, vectors in columns) of V diag(values) V' + rho u u', rho >= 0."""
    z = vectors.T @ u
    norm = float(z @ z)
    rho = rho * norm
    if rho <= 0:
        return values, vectors
    z = z / np.sqrt(norm)
    d, q = values.copy(), vectors
    tol = 8 * EPS * max(abs(d[0]), abs(d[-1]), rho)
    live = np.flatnonzero(rho * np.abs(z) > tol)
    # Two values that are nearly equal: rotate their plane so that one of them has no weight left.
    near = z[live[:-1]] * z[live[1:]] * np.diff(d[live])
    if len(live) > 1 and (np.abs(near) <= tol * (z[live[:-1]] ** 2 + z[live[1:]] ** 2)).any():
        q = q.copy()
        kept, i = [], live[0]
        for j in live[1:]:
            length = np.hypot(z[i], z[j])
            c, s = z[j] / length, z[i] / length
            if abs((d[j] - d[i]) * c * s) <= tol:
                z[i], z[j] = 0.0, length
                q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
                d[i], d[j] = c * c * d[i] + s * s * d[j], s * s * d[i] + c * c * d[j]
            else:
                kept.append(i)
            i = j
        live = np.array([*kept, i])
        live = live[np.argsort(d[live], kind="stable")]
    if not len(live):
        return values, vectors
    dl = d[live]
    apart = secular_roots(dl, rho * z[live] ** 2)  # root i - d_j
    k = len(live)
    # Weights for which the roots found are exact: the vectors come out orthogonal however close the roots are.
    row, col = np.arange(k)[:, None], np.arange(k)
    bottom = np.where(row < col, dl[:, None] - dl, np.append(dl[1:], dl[-1])[:, None] - dl)
    bottom[-1] = 1
    weight = np.sqrt(np.abs(np.prod(apart / bottom, axis=0))) * np.sign(z[live])
    w = -(weight / apart).T
    w /= np.sqrt((w * w).sum(0))
    if q is vectors:
        q = q.copy()
    q[:, live] = q[:, live] @ w
    d[live] = dl + np.diagonal(apart)
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Scatter:
    """Number, mean and eigenpairs of the centred scatter matrix of the rows seen so far."""

    def __init__(self, size: int, n: int = 0, mean=None, values=None, vectors=None):
        self.n = n
        self.mean = np.zeros(size) if mean is None else np.asarray(mean, float)
        self.values = np.zeros(size) if values is None else np.asarray(values, float)
        self.vectors = np.eye(size) if vectors is None else np.asarray(vectors, float).reshape(size, size)

    def add(self, x: np.ndarray) -> None:
        """One row: a centred rank-one update."""
        away = x - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        if self.n > 1:
            self.values, self.vectors = rank_one(self.values, self.vectors, away, (self.n - 1) / self.n)

    def merge(self, other: Scatter) -> None:
        """The rows of another one: a rank-one update for each of its eigenpairs, one for the distance of the means."""
        if not other.n:
            return
        away, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / n)
        self.mean, self.n = self.mean + away * (other.n / n), n
