import math
import random

import numpy as np
import pytest

from tidemark.llm.spectrum import Scatter, rank_one, secular_roots
from tidemark.llm.whitening import fit_whitening, step_vectors, whiten

SHAPES = {
    "plain": lambda r: r.normal(size=(200, 12)), "low rank": lambda r: r.normal(size=(150, 3)) @ r.normal(size=(3, 12)),
    "ties": lambda r: r.integers(-2, 3, (200, 6)).astype(float), "scales": lambda r: r.normal(size=(200, 10)) * 10.0 ** np.arange(10),
    "axes": lambda r: np.eye(8)[r.integers(0, 8, 100)], "all equal": lambda r: np.ones((20, 5)), "few": lambda r: r.normal(size=(3, 9)), "one": lambda r: r.normal(size=(1, 4))}


@pytest.mark.parametrize("shape", SHAPES)
def test_updates_and_merges_equal_a_whole_decomposition(shape):
    x = SHAPES[shape](np.random.default_rng(1))
    whole, halves = Scatter(x.shape[1]), [Scatter(x.shape[1]) for _ in range(3)]
    for i, row in enumerate(x):
        whole.add(row)
        halves[i % 3].add(row)
    for other in halves[1:]:
        halves[0].merge(other)
    centred = x - x.mean(0)
    scatter = centred.T @ centred
    size = max(np.abs(scatter).max(), 1e-9)
    for s in (whole, halves[0]):
        assert s.n == len(x) and s.mean == pytest.approx(x.mean(0), rel=1e-12, abs=1e-12)
        assert np.abs(s.vectors * s.values @ s.vectors.T - scatter).max() < 1e-12 * size
        assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-13
        assert np.abs(s.values - np.linalg.eigvalsh(scatter)).max() < 1e-12 * size


def test_secular_roots_lie_between_the_poles():
    d = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-7, 50.0])
    z2 = np.array([1e-12, 3.0, 1e-9, 2.0, 1e-6])
    roots = np.diagonal(secular_roots(d, z2)) + d
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all() and roots[-1] <= d[-1] + z2.sum()
    assert roots == pytest.approx(np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(z2), np.sqrt(z2))), rel=1e-9, abs=1e-12)


def test_deflation_leaves_untouched_pairs_alone():
    values, vectors = rank_one(np.array([1.0, 2.0, 3.0]), np.eye(3), np.array([0.0, 1.0, 0.0]), 0.5)
    assert values.tolist() == [1.0, 2.5, 3.0] and np.abs(vectors).tolist() == np.eye(3).tolist()


def brute(rows):
    """(vec_id, component) -> (n, deviation, |whitened|, explained) in Python integers and one dense decomposition."""
    use = [(i, [math.floor(256 * float(np.float32(c))) for c in e]) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    fit = sorted({tuple(x) for _, x in use})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    away = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    out = {}
    for i, x in use:
        exact = [n * c - s for c, s in zip(x, sums)]
        w = (np.array(exact, float) / n) @ vectors[:, ::-1]
        for k in range(min(4, len(x))):
            out.setdefault((i, k + 1), []).append((n, sum(v * v for v in exact), abs(w[k]) / math.sqrt(values[-1 - k]), values[-1 - k] / values.sum()))
    return out


def vectors(spark, seed=2, size=10, shift=0.0):
    r = random.Random(seed)
    base = [[r.gauss(0, 0.1 * (k + 1)) + shift for k in range(size)] for _ in range(150)]
    rows = [(i, e) for i, e in enumerate(base)] + [(200 + i, base[0]) for i in range(80)] + [(0, base[0]), (None, base[1])]
    rows += [(300, None), (301, []), (302, [None] + base[0][1:]), (303, [math.nan] + base[0][1:]), (304, [math.inf] + base[0][1:])]
    return rows, spark.createDataFrame([(i, e, 7, 1.5, "x") for i, e in rows], "vec_id long, embedding array<float>, n int, __y double, component string")


@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_rows_equal_brute_force(spark, shift):
    rows, table = vectors(spark, shift=shift)
    wanted = brute(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")  # a tree of two levels
    got = whiten(table).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    seen = {}
    for r in got:
        for k, (w, e) in enumerate(zip(r["__whitened"], r["__explained"])):
            seen.setdefault((r["vec_id"], k + 1), []).append((r["__n"], int(r["__deviation"]), abs(w), e))
    assert seen.keys() == wanted.keys() and len(got) == sum(len(v) for k, v in wanted.items() if k[1] == 1)
    for key, values in wanted.items():
        assert seen[key][0] == pytest.approx(values[0], rel=1e-8, abs=1e-8) and seen[key][0][:2] == values[0][:2] and len(seen[key]) == len(values)
    assert {r["__identity_error"] for r in got}.pop() < 1e-9
    assert table.columns == whiten(table).columns[:5]


def test_signs_agree_over_all_rows(spark):
    _, table = vectors(spark)
    model = fit_whitening(step_vectors(table))[10]
    for r in whiten(table).select("__x", "__whitened").collect():
        away = np.array([model["n"] * c - s for c, s in zip(r["__x"], model["sums"])]) / model["n"]
        assert r["__whitened"] == pytest.approx((away @ model["scaled"]).tolist())


def test_few_rows_other_lengths_huge_entries_and_empty_tables(spark):
    table = spark.createDataFrame([(1, [0.5, 0.25, 0.0]), (2, [0.5, 0.75, 0.0]), (3, [1.0, 2.0]), (4, [3e38] * 5), (5, [-3e38] * 5)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in whiten(table).collect()}
    assert got[1]["__n"] == 2 and got[1]["__whitened"][1:] == [None, None] and abs(got[1]["__whitened"][0]) == pytest.approx(1) and got[1]["__explained"] == pytest.approx([1, 0, 0])
    assert got[1]["__deviation"] == 128 ** 2 and got[1]["__identity_error"] == pytest.approx(0, abs=1e-12)
    assert got[3]["__n"] == 1 and got[3]["__whitened"] == [None, None] and got[3]["__explained"] == [None, None] and got[3]["__identity_error"] is None
    assert got[4]["__deviation"] is None and abs(got[4]["__whitened"][0]) == pytest.approx(1)
    assert whiten(table.where("false")).count() == 0 and whiten(table.where("vec_id is null")).columns[-1] == "__identity_error"
