import math

import numpy as np
import pytest

from tidemark.llm import cap_filters


def rows(n=700, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, dim))
    out = []
    for i in range(n):
        x = base[rng.integers(40)] + rng.standard_normal(dim) * rng.choice([0.0, 0.08, 0.15, 0.2])
        out.append((i, [float(np.float32(v)) for v in x], int(rng.integers(3))))
    d = [0.5] * dim
    out += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [math.nan, *d[1:]], 1), (n + 3, [None, *d[1:]], 1), (n + 4, [math.inf, *d[1:]], 1), (n + 5, d, None), (n + 6, [], 1),
            (n + 7, d, 2), (n + 8, [2 * v for v in d], 2), (n + 8, [2 * v for v in d], 2), (n + 9, d[:7], 2), (n + 10, d[:7], 2), (None, d, 2), (n + 11, [1e-30] * dim, 2)]
    return out


def brute(data, near=0.98):
    unit = []
    for _, e, label in data:
        ok = e and label is not None and all(v is not None and math.isfinite(v) for v in e) and any(e)
        x = np.array(e, float) if ok else None
        unit.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    part, links = list(range(len(data))), [0] * len(data)
    for i, x in enumerate(unit):
        for j in range(i):
            y = unit[j]
            if x is not None and y is not None and data[i][2] == data[j][2] and len(x) == len(y) and x @ y >= near:
                links[i] += 1
                links[j] += 1
                if part[i] != part[j]:
                    part = [part[j] if p == part[i] else p for p in part]
    named = {}
    for (v, _, _), p in zip(data, part):
        if v is not None:
            named[p] = min(v, named.get(p, v))
    return sorted(((v, n, named.get(p), None if v is None else v == named[p]) for (v, _, _), n, p in zip(data, links, part)), key=str)


def test_equals_all_pairs(spark, monkeypatch):
    data = rows()
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(4)
    want = brute(data)
    assert sum(w[1] for w in want) > 500
    assert sorted(map(tuple, cap_filters.near_vectors(vectors).collect()), key=str) == want
    # Lists cut into squares lose and double nothing.
    monkeypatch.setattr(cap_filters, "SQUARE", 7)
    assert sorted(map(tuple, cap_filters.near_vectors(vectors).collect()), key=str) == want


def test_double_precision_and_few_dimensions(spark):
    data = rows(n=250, dim=3)
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    assert sorted(map(tuple, cap_filters.near_vectors(vectors).collect()), key=str) == brute(data)


@pytest.mark.parametrize("dim, n", [(3, 50), (10, 400), (16, 2_000)])
def test_list_decoding_finds_all_filters_above_the_cap(dim, n):
    rng = np.random.default_rng(0)
    unit = cap_filters._unit(rng.standard_normal((40, dim)))
    height, rotation, vectors = cap_filters.product_code(dim, n, 0.98)
    blocks, codes = vectors.shape[:2]
    turned = (unit @ rotation).reshape(40, blocks, -1)
    sizes = []
    for row, found in enumerate(cap_filters.list_decode(unit, n)):
        score = np.zeros(1)
        for block in range(blocks):
            score = (score[:, None] + vectors[block] @ turned[row, block] / np.sqrt(blocks)).ravel()
        above = np.flatnonzero(score >= height)
        best = np.sort(np.argsort(-score)[: min(cap_filters.LISTED, len(score))])
        assert found.tolist() == (above if len(above) >= len(best) else best).tolist()
        sizes.append(len(found))
    assert 15 <= np.mean(sizes) <= 60


@pytest.mark.parametrize("dim", [1, 2, 3, 4, 8, 16, 64])
def test_pairs_share_a_filter_in_any_dimension(dim):
    """Pairs at 0.98 to 0.985, the hardest ones, with as many vectors in the label as in a large table."""
    rng = np.random.default_rng(dim)
    x = cap_filters._unit(rng.standard_normal((400, dim)))
    other = rng.standard_normal((400, dim))
    other -= (other * x).sum(1, keepdims=True) * x
    cosine = rng.uniform(0.98, 0.985, (400, 1))
    y = x if dim == 1 else cosine * x + np.sqrt(1 - cosine**2) * cap_filters._unit(other)
    for n in (300, 50_000):
        shared = [bool(np.intersect1d(a, b).size) for a, b in zip(cap_filters.list_decode(x, n), cap_filters.list_decode(y, n))]
        assert np.mean(shared) >= 0.99, (n, np.mean(shared))


def test_empty_table(spark):
    assert cap_filters.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
