"""Exact draws: against closed forms, enumeration, the normal approximation and a row-by-row resampler."""

import itertools
import math

import numpy as np
import pytest

from tidemark.operators import inference as inf
from tidemark.operators.resampling import BITS, TOP, flow, left_share, resampled_sums, uniforms
from test_inference import values


@pytest.mark.parametrize("total, left, q", [(10, 3, 4), (10, 9, 9), (7, 1, 7), (5000, 2500, 700), (2000, 1, 1999), (60, 30, 60)])
@pytest.mark.parametrize("back", [True, False])
def test_left_share_is_the_quantile(total, left, q, back):
    u = (np.arange(400) + 0.5) / 400
    if back:
        p = [math.comb(q, k) * (left / total) ** k * (1 - left / total) ** (q - k) if q < 900 else math.exp(
            math.lgamma(q + 1) - math.lgamma(k + 1) - math.lgamma(q - k + 1) + k * math.log(left / total) + (q - k) * math.log(1 - left / total)) for k in range(q + 1)]
    else:
        whole = math.comb(total, q)
        p = [math.comb(left, k) * math.comb(total - left, q - k) / whole if k <= left and q - k <= total - left else 0.0 for k in range(q + 1)]
    below = np.cumsum(p)
    wanted = [int(np.searchsorted(below, x - 1e-12)) for x in u]
    assert left_share(back, u, total, left, np.full(400, q)).tolist() == wanted


def test_left_share_of_a_billion_rows_has_the_right_moments():
    u = (np.arange(2_000) + 0.5) / 2_000
    k = left_share(False, u, 10**9, 3 * 10**8, np.full(2_000, 5 * 10**6)).astype(float)
    sd = math.sqrt(5e6 * 0.3 * 0.7 * (1 - 5e6 / 1e9))
    assert k.mean() == pytest.approx(1.5e6, abs=sd / 50) and k.std() == pytest.approx(sd, rel=0.01)


@pytest.mark.parametrize("back", [True, False])
def test_replicates_sum_to_their_size_and_stay_within_the_counts(back):
    rng = np.random.default_rng(1)
    keys = sorted(rng.integers(0, 1 << BITS, 300).tolist() + [5, 5, 5])
    counts = rng.integers(1, 40, 303).tolist()
    w = flow(back, 12345, keys, counts, np.full(500, 900), np.arange(500))
    assert (w.sum(0) == 900).all() and w.min() >= 0
    mean = 900 * np.array(counts) / sum(counts)
    assert np.abs(w.mean(1) - mean).max() < 6 * math.sqrt(mean.max() / 500)
    if not back:
        assert (w <= np.array(counts)[:, None]).all()
    # Drawing the subtrees first and the values inside them later is the same walk.
    tops = sorted({k >> (BITS - TOP) for k in keys})
    upper = flow(back, 12345, tops, [sum(c for k, c in zip(keys, counts) if k >> (BITS - TOP) == t) for t in tops], np.full(500, 900), np.arange(500), BITS - TOP)
    for t, q in zip(tops, upper):
        inside = [i for i, k in enumerate(keys) if k >> (BITS - TOP) == t]
        assert (flow(back, 12345, [keys[i] for i in inside], [counts[i] for i in inside], q, np.arange(500)) == w[inside]).all()


def test_uniforms_are_even_and_differ_between_forks():
    a, b = uniforms(1, 2, np.arange(20_000)), uniforms(1, 3, np.arange(20_000))
    assert 0 < a.min() and a.max() < 1 and np.abs(np.histogram(a, 20, (0, 1))[0] - 1000).max() < 150 and abs(np.corrcoef(a, b)[0, 1]) < 0.03


def test_permutation_of_twelve_rows_matches_enumeration(spark):
    control, treatment = [0, 0, 1, 3, 2, 0], [2, 5, 0, 4, 4, 1]
    pool = control + treatment
    seen = abs(sum(treatment) - sum(control)) / 6
    hits = [abs(sum(pool) - 2 * sum(pool[i] for i in pick)) / 6 >= seen - 1e-12 for pick in itertools.combinations(range(12), 6)]
    r = inf.permutation_test(values(spark, control, treatment), replicates=20_000).first()
    assert r.replicates == 20_000 and r.permutation_p_value == pytest.approx(sum(hits) / len(hits), abs=0.012)


def test_permutation_agrees_with_the_normal_approximation(spark):
    n = 50_000
    control, treatment = [(7 * i) % 101 for i in range(n)], [(7 * i) % 101 + (i % 157 == 0) * 20 for i in range(n)]
    pool = np.array(control + treatment, float)
    z = (np.mean(treatment) - np.mean(control)) / math.sqrt(pool.var() * 2 / n)
    r = inf.permutation_test(values(spark, control, treatment), replicates=4_000).first()
    assert r.permutation_p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=0.03)


def test_arms_keep_their_sizes(spark):
    v = values(spark, [1, 2, 3] * 30, [4, 0] * 20)
    counts = inf.value_counts(v, ["experiment_id", "variant"])
    sizes = counts.groupBy("experiment_id", "variant").agg({"n": "sum"}).withColumnRenamed("sum(n)", "drawn")
    sums = resampled_sums(counts, ["experiment_id", "variant"], ["minor_units"], ["minor_units"], sizes, 700, "s", True).collect()
    assert len(sums) == 1_400 and {(r.variant, r.drawn) for r in sums} == {("control", 90), ("treatment", 40)}
    assert {r.replicate for r in sums} == set(range(700)) and {r.experiment_id for r in sums} == {"e"}
    mean = np.mean([r.minor_units / 9_000 for r in sums if r.variant == "control"])
    assert mean == pytest.approx(2.0, abs=0.02)


def test_one_value_no_rows_and_nulls(spark):
    r = inf.bootstrap_mean_diff(values(spark, [2] * 5, [3] * 4), replicates=200).first()
    assert (r.confidence_interval_low, r.confidence_interval_high, r.replicates) == (1.0, 1.0, 200)
    assert inf.permutation_test(values(spark, [2] * 5, [2] * 4), replicates=200).first().permutation_p_value == 1.0
    none = values(spark, [1], [2]).where("false")
    assert inf.bootstrap_mean_diff(none, replicates=200).count() == 0 and inf.permutation_test(none, replicates=200).count() == 0
    v = values(spark, [1, 2], [3, 4])
    nulls = v.unionByName(v.selectExpr("experiment_id", "metric_key", "metric_role", "assignment_id", "variant", "cast(null as long) minor_units"))
    assert inf.bootstrap_mean_diff(nulls, replicates=200).first() == inf.bootstrap_mean_diff(v, replicates=200).first()
