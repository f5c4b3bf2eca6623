import itertools
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.normal import erfc, two_sided_p
from tidemark.operators import inference as inf
from tidemark.operators.experiments import draw_variant


def counts(spark, rows):
    return spark.createDataFrame(
        [("e", "m", "primary", v, n, s) for v, n, s in rows],
        "experiment_id string, metric_key string, metric_role string, variant string, assigned_mature_count long, success_count long")


def test_erfc_matches_math(spark):
    xs = [0.0, 1e-6, 0.1, 0.5, 1.0, 2.0, 2.999, 3.0, 3.5, 5.0, 8.0, 12.0]
    for x, got in spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x"))).collect():
        assert got == pytest.approx(math.erfc(x), rel=1e-9, abs=1e-300)
    assert spark.range(1).select(two_sided_p(F.lit(-1.959963984540054))).first()[0] == pytest.approx(0.05, rel=1e-9)


@pytest.mark.parametrize("c, t, effect, z, p", [((100, 20), (200, 40), 0.0, 0.0, 1.0), ((10, 0), (10, 0), 0.0, 0.0, 1.0), ((10, 10), (12, 12), 0.0, 0.0, 1.0)])
def test_flat_outcomes(spark, c, t, effect, z, p):
    r = inf.two_proportion_test(counts(spark, [("control", *c), ("treatment", *t)])).first()
    assert (r.absolute_effect, r.z_statistic, r.p_value, r.statistically_detectable) == (effect, z, p, False)


def test_published_magnitudes(spark):
    # n 1,341 / 1,364 with a difference of -1.37 percentage points has p near 0.37 and an interval near [-4.36, 1.62].
    c = counts(spark, [("control", 1341, 276), ("treatment", 1364, 262)])
    r, w = inf.two_proportion_test(c).first(), inf.newcombe_interval(c).first()
    assert r.absolute_effect * 100 == pytest.approx(-1.37, abs=0.02) and r.p_value == pytest.approx(0.3697, abs=0.01)
    assert (w.confidence_interval_low * 100, w.confidence_interval_high * 100) == (pytest.approx(-4.36, abs=0.05), pytest.approx(1.62, abs=0.05))


def test_zero_control_rate_has_no_relative_effect(spark):
    r = inf.two_proportion_test(counts(spark, [("control", 50, 0), ("treatment", 50, 10)])).first()
    assert r.relative_effect is None and r.statistically_detectable
    m = inf.binary_mde(inf.two_proportion_test(counts(spark, [("control", 50, 0), ("treatment", 50, 10)]))).first()
    assert m.mde_pp is None and m.status == "not_estimable_saturated_baseline"


def test_holm_steps_down_inside_the_supportive_family(spark):
    df = spark.createDataFrame([("e", "a", "secondary", "t", 0.01), ("e", "b", "guardrail", "t", 0.04), ("e", "c", "commercial", "t", 0.03), ("e", "p", "primary", "t", 0.001), ("f", "a", "secondary", "t", 0.04)],
                               "experiment_id string, metric_key string, metric_role string, test string, raw_p_value double")
    got = {(r.experiment_id, r.metric_key): (round(r.holm_adjusted_p_value, 10), r.detectable_after_holm) for r in inf.holm_adjust(df).collect()}
    assert got == {("e", "a"): (0.03, True), ("e", "c"): (0.06, False), ("e", "b"): (0.06, False), ("f", "a"): (0.04, True)}


def values(spark, control, treatment, parts=4):
    rows = [("e", "m", "commercial", f"c{i}", "control", round(v * 100)) for i, v in enumerate(control)]
    rows += [("e", "m", "commercial", f"t{i}", "treatment", round(v * 100)) for i, v in enumerate(treatment)]
    return spark.createDataFrame(rows, "experiment_id string, metric_key string, metric_role string, assignment_id string, variant string, minor_units long").repartition(parts)


def test_zero_heavy_revenue(spark):
    v = values(spark, [0, 0, 0, 11.99] * 25, [0, 0, 11.99, 11.99] * 25)
    r = inf.mean_diff_inference(v, replicates=2000).first()
    assert r.absolute_effect == pytest.approx(11.99 / 4) and r.confidence_interval_low > 0 and r.permutation_p_value < 0.01
    # Bootstrap width against the normal approximation of the same difference.
    sd = math.sqrt(11.99**2 * (0.25 * 0.75 + 0.25) / 100)
    assert r.confidence_interval_high - r.confidence_interval_low == pytest.approx(2 * 1.96 * sd, rel=0.12)


def test_resampling_ignores_partitioning(spark):
    a = inf.mean_diff_inference(values(spark, [0, 1, 2, 3] * 10, [0, 1, 4, 4] * 10, 2), replicates=300).first()
    b = inf.mean_diff_inference(values(spark, [0, 1, 2, 3] * 10, [0, 1, 4, 4] * 10, 7), replicates=300).first()
    assert a == b


def test_permutation_p_matches_enumeration(spark):
    control, treatment = [0, 1, 2], [2, 5, 7, 1]
    pool = control + treatment
    seen = abs(sum(treatment) / 4 - sum(control) / 3)
    hits = [abs((sum(pool) - sum(pick)) / 4 - sum(pick) / 3) >= seen - 1e-12 for pick in itertools.combinations(pool, 3)]
    p = inf.permutation_test(values(spark, control, treatment), replicates=4000).first().permutation_p_value
    assert p == pytest.approx(sum(hits) / len(hits), abs=0.03)


@pytest.mark.parametrize("n", [400, 50_000])
def test_interval_agrees_with_the_normal_approximation_at_any_size(spark, n):
    """Counts per value are drawn the same way at every size."""
    control, treatment = [(7 * i) % 101 for i in range(n)], [(11 * i) % 131 for i in range(n)]
    r = inf.bootstrap_mean_diff(values(spark, control, treatment), replicates=3000).first()
    mean = lambda x: sum(x) / len(x)
    var = lambda x: sum((v - mean(x)) ** 2 for v in x) / len(x)
    effect = mean(treatment) - mean(control)
    half = 1.96 * ((var(control) + var(treatment)) / n) ** 0.5
    assert r.confidence_interval_low == pytest.approx(effect - half, abs=0.08 * half)
    assert r.confidence_interval_high == pytest.approx(effect + half, abs=0.08 * half)


def test_every_planned_metric_has_a_verdict(spark):
    rows = [("ok", "control", True, 0.5)] * 40 + [("ok", "treatment", True, 0.5)] * 42 + [("one", "control", True, 0.5)] * 5 + [("third", "control", True, 0.5), ("third", "other", True, 0.5)]
    rows += [("skew", "control", True, 0.5)] * 90 + [("skew", "treatment", True, 0.5)] * 10 + [("none", "control", True, None), ("none", "treatment", True, None), ("young", "control", False, 0.5)]
    outcomes = spark.createDataFrame(rows, "experiment_id string, variant string, analysis_window_mature boolean, allocation_probability double")
    plan = spark.createDataFrame([(e, "m", "primary", "ready_binary") for e in ("ok", "one", "third", "skew", "none", "young", "absent")],
                                 "experiment_id string, metric_key string, metric_role string, inference_status string")
    got = {r.experiment_id: r.blocked_reason for r in inf.blocked_metrics(outcomes, plan).collect()}
    assert got == {"ok": None, "one": "missing_arm", "third": "unexpected_arm", "skew": "sample_ratio_mismatch", "none": "invalid_allocation",
                   "young": "no_mature_user", "absent": "no_mature_user"}


def test_variant_draw_follows_allocation_in_any_order(spark):
    who = spark.range(20_000).selectExpr("'x' experiment_id", "id user_id")
    a = draw_variant(who, (("control", 0.4), ("treatment", 0.6)))
    share = a.where("variant = 'control'").count() / 20_000
    assert share == pytest.approx(0.4, abs=0.012)
    b = draw_variant(who.repartition(5).orderBy(F.desc("user_id")), (("control", 0.4), ("treatment", 0.6)))
    assert a.exceptAll(b).isEmpty() and {r[0] for r in a.select("allocation_probability").distinct().collect()} == {0.4, 0.6}


def test_srm_flags_a_lopsided_split(spark):
    rows = [("e", "control", 0.5)] * 700 + [("e", "treatment", 0.5)] * 500 + [("f", "control", 0.4)] * 410 + [("f", "treatment", 0.6)] * 590
    df = spark.createDataFrame(rows, "experiment_id string, variant string, allocation_probability double")
    got = {r.experiment_id: (r.mismatch_detected, r.chi_square) for r in inf.srm_check(df).collect()}
    assert got["e"][0] and not got["f"][0] and got["e"][1] == pytest.approx(2 * 100**2 / 600)


def test_guards(spark):
    rows = [("a", "control", True, 1), ("a", "treatment", True, 1), ("b", "control", True, 1), ("b", "other", False, 2), ("c", "control", True, None), ("c", "treatment", True, 1)]
    df = spark.createDataFrame(rows, "experiment_id string, variant string, analysis_window_mature boolean, observation_cutoff_at int")
    got = {r.experiment_id: (r.two_arms, r.one_lineage, r.all_mature) for r in inf.experiment_guards(df).collect()}
    assert got == {"a": (True, True, True), "b": (False, False, False), "c": (True, False, True)}


def test_decision_evidence_holds_effect_interval_adjustment_and_sensitivity(spark):
    c = counts(spark, [("control", 1000, 200), ("treatment", 1000, 260)])
    binary = inf.two_proportion_test(c)
    v = values(spark, [0, 0, 0, 11.99] * 25, [0, 0, 11.99, 11.99] * 25).withColumn("metric_key", F.lit("money"))
    means = inf.mean_diff_inference(v, replicates=300)
    plan = spark.createDataFrame([("e", "m", "primary", "ready_binary"), ("e", "money", "commercial", "pending_continuous_inference"), ("e", "later", "guardrail", "excluded_deferred")],
                                 "experiment_id string, metric_key string, metric_role string, inference_status string")
    holm = inf.holm_adjust(inf.completed_p_values(binary, means))
    rows = {r.metric_key: r for r in inf.decision_evidence(plan, binary, inf.newcombe_interval(c), means, holm, inf.binary_mde(binary), inf.mean_mde(v)).collect()}
    m, money, later = rows["m"], rows["money"], rows["later"]
    assert m.effect == pytest.approx(6.0) and m.confidence_interval_low < 6 < m.confidence_interval_high and m.holm_adjusted_p_value is None and m.mde > 0
    assert money.effect_unit == "GBP_per_assigned_user" and money.holm_adjusted_p_value == money.raw_p_value and money.mde > 0
    assert (later.outcome_type, later.effect, later.inference_status) == (None, None, "excluded_deferred")
