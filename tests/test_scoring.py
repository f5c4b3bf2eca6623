import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordered_prefix
from tidemark.operators import events as ev
from tidemark.operators import models, scoring

T = dt.datetime


def brute_auc_ap(y, p):
    pos, neg = [s for s, t in zip(p, y) if t], [s for s, t in zip(p, y) if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, tp, seen = 0.0, 0, 0
    for s in sorted(set(p), reverse=True):
        hit = sum(1 for a, t in zip(p, y) if a == s and t)
        tp, seen = tp + hit, seen + sum(1 for a in p if a == s)
        ap += hit * tp / seen
    return auc, ap / len(pos)


def scored(spark, n=400, seed=3, grid=20):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 1), rnd.randint(0, grid) / grid) for i in range(n)]
    return rows, spark.createDataFrame(rows, "subscription_id long, label int, p double")


def test_rank_metrics_against_brute_force(spark):
    rows, df = scored(spark)
    y, p = [r[1] for r in rows], [r[2] for r in rows]
    m = scoring.probability_metrics(df).first()
    auc, ap = brute_auc_ap(y, p)
    assert m.roc_auc == pytest.approx(auc) and m.average_precision == pytest.approx(ap)
    assert m.brier_score == pytest.approx(np.mean([(a - b) ** 2 for a, b in zip(p, y)]))
    one = scoring.probability_metrics(df.withColumn("label", F.lit(1))).first()
    assert one.roc_auc is None and one.average_precision is None


def test_constant_score_has_auc_one_half(spark):
    _, df = scored(spark)
    assert scoring.probability_metrics(df.withColumn("p", F.lit(0.3))).first().roc_auc == pytest.approx(0.5)


def test_bins_cover_the_population_and_targets_start_at_the_riskiest(spark):
    rows, df = scored(spark, 1991, grid=3)
    bins = sorted(scoring.reliability_bins(df).collect(), key=lambda r: r.bin_number)
    assert [b.row_count for b in bins] == [200] + [199] * 9
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    for c, r in zip((0.1, 0.2, 0.3), sorted(scoring.targeting_utility(df).collect(), key=lambda r: r.capacity)):
        k = -(-len(rows) * int(c * 10) // 10)
        assert r.targeted_count == k and r.targeted_non_conversions == sum(1 for x in order[:k] if x[1] == 0)


def test_prefix_with_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [(1 if rnd.random() < 0.4 else rnd.randint(2, 50), rnd.randint(0, 500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, t int, i int").repartition(6)
    got = {r.i: r.run for r in ordered_prefix(df, [F.col("t"), F.col("i")], [F.floor(F.col("t") / 10)], {"run": F.lit(1)}, ["k"]).collect()}
    want, seen = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert got == want


def test_prefix_keeps_rows_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 25), ("a", 3), (None, 12)], "k string, t int")
    got = {(r.k, r.t): r.n for r in ordered_prefix(df, [F.col("t")], [F.floor(F.col("t") / 10)], {"n": F.lit(1)}, ["k"]).collect()}
    assert got == {(None, 1): 1, (None, 12): 2, (None, 25): 3, ("a", 3): 1}


def test_prior_activity_against_brute_force(spark):
    rnd = random.Random(5)
    names = ["session_started", "feature_used", "paywall_viewed"]
    rows = [(i, rnd.choice([1, 1, 1, 2, 3]), T(2024, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 4000)), rnd.choice(names)) for i in range(600)]
    got = {r.event_id: (r.prior_sessions, r.prior_features) for r in ev.prior_activity(spark.createDataFrame(rows, "event_id long, user_id long, occurred_at timestamp_ntz, event_name string")).collect()}
    for i, u, at, name in rows:
        if name == "paywall_viewed":
            before = [n for j, v, t, n in rows if v == u and (t, j) < (at, i)]
            assert got[i] == (before.count("session_started"), before.count("feature_used"))


FEATURES = dict(
    subscription_id=1, trial_started_at=T(2024, 3, 28), trial_ends_at=T(2024, 4, 4), prediction_at=T(2024, 4, 2), label_ready_at=T(2024, 4, 7),
    observation_cutoff_at=T(2024, 4, 7), max_observed_trial_activity_at=T(2024, 4, 1), install_to_signup_hours=1.0, signup_to_trial_hours=2.0,
    onboarding_started_before_prediction=1, onboarding_completed_before_prediction=1, pretrial_session_count=0, pretrial_feature_event_count=0,
    pretrial_paywall_view_count=0, trial_session_count=1, trial_feature_event_count=1, trial_active_day_count=1, trial_distinct_feature_count=1,
    hours_since_last_trial_activity=24.0, converted_to_paid=1)


@pytest.mark.parametrize("change, broken", [
    # The trial crosses the European clock change; elapsed time is what counts.
    ({}, None),
    ({"trial_ends_at": T(2024, 4, 4, 1)}, {"trial_is_seven_elapsed_days", "prediction_48h_before_end", "label_72h_after_end"}),
    ({"max_observed_trial_activity_at": T(2024, 4, 2, 0, 0, 1)}, {"no_activity_after_prediction"}),
    ({"observation_cutoff_at": T(2024, 4, 6)}, {"label_observed_at_cutoff"}),
    ({"converted_to_paid": 2}, {"label_is_binary"}),
    ({"trial_session_count": -1}, {"counts_non_negative"}),
    ({"trial_distinct_feature_count": 3}, {"distinct_features_within_events"}),
    ({"onboarding_started_before_prediction": 0}, {"onboarding_completed_needs_start"}),
    ({"signup_to_trial_hours": -0.5}, {"elapsed_hours_non_negative"}),
    ({"hours_since_last_trial_activity": None}, {"recency_null_iff_no_activity"}),
    ({"hours_since_last_trial_activity": 121.0}, {"recency_within_five_days"}),
])
def test_one_mutation_breaks_its_own_check(spark, change, broken):
    row = FEATURES | change
    df = spark.createDataFrame([tuple(row.values())], ", ".join(
        f"{k} {'timestamp_ntz' if isinstance(v, dt.datetime) else 'double' if isinstance(v, float) else 'int'}" for k, v in FEATURES.items()))
    failed = {r.check_name for r in scoring.leakage_checks(df).collect() if not r.passed}
    assert failed == (broken or set())


def test_duplicate_trials_are_leakage(spark):
    df = spark.createDataFrame([tuple(FEATURES.values())] * 2, ", ".join(
        f"{k} {'timestamp_ntz' if isinstance(v, dt.datetime) else 'double' if isinstance(v, float) else 'int'}" for k, v in FEATURES.items()))
    assert {r.check_name: r.violation_count for r in scoring.leakage_checks(df).collect() if not r.passed} == {"subscription_id_unique": 1}


def test_scaling_stats_match_numpy(spark):
    xs = [1.5, None, 2.0, 9.0, -3.25, 2.0, None, 7.0]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "a double, b int")
    r = {s.feature: s for s in scoring.feature_scaling_stats(df, ["a", "b"]).collect()}
    med = np.median([x for x in xs if x is not None])
    filled = [med if x is None else x for x in xs]
    assert (r["a"].present, r["a"].missing, r["a"].median) == (6, 2, med)
    assert r["a"].mean == pytest.approx(np.mean(filled)) and r["a"].stddev_pop == pytest.approx(np.std(filled)) and r["b"].median == 3.5


def feature_rows(spark, n=240):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        x, plat = rnd.gauss(0, 2), rnd.choice(["ios", "android"])
        y = int(rnd.random() < 1 / (1 + np.exp(-(0.8 * x + (plat == "ios")))))
        rows.append((i, "train" if i < n * 2 // 3 else "validation", plat, "a", "GB", "monthly", x, rnd.random(), 1, rnd.randint(0, 1), y))
    return rows, spark.createDataFrame(rows, "subscription_id long, split string, platform string, acquisition_channel string, country_code string, billing_period string, "
                                             "install_to_signup_hours double, signup_to_trial_hours double, onboarding_started_before_prediction int, "
                                             "onboarding_completed_before_prediction int, converted_to_paid int")


def test_logistic_solves_the_penalised_problem(spark):
    rows, df = feature_rows(spark)
    train = df.where("split = 'train'")
    prep, model = models.fit_logistic(train, models.STATIC)
    data = [(r.features.toArray(), r.label) for r in prep.apply(train).select("features", "label").collect()]
    X, y = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    w, b = model.coefficients.toArray(), model.intercept
    residual = 1 / (1 + np.exp(-(X @ w + b))) - y
    # Gradient of sum log loss + |w|^2 / 2 vanishes at the solution.
    assert np.abs(X.T @ residual + w).max() < 0.02 and abs(residual.sum()) < 0.02


def test_calibration_maps_into_probabilities(spark):
    rnd = random.Random(2)
    rows = [(i, int(rnd.random() < 0.3 + 0.4 * (i % 100) / 100), (i % 100) / 100 * 0.98 + 0.01) for i in range(600)]
    df = spark.createDataFrame(rows, "subscription_id long, label int, p double")
    out = models.calibrate(df, df)
    m = {r.method: r for r in scoring.calibration_choice(out).collect()}
    assert set(m) == {"none", "sigmoid", "isotonic"} and m["isotonic"].brier_score <= m["none"].brier_score
    assert out.where("p < 0 or p > 1").isEmpty() and sum(r.chosen for r in m.values()) == 1


def test_schema_checks_name_what_is_wrong(spark):
    good = dict.fromkeys([*scoring.CARRIED, *scoring.CATEGORICAL, *scoring.NUMERIC, scoring.LABEL])
    kind = lambda c: "double" if c in scoring.NUMERIC else "int" if c == scoring.LABEL else "string"
    frame = spark.createDataFrame([], ", ".join(f"{c} {kind(c)}" for c in good))
    assert scoring.schema_checks(frame).where("not passed").count() == 0
    wrong = frame.drop("platform").withColumn("expired_at", F.lit(None).cast("timestamp")).withColumn("extra", F.lit(1)).withColumn("signup_to_trial_hours", F.lit("x"))
    assert {r.column_name: r.verdict for r in scoring.schema_checks(wrong).where("not passed").collect()} == {
        "platform": "missing", "expired_at": "forbidden", "extra": "unexpected", "signup_to_trial_hours": "not_numeric"}
