"""Oracle SQL of point-in-time features and score evaluation."""

from __future__ import annotations

from tidemark.operators.scoring import ACTIVITY_COUNTS, CATEGORICAL, FORBIDDEN, CARRIED, LABEL, NUMERIC
from tidemark.plans.oracle_experiments import _r
from tidemark.plans.oracle_resampling import key, resampled


def _score(factor: int) -> str:
    return f"((t.subscription_id * {factor}) % 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE"


def _metrics(source: str, by: str = "") -> str:
    """Brier, log loss, AUC by mid-ranks and step average precision, straight from the rows."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {keys}count(*) AS row_count, avg(CAST(label AS DOUBLE)) AS observed_rate, avg(p) AS probability_mean, min(p) AS probability_min,
  max(p) AS probability_max, avg((p - label) * (p - label)) AS brier_score, -avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss,
  CASE WHEN max(pos) > 0 AND max(pos) < count(*) THEN (sum(CASE WHEN label = 1 THEN rk + (tied - 1) / 2.0::DOUBLE END) - max(pos) * (max(pos) + 1) / 2.0::DOUBLE)
    / (CAST(max(pos) AS DOUBLE) * (count(*) - max(pos))) END AS roc_auc,
  CASE WHEN max(pos) > 0 AND max(pos) < count(*) THEN sum(CASE WHEN label = 1 THEN CAST(tp AS DOUBLE) / seen END) / max(pos) END AS average_precision
FROM (SELECT *, rank() OVER ({part}ORDER BY p) AS rk, count(*) OVER (PARTITION BY {keys}p) AS tied, sum(label) OVER ({part.strip()}) AS pos,
  sum(label) OVER ({part}ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS tp, count(*) OVER ({part}ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS seen
  FROM {source}){group}"""


_ROUNDED = _r("observed_rate", "probability_mean", "probability_min", "probability_max", "brier_score", "log_loss", "roc_auc", "average_precision")

SHARED: dict[str, str] = {
    "s_eligible": """SELECT *, trial_ends_at - INTERVAL 48 HOUR AS prediction_at, trial_ends_at + INTERVAL 72 HOUR AS label_ready_at FROM m_prediction
WHERE is_mature_trial AND trial_ends_at + INTERVAL 72 HOUR <= observation_cutoff_at""",
    "s_activity": """
SELECT e.subscription_id,
  count(*) FILTER (WHERE p.occurred_at < e.trial_started_at AND p.event_name = 'session_started') AS pretrial_session_count,
  count(*) FILTER (WHERE p.occurred_at < e.trial_started_at AND p.event_name = 'feature_used') AS pretrial_feature_event_count,
  count(*) FILTER (WHERE p.occurred_at < e.trial_started_at AND p.event_name = 'paywall_viewed') AS pretrial_paywall_view_count,
  count(*) FILTER (WHERE p.occurred_at >= e.trial_started_at AND p.event_name = 'session_started') AS trial_session_count,
  count(*) FILTER (WHERE p.occurred_at >= e.trial_started_at AND p.event_name = 'feature_used') AS trial_feature_event_count,
  count(DISTINCT CAST(p.occurred_at AS DATE)) FILTER (WHERE p.occurred_at >= e.trial_started_at AND p.event_name IN ('session_started', 'feature_used')) AS trial_active_day_count,
  count(DISTINCT p.feature_name) FILTER (WHERE p.occurred_at >= e.trial_started_at AND p.event_name = 'feature_used') AS trial_distinct_feature_count,
  max(p.occurred_at) FILTER (WHERE p.occurred_at >= e.trial_started_at AND p.event_name IN ('session_started', 'feature_used')) AS max_observed_trial_activity_at
FROM s_eligible e LEFT JOIN product_events p ON p.user_id = e.user_id AND p.occurred_at >= e.signed_up_at AND p.occurred_at <= e.prediction_at
  AND p.event_name IN ('session_started', 'feature_used', 'paywall_viewed') GROUP BY 1""",
    "s_features": f"""
SELECT e.subscription_id, e.user_id, e.installation_id, e.trial_started_at, e.trial_ends_at, e.prediction_at, e.label_ready_at, e.observation_cutoff_at,
  CAST(e.price_gbp AS DOUBLE) AS price_gbp, a.max_observed_trial_activity_at, {", ".join("e." + c for c in CATEGORICAL)},
  date_diff('microsecond', e.installed_at, e.signed_up_at) / 1000000.0::DOUBLE / 3600.0::DOUBLE AS install_to_signup_hours,
  date_diff('microsecond', e.signed_up_at, e.trial_started_at) / 1000000.0::DOUBLE / 3600.0::DOUBLE AS signup_to_trial_hours,
  CASE WHEN e.onboarding_started_at <= e.prediction_at THEN 1 ELSE 0 END AS onboarding_started_before_prediction,
  CASE WHEN e.onboarding_completed_at <= e.prediction_at THEN 1 ELSE 0 END AS onboarding_completed_before_prediction,
  {", ".join("a." + c for c in ACTIVITY_COUNTS)},
  date_diff('microsecond', a.max_observed_trial_activity_at, e.prediction_at) / 1000000.0::DOUBLE / 3600.0::DOUBLE AS hours_since_last_trial_activity,
  CASE WHEN e.converted_to_paid THEN 1 ELSE 0 END AS converted_to_paid
FROM s_eligible e JOIN s_activity a ON a.subscription_id = e.subscription_id""",
    "s_split": """SELECT *, CASE WHEN trial_started_at < TIMESTAMP '2024-01-10' THEN 'train' WHEN trial_started_at < TIMESTAMP '2024-01-15' THEN 'validation'
  WHEN trial_started_at < TIMESTAMP '2024-01-18' THEN 'test' ELSE 'excluded' END AS split FROM s_features""",
    "s_scored": f"""
SELECT t.subscription_id, t.trial_started_at, t.billing_period, i.platform, i.acquisition_channel,
  CASE WHEN t.subscription_started_at IS NOT NULL THEN 1 ELSE 0 END AS label, {_score(7919)} AS p, {_score(104729)} AS p2, {_score(1299709)} AS p3
FROM trials t JOIN installations i ON i.installation_id = t.installation_id""",
    "s_models": """SELECT 'behavioural' AS model, label, p FROM s_scored UNION ALL SELECT 'boosted', label, p2 FROM s_scored
UNION ALL SELECT 'static', label, p3 FROM s_scored""",
    "s_model_metrics": _metrics("s_models", "model"),
    "s_methods": """SELECT 'none' AS method, label, p FROM s_scored
UNION ALL SELECT 'sigmoid', label, 1.0 / (1.0 + exp(-(0.5 * ln(p / (1.0 - p)) - 0.7))) FROM s_scored UNION ALL SELECT 'isotonic', label, 0.2 + 0.3 * p FROM s_scored""",
    "s_method_metrics": _metrics("s_methods", "method"),
    "s_segments": """SELECT 'month' AS dimension, strftime(trial_started_at, '%Y-%m') AS "group", label, p FROM s_scored
UNION ALL SELECT 'platform', platform, label, p FROM s_scored UNION ALL SELECT 'billing_period', billing_period, label, p FROM s_scored
UNION ALL SELECT 'acquisition_channel', acquisition_channel, label, p FROM s_scored""",
    "s_delta": """SELECT subscription_id, (p - label) * (p - label) - (p2 - label) * (p2 - label) AS b,
  -(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) + (CASE WHEN label = 1 THEN ln(p2) ELSE ln(1 - p2) END) AS l FROM s_scored""",
    # Isotonic regression by its max-min formula over runs of distinct scores, without any pooling.
    "s_points": """SELECT p, row_number() OVER (ORDER BY p) AS i, sum(y) OVER (ORDER BY p) AS ys, sum(n) OVER (ORDER BY p) AS ns
FROM (SELECT p, sum(label) AS y, count(*) AS n FROM s_scored GROUP BY p)""",
    "s_fitted": """
SELECT p, max(low) AS value FROM (
  SELECT j.i AS j, k.p, k.i AS k, min((k.ys - coalesce(b.ys, 0)) / CAST(k.ns - coalesce(b.ns, 0) AS DOUBLE)) OVER (PARTITION BY j.i ORDER BY k.i DESC) AS low
  FROM s_points j JOIN s_points k ON k.i >= j.i LEFT JOIN s_points b ON b.i = j.i - 1) GROUP BY p""",
    "s_iso": """
SELECT min(p) AS lo, max(p) AS hi, sum(positives)::BIGINT AS positives, sum(n)::BIGINT AS n, any_value(value) AS value
FROM (SELECT f.p, f.value, count(*) AS n, sum(s.label) AS positives FROM s_fitted f JOIN s_scored s ON s.p = f.p GROUP BY f.p, f.value) GROUP BY round(value, 12)""",
    **resampled("s_pair", f"""
SELECT '{{"part":"all"}}' AS g, {key("'paired'", "'{\"part\":\"all\"}'")} AS salt, sum(n) OVER ()::BIGINT AS drawn,
  {key("'value'", "label::VARCHAR", "floor(p * 1e15)::BIGINT::VARCHAR", "floor(p2 * 1e15)::BIGINT::VARCHAR")} AS key, n, b AS m1, l AS m2
FROM (SELECT label, p, p2, count(*) AS n, any_value(b) AS b, any_value(l) AS l FROM s_scored JOIN s_delta USING (subscription_id) GROUP BY 1, 2, 3)""", 2_000, True),
}

_DELTAS = ("brier_score", "log_loss", "roc_auc", "average_precision")
_RANK = "row_number() OVER (ORDER BY p, subscription_id)"

BODIES: dict[str, str] = {
    "trial_eligible": "SELECT * FROM s_eligible",
    "trial_activity": "SELECT * FROM s_activity",
    "trial_features": "SELECT * FROM s_features",
    "label_reconciliation": """SELECT *, row_trials = cohort_trials AND row_mature = cohort_mature AND row_converted = cohort_converted AS reconciled
FROM (SELECT count(*) AS row_trials, count(*) FILTER (WHERE is_mature_trial) AS row_mature, count(*) FILTER (WHERE is_mature_trial AND converted_to_paid) AS row_converted FROM m_prediction),
  (SELECT CAST(sum(trial_count) AS BIGINT) AS cohort_trials, CAST(sum(mature_trial_count) AS BIGINT) AS cohort_mature,
    CAST(sum(mature_trial_paid_conversion_count) AS BIGINT) AS cohort_converted FROM m_trials)""",
    "leakage_checks": "SELECT check_name, violation_count, violation_count = 0 AS passed FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, count(*) AS violation_count FROM s_features WHERE {cond}" for n, cond in (
            ("trial_is_seven_elapsed_days", "trial_ends_at <> trial_started_at + INTERVAL 7 DAY"),
            ("prediction_48h_before_end", "prediction_at <> trial_ends_at - INTERVAL 48 HOUR"),
            ("label_72h_after_end", "label_ready_at <> trial_ends_at + INTERVAL 72 HOUR"),
            ("label_observed_at_cutoff", "label_ready_at > observation_cutoff_at"),
            ("no_activity_after_prediction", "max_observed_trial_activity_at > prediction_at"),
            ("label_is_binary", "converted_to_paid IS NULL OR converted_to_paid NOT IN (0, 1)"),
            ("counts_non_negative", " OR ".join(f"coalesce({c}, -1) < 0" for c in ACTIVITY_COUNTS)),
            ("distinct_features_within_events", "trial_distinct_feature_count > trial_feature_event_count"),
            ("onboarding_completed_needs_start", "onboarding_completed_before_prediction = 1 AND onboarding_started_before_prediction <> 1"),
            ("elapsed_hours_non_negative", "coalesce(install_to_signup_hours, -1) < 0 OR coalesce(signup_to_trial_hours, -1) < 0"),
            ("recency_null_iff_no_activity", "(max_observed_trial_activity_at IS NULL) <> (hours_since_last_trial_activity IS NULL)"),
            ("recency_within_five_days", "hours_since_last_trial_activity < 0 OR hours_since_last_trial_activity > 120.000001"))
    ) + " UNION ALL SELECT 'subscription_id_unique', count(*) - count(DISTINCT subscription_id) FROM s_features)",
    "feature_schema_checks": f"""
SELECT * FROM (WITH found AS (SELECT unnest(json_keys(to_json(t))) AS c FROM (SELECT * FROM s_features LIMIT 1) t),
wanted AS (SELECT unnest({[*CARRIED, *CATEGORICAL, *NUMERIC, LABEL]!r}) AS c), barred AS (SELECT unnest({list(FORBIDDEN)!r}) AS c),
every AS (SELECT c FROM found UNION SELECT c FROM wanted UNION SELECT c FROM barred)
SELECT c AS column_name, c IN (FROM found) AS present, c IN (FROM wanted) AS expected, c IN (FROM barred) AS forbidden,
  CASE WHEN c IN (FROM found) AND c IN (FROM barred) THEN 'forbidden' WHEN c IN (FROM wanted) AND c NOT IN (FROM found) THEN 'missing'
    WHEN c IN (FROM found) AND c NOT IN (FROM wanted) THEN 'unexpected' ELSE 'ok' END AS verdict,
  (c IN (FROM found)) = (c IN (FROM wanted)) AND NOT (c IN (FROM found) AND c IN (FROM barred)) AS passed FROM every)""",
    "temporal_split": "SELECT subscription_id, trial_started_at, split FROM s_split",
    "split_summary": """SELECT split, count(*) AS row_count, CAST(sum(converted_to_paid) AS BIGINT) AS converted_count, CAST(sum(converted_to_paid) AS DOUBLE) / count(*) AS conversion_rate,
  CAST(min(trial_started_at) AS DATE) AS earliest_trial_date, CAST(max(trial_started_at) AS DATE) AS latest_trial_date,
  count(DISTINCT converted_to_paid) = 2 AS has_both_classes, true AS starts_after_earlier_splits FROM s_split GROUP BY 1""",
    "feature_scaling_stats": " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(v) AS present, count(*) - count(v) AS missing, round(any_value(m), 9) AS median, round(avg(coalesce(v, m)), 9) AS mean,
  round(stddev_pop(coalesce(v, m)), 9) AS stddev_pop FROM (SELECT CAST({c} AS DOUBLE) AS v, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM s_split WHERE split = 'train') AS m
  FROM s_split WHERE split = 'train')""" for c in NUMERIC),
    "category_levels": " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {c} AS level, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split <> 'train') AS other_rows,
  count(*) FILTER (WHERE split = 'train') > 0 AS encoded FROM s_split GROUP BY {c}""" for c in CATEGORICAL),
    "prevalence_baseline": """SELECT split, count(*) AS row_count, round(max(p), 9) AS prevalence, round(avg(CAST(y AS DOUBLE)), 9) AS observed_rate,
  round(avg((p - y) * (p - y)), 9) AS brier_score, round(-avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 9) AS log_loss
FROM (SELECT split, converted_to_paid AS y, (SELECT avg(CAST(converted_to_paid AS DOUBLE)) FROM s_split WHERE split = 'train') AS p FROM s_split) GROUP BY 1""",
    "probability_metrics": f"SELECT * REPLACE ({_ROUNDED}) FROM ({_metrics('s_scored')})",
    "model_ranking": f"""SELECT m.model, CAST(row_number() OVER (ORDER BY m.brier_score, m.log_loss, m.model) AS INT) AS rank, m.row_count,
  {", ".join(f"round(m.{d}, 9) AS {d}, round(m.{d} - r.{d}, 9) AS {d}_delta" for d in _DELTAS)},
  m.brier_score < r.brier_score AND m.log_loss < r.log_loss AS improves_both
FROM s_model_metrics m, (SELECT * FROM s_model_metrics WHERE model = 'static') r""",
    "temporal_folds": """SELECT subscription_id, trial_started_at, rn AS position,
  CASE WHEN rn - 1 < n - 5 * (n // 6) THEN 0 ELSE CAST(1 + (rn - 1 - (n - 5 * (n // 6))) // (n // 6) AS INT) END AS fold
FROM (SELECT *, row_number() OVER (ORDER BY trial_started_at, subscription_id) AS rn, count(*) OVER () AS n FROM s_scored)""",
    "calibration_choice": f"""SELECT m.method, m.row_count, {_r("observed_rate", "probability_mean").replace("round(", "round(m.")}, round(m.probability_mean - m.observed_rate, 9) AS mean_probability_bias,
  {", ".join(f"round(m.{d}, 9) AS {d}" for d in _DELTAS)}, m.brier_score < r.brier_score AND m.log_loss < r.log_loss AS improves_both,
  m.method = coalesce((SELECT q.method FROM s_method_metrics q WHERE q.brier_score < r.brier_score AND q.log_loss < r.log_loss ORDER BY q.brier_score, q.log_loss, q.method LIMIT 1), 'none') AS chosen
FROM s_method_metrics m, (SELECT brier_score, log_loss FROM s_method_metrics WHERE method = 'none') r""",
    "fit_invariants": """
SELECT model, count(*) AS row_count, round(avg(y), 4) AS observed_rate, round(avg(y), 4) AS mean_score, true AS scores_in_range, true AS gradient_vanishes FROM (
  SELECT m.model, CAST(converted_to_paid AS DOUBLE) AS y FROM s_split JOIN (VALUES ('static_logistic', 'train'), ('behavioural_logistic', 'train'),
    ('behavioural_logistic_refit', 'train'), ('behavioural_logistic_refit', 'validation')) m(model, part) ON m.part = split
  UNION ALL
  SELECT m.model, CAST(converted_to_paid AS DOUBLE) FROM (SELECT *, row_number() OVER (ORDER BY trial_started_at, subscription_id) AS rn, count(*) OVER () AS n FROM s_split WHERE split = 'train')
    JOIN (VALUES ('sigmoid_calibration'), ('isotonic_calibration')) m(model) ON rn > n - 5 * (n // 6)) GROUP BY model""",
    "isotonic_blocks": "SELECT lo, hi, positives, n, positives / CAST(n AS DOUBLE) AS value FROM s_iso",
    "isotonic_scores": """
SELECT subscription_id, label, round(p2, 9) AS p, round(CASE WHEN below.hi IS NULL THEN first_value WHEN p2 <= below.hi OR above.lo IS NULL THEN below.value
  ELSE below.value + (above.value - below.value) * (p2 - below.hi) / (above.lo - below.hi) END, 9) AS q
FROM s_scored s ASOF LEFT JOIN s_iso below ON s.p2 >= below.lo ASOF LEFT JOIN s_iso above ON s.p2 < above.lo, (SELECT min(value) AS first_value FROM s_iso)""",
    "reliability_bins": """SELECT CAST(b AS INT) AS bin_number, count(*) AS row_count, min(p) AS probability_min, max(p) AS probability_max, round(avg(p), 9) AS mean_predicted_conversion,
  round(avg(CAST(label AS DOUBLE)), 9) AS observed_conversion_rate, round(avg(p) - avg(CAST(label AS DOUBLE)), 9) AS calibration_gap
FROM (SELECT *, ntile(10) OVER (ORDER BY p, subscription_id) AS b FROM s_scored) GROUP BY 1""",
    "targeting_utility": " UNION ALL ".join(
        f"""SELECT {c}::DOUBLE AS capacity, count(*) FILTER (WHERE t) AS targeted_count, count(*) FILTER (WHERE label = 0) AS total_non_conversions,
  count(*) FILTER (WHERE t AND label = 0) AS targeted_non_conversions,
  round(CAST(count(*) FILTER (WHERE t AND label = 0) AS DOUBLE) / count(*) FILTER (WHERE label = 0), 9) AS non_conversion_capture_rate,
  round(CAST(count(*) FILTER (WHERE t AND label = 0) AS DOUBLE) / count(*) FILTER (WHERE t), 9) AS targeted_non_conversion_rate,
  round(CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / count(*), 9) AS overall_non_conversion_rate,
  round((CAST(count(*) FILTER (WHERE t AND label = 0) AS DOUBLE) / count(*) FILTER (WHERE t)) / (CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / count(*)), 9) AS lift_vs_population
FROM (SELECT label, {_RANK} <= ceil((count(*) OVER ()) * {c}::DOUBLE) AS t FROM s_scored)""" for c in (0.1, 0.2, 0.3)),
    "segment_robustness": f"SELECT * REPLACE ({_ROUNDED}) FROM ({_metrics('s_segments', 'dimension, \"group\"')})",
    "paired_bootstrap": """SELECT count(*) AS replicates, round(any_value(pb), 9) AS brier_delta, round(quantile_cont(mb, 0.025), 9) AS brier_ci_low, round(quantile_cont(mb, 0.975), 9) AS brier_ci_high,
  round(any_value(pl), 9) AS log_loss_delta, round(quantile_cont(ml, 0.025), 9) AS log_loss_ci_low, round(quantile_cont(ml, 0.975), 9) AS log_loss_ci_high
FROM (SELECT m1 / drawn AS mb, m2 / drawn AS ml FROM s_pair_sums),
  (SELECT avg(b) AS pb, avg(l) AS pl FROM s_delta)""",
}
