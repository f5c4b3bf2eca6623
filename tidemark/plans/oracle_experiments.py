"""Oracle SQL of experiment assignment, outcome windows and inference."""

from __future__ import annotations

from statistics import NormalDist

from tidemark.operators.registry import BINARY_METRICS, METRICS
from tidemark.plans.oracle_resampling import key, resampled

_IN = "p.occurred_at < b.assignment_at + INTERVAL '1' DAY * CAST({n} AS INT)"


def _n(event: str, n: object) -> str:
    return f"count(*) FILTER (WHERE p.event_name {event} AND {_IN.format(n=n)})"


def _erfc(x: str) -> str:
    """1 - erf(x) by the series sum x^(2n+1) / gamma(n + 3/2), for the moderate x of these tests."""
    return (f"(CASE WHEN {x} = 0 THEN 1.0 ELSE 1.0 - exp(-({x}) * ({x})) * list_sum(list_transform(range(150), "
            f"lambda n: exp((2 * n + 1) * ln({x}) - lgamma(n + 1.5)))) END)")


_ZA, _ZB = NormalDist().inv_cdf(0.975), NormalDist().inv_cdf(0.8)


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in cols)


def _wilson(arm: str) -> str:
    n, p = f"CAST({arm}_total AS DOUBLE)", f"{arm}_rate"
    mid = f"({p} + {_ZA * _ZA!r} / (2.0 * {n}))"
    half = f"{_ZA!r} * sqrt({p} * (1.0 - {p}) / {n} + {_ZA * _ZA!r} / (4.0 * {n} * {n}))"
    return (f"greatest(0.0, ({mid} - {half}) / (1.0 + {_ZA * _ZA!r} / {n})) AS {arm}_low, "
            f"least(1.0, ({mid} + {half}) / (1.0 + {_ZA * _ZA!r} / {n})) AS {arm}_high")


_W = "b.analysis_window_days"

SHARED: dict[str, str] = {
    "x_candidates": """
SELECT a.experiment_id, a.user_id, a.installation_id, x.eligibility_rule, a.assignment_at,
  CASE WHEN x.eligibility_rule <> 'new_signups' THEN a.assignment_at
       WHEN u.onboarding_started_at >= a.assignment_at AND u.onboarding_started_at < x.end_at THEN u.onboarding_started_at END AS exposed_at
FROM experiment_assignments a JOIN experiments x ON x.experiment_id = a.experiment_id JOIN users u ON u.user_id = a.user_id""",
    "x_base": """
SELECT a.assignment_id, a.experiment_id, x.analysis_window_days, a.user_id, a.installation_id, a.variant, a.allocation_probability,
  a.assignment_at, c.exposed_at, c.exposed_at IS NOT NULL AS is_exposed,
  CAST(date_diff('microsecond', a.assignment_at, c.exposed_at) AS DOUBLE) / 1000000.0 AS exposure_delay_seconds,
  u.onboarding_completed_at, i.platform, i.acquisition_channel, i.country_code, k.observation_cutoff_at,
  a.assignment_at + INTERVAL '1' DAY * CAST(x.analysis_window_days AS INT) <= k.observation_cutoff_at AS analysis_window_mature
FROM experiment_assignments a JOIN experiments x ON x.experiment_id = a.experiment_id
JOIN x_candidates c ON c.experiment_id = a.experiment_id AND c.user_id = a.user_id
JOIN users u ON u.user_id = a.user_id JOIN installations i ON i.installation_id = a.installation_id, ev_cutoff k""",
    "x_events": f"""
SELECT b.assignment_id, {_n("= 'session_started'", 7)} AS session_count_7d, {_n("= 'feature_used'", 7)} AS feature_use_event_count_7d,
  {_n("= 'paywall_viewed'", 7)} AS paywall_view_count_7d, {_n("= 'trial_started'", 7)} > 0 AS trial_started_7d,
  {_n("= 'trial_started'", 14)} > 0 AS trial_started_14d, {_n("= 'subscription_started'", 14)} > 0 AS paid_started_14d,
  {_n("= 'subscription_started'", 30)} > 0 AS paid_started_30d,
  {_n("IN ('cancellation_requested', 'subscription_expired')", 30)} > 0 AS cancellation_or_expiry_30d,
  {_n("= 'trial_started'", _W)} > 0 AS trial_started_analysis_window, {_n("= 'subscription_started'", _W)} > 0 AS paid_started_analysis_window
FROM x_base b JOIN product_events p ON p.user_id = b.user_id AND p.occurred_at >= b.assignment_at
  AND p.occurred_at < b.assignment_at + INTERVAL '1' DAY * CAST(greatest(30, b.analysis_window_days) AS INT)
GROUP BY b.assignment_id""",
    "x_revenue": """
SELECT b.assignment_id,
  CAST(coalesce(sum(t.amount_gbp) FILTER (WHERE t.attempted_at < b.assignment_at + INTERVAL 30 DAY), 0) AS DOUBLE) AS successful_revenue_gbp_30d,
  CAST(coalesce(sum(t.amount_gbp) FILTER (WHERE t.attempted_at < b.assignment_at + INTERVAL '1' DAY * CAST(b.analysis_window_days AS INT)), 0) AS DOUBLE) AS successful_revenue_gbp_analysis_window
FROM x_base b JOIN event_payments t ON t.user_id = b.user_id AND t.payment_status = 'succeeded' AND t.attempted_at >= b.assignment_at
  AND t.attempted_at < b.assignment_at + INTERVAL '1' DAY * CAST(greatest(30, b.analysis_window_days) AS INT)
GROUP BY b.assignment_id""",
    "x_outcomes": """
SELECT b.*, coalesce(e.session_count_7d, 0) AS session_count_7d, coalesce(e.feature_use_event_count_7d, 0) AS feature_use_event_count_7d,
  coalesce(e.paywall_view_count_7d, 0) AS paywall_view_count_7d, coalesce(e.trial_started_7d, false) AS trial_started_7d,
  coalesce(e.trial_started_14d, false) AS trial_started_14d, coalesce(e.paid_started_14d, false) AS paid_started_14d,
  coalesce(e.paid_started_30d, false) AS paid_started_30d, coalesce(e.cancellation_or_expiry_30d, false) AS cancellation_or_expiry_30d,
  coalesce(e.trial_started_analysis_window, false) AS trial_started_analysis_window,
  coalesce(e.paid_started_analysis_window, false) AS paid_started_analysis_window,
  coalesce(r.successful_revenue_gbp_30d, 0) AS successful_revenue_gbp_30d,
  coalesce(r.successful_revenue_gbp_analysis_window, 0) AS successful_revenue_gbp_analysis_window,
  coalesce(e.feature_use_event_count_7d, 0) > 0 AS feature_used_7d,
  coalesce(b.onboarding_completed_at >= b.assignment_at AND b.onboarding_completed_at < b.assignment_at + INTERVAL 48 HOUR, false) AS onboarding_completed_48h
FROM x_base b LEFT JOIN x_events e ON e.assignment_id = b.assignment_id LEFT JOIN x_revenue r ON r.assignment_id = b.assignment_id""",
    "x_summary": """
SELECT experiment_id, variant, count(*) AS assigned_user_count, count(*) FILTER (WHERE is_exposed) AS exposed_user_count,
  CAST(count(*) FILTER (WHERE is_exposed) AS DOUBLE) / count(*) AS exposure_rate, avg(allocation_probability) AS average_allocation_probability,
  count(*) FILTER (WHERE onboarding_completed_48h) AS onboarding_completed_48h_count,
  CAST(count(*) FILTER (WHERE onboarding_completed_48h) AS DOUBLE) / count(*) AS onboarding_completion_48h_rate,
  count(*) FILTER (WHERE feature_used_7d) AS feature_used_7d_count,
  CAST(count(*) FILTER (WHERE feature_used_7d) AS DOUBLE) / count(*) AS overall_feature_use_7d_rate,
  count(*) FILTER (WHERE trial_started_7d) AS trial_started_7d_count,
  CAST(count(*) FILTER (WHERE trial_started_7d) AS DOUBLE) / count(*) AS trial_start_conversion_7d,
  count(*) FILTER (WHERE paid_started_14d) AS paid_started_14d_count,
  CAST(count(*) FILTER (WHERE paid_started_14d) AS DOUBLE) / count(*) AS paid_conversion_14d,
  CAST(sum(CAST(round(successful_revenue_gbp_30d * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS successful_revenue_gbp_30d,
  CAST(sum(CAST(round(successful_revenue_gbp_30d * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*) AS revenue_per_assigned_user_30d,
  count(*) FILTER (WHERE cancellation_or_expiry_30d) AS cancellation_or_expiry_30d_count,
  CAST(count(*) FILTER (WHERE cancellation_or_expiry_30d) AS DOUBLE) / count(*) AS cancellation_or_expiry_30d_rate,
  avg(session_count_7d) AS average_session_count_7d, avg(feature_use_event_count_7d) AS average_feature_use_event_count_7d
FROM x_outcomes GROUP BY 1, 2""",
    "x_registry": " UNION ALL ".join(f"SELECT '{k}' AS metric_key, '{u}' AS metric_unit, '{s}' AS support_status" for k, _, u, s in METRICS),
    "x_plan": """
SELECT p.experiment_id, p.metric_role, p.metric_key, r.metric_unit, a.n AS assigned_user_count, coalesce(r.support_status, 'unknown') AS support_status,
  CASE WHEN r.support_status IS NULL THEN 'excluded_unknown_metric_contract'
       WHEN r.support_status <> 'supported' THEN concat('excluded_', r.support_status)
       WHEN p.metric_key IN (""" + ", ".join(f"'{m}'" for m in BINARY_METRICS) + """) THEN 'ready_binary'
       WHEN p.metric_key = 'revenue_per_assigned_user_30d' THEN 'pending_continuous_inference' ELSE 'excluded_no_inference_binding' END AS inference_status
FROM (""" + " UNION ALL ".join(f"SELECT experiment_id, '{r}' AS metric_role, {r}_metric AS metric_key FROM experiments" for r in ("primary", "secondary", "commercial", "guardrail")) + """) p
JOIN (SELECT experiment_id, count(*) AS n FROM experiment_assignments GROUP BY 1) a ON a.experiment_id = p.experiment_id
LEFT JOIN x_registry r ON r.metric_key = p.metric_key""",
    "x_long": " UNION ALL ".join(
        f"SELECT experiment_id, variant, '{m}' AS metric_key, {flag} AS hit FROM x_outcomes WHERE analysis_window_mature" for m, flag in BINARY_METRICS.items()),
    "x_counts": """
SELECT l.experiment_id, l.metric_key, l.variant, count(*) AS assigned_mature_count, count(*) FILTER (WHERE l.hit) AS success_count, p.metric_role
FROM x_long l JOIN x_plan p ON p.experiment_id = l.experiment_id AND p.metric_key = l.metric_key AND p.inference_status = 'ready_binary'
GROUP BY l.experiment_id, l.metric_key, l.variant, p.metric_role""",
    "x_srm": f"""
SELECT experiment_id, n1 AS control_count, n2 AS treatment_count, 0.5::DOUBLE AS control_allocation, 0.5::DOUBLE AS treatment_allocation,
  e AS expected_control_count, e AS expected_treatment_count, chi AS chi_square, {_erfc('sqrt(chi / 2.0)')} AS p_value,
  {_erfc('sqrt(chi / 2.0)')} < 0.001 AS mismatch_detected
FROM (SELECT *, (n1 - e) * (n1 - e) / e + (n2 - e) * (n2 - e) / e AS chi FROM (
  SELECT experiment_id, count(*) FILTER (WHERE variant = 'control') AS n1, count(*) FILTER (WHERE variant = 'treatment') AS n2,
    CAST(count(*) AS DOUBLE) * 0.5 AS e FROM x_base WHERE analysis_window_mature GROUP BY 1))""",
    "x_sides": """
SELECT c.experiment_id, c.metric_key, c.metric_role, c.assigned_mature_count AS control_total, c.success_count AS control_successes,
  t.assigned_mature_count AS treatment_total, t.success_count AS treatment_successes,
  CAST(c.success_count AS DOUBLE) / c.assigned_mature_count AS control_rate, CAST(t.success_count AS DOUBLE) / t.assigned_mature_count AS treatment_rate
FROM x_counts c JOIN x_counts t ON t.experiment_id = c.experiment_id AND t.metric_key = c.metric_key AND c.variant = 'control' AND t.variant = 'treatment'
WHERE c.experiment_id IN (SELECT experiment_id FROM x_srm WHERE NOT mismatch_detected)""",
    "x_ztest": f"""
SELECT * EXCLUDE (v), {_erfc('abs(z_statistic) / sqrt(2.0)')} AS p_value, {_erfc('abs(z_statistic) / sqrt(2.0)')} < 0.05 AS statistically_detectable
FROM (SELECT *, CASE WHEN v = 0 THEN 0.0 ELSE absolute_effect / sqrt(v) END AS z_statistic,
    treatment_rate / nullif(control_rate, 0) - 1.0 AS relative_effect FROM (
  SELECT *, treatment_rate - control_rate AS absolute_effect, pool * (1 - pool) * (1.0::DOUBLE / control_total + 1.0::DOUBLE / treatment_total) AS v FROM (
    SELECT *, CAST(control_successes + treatment_successes AS DOUBLE) / (control_total + treatment_total) AS pool FROM x_sides)))""",
    "x_values": """
SELECT o.experiment_id, p.metric_key, p.metric_role, o.assignment_id, o.variant, CAST(round(o.successful_revenue_gbp_30d * 100) AS BIGINT) AS minor_units
FROM x_outcomes o JOIN x_plan p ON p.experiment_id = o.experiment_id AND p.inference_status = 'pending_continuous_inference'
WHERE o.analysis_window_mature AND o.experiment_id IN (SELECT experiment_id FROM x_srm WHERE NOT mismatch_detected)""",
    "x_moments": """
SELECT experiment_id, metric_key, metric_role, count(*) FILTER (WHERE variant = 'control') AS control_count, count(*) FILTER (WHERE variant = 'treatment') AS treatment_count,
  CAST(sum(minor_units) FILTER (WHERE variant = 'control') AS DOUBLE) AS s1, CAST(sum(minor_units) FILTER (WHERE variant = 'treatment') AS DOUBLE) AS s2,
  stddev_samp(minor_units) FILTER (WHERE variant = 'control') / 100.0 AS control_stddev, stddev_samp(minor_units) FILTER (WHERE variant = 'treatment') / 100.0 AS treatment_stddev
FROM x_values GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE variant = 'control') > 0 AND count(*) FILTER (WHERE variant = 'treatment') > 0""",
    **resampled("x_draw", f"""
SELECT g, {key("'bootstrap'", "g")} AS salt, sum(n) OVER (PARTITION BY g)::BIGINT AS drawn, {key("'value'", "m1::VARCHAR")} AS key, n, m1, 0 AS m2
FROM (SELECT concat('{{"experiment_id":"', experiment_id, '","metric_key":"', metric_key, '","variant":"', variant, '"}}') AS g, minor_units AS m1, count(*) AS n FROM x_values GROUP BY ALL)""", 10_000, True),
    "x_boot": """
SELECT experiment_id, metric_key, count(*) AS replicates, quantile_cont(d, 0.025) AS confidence_interval_low, quantile_cont(d, 0.975) AS confidence_interval_high FROM (
  SELECT g::JSON ->> 'experiment_id' AS experiment_id, g::JSON ->> 'metric_key' AS metric_key, r,
    sum(m1::DOUBLE / drawn) FILTER (WHERE g::JSON ->> 'variant' = 'treatment') / 100.0 - sum(m1::DOUBLE / drawn) FILTER (WHERE g::JSON ->> 'variant' = 'control') / 100.0 AS d
  FROM x_draw_sums GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    **resampled("x_deal", f"""
SELECT g, {key("'permutation'", "g")} AS salt, sum(c) OVER (PARTITION BY g)::BIGINT AS drawn, {key("'value'", "m1::VARCHAR")} AS key, n, m1, 0 AS m2
FROM (SELECT concat('{{"experiment_id":"', experiment_id, '","metric_key":"', metric_key, '"}}') AS g, minor_units AS m1, count(*) AS n, count(*) FILTER (WHERE variant = 'control') AS c
  FROM x_values GROUP BY ALL)""", 10_000, False),
    "x_perm": """
SELECT experiment_id, metric_key, count(*) AS replicates, count(*) FILTER (WHERE far) AS extreme_count, (count(*) FILTER (WHERE far) + 1) / (count(*) + 1.0::DOUBLE) AS permutation_p_value
FROM (SELECT m.experiment_id, m.metric_key, abs((s1 + s2 - p.m1) / treatment_count - p.m1 / control_count::DOUBLE) >= abs(s2 / treatment_count - s1 / control_count) - 1e-9 AS far
  FROM x_deal_sums p JOIN x_moments m ON m.experiment_id = p.g::JSON ->> 'experiment_id' AND m.metric_key = p.g::JSON ->> 'metric_key') GROUP BY 1, 2""",
    "x_means": """
SELECT m.experiment_id, m.metric_key, m.metric_role, control_count, treatment_count, s1 / 100.0 / control_count AS control_mean, s2 / 100.0 / treatment_count AS treatment_mean,
  s2 / 100.0 / treatment_count - s1 / 100.0 / control_count AS absolute_effect,
  (s2 / 100.0 / treatment_count) / nullif(s1 / 100.0 / control_count, 0) - 1.0 AS relative_effect,
  b.confidence_interval_low, b.confidence_interval_high, p.permutation_p_value, p.permutation_p_value < 0.05 AS statistically_detectable
FROM x_moments m JOIN x_boot b ON b.experiment_id = m.experiment_id JOIN x_perm p ON p.experiment_id = m.experiment_id""",
    "x_pvalues": """
SELECT experiment_id, metric_key, metric_role, 'two_proportion_z_test' AS test, p_value AS raw_p_value FROM x_ztest
UNION ALL SELECT experiment_id, metric_key, metric_role, 'randomization_permutation_test', permutation_p_value FROM x_means""",
    "x_evidence": """
SELECT p.*, d.outcome_type, d.p_value, d.statistically_detectable FROM x_plan p LEFT JOIN (
  SELECT experiment_id, metric_key, 'binary' AS outcome_type, p_value, statistically_detectable FROM x_ztest
  UNION ALL SELECT experiment_id, metric_key, 'continuous', permutation_p_value, statistically_detectable FROM x_means) d
  ON d.experiment_id = p.experiment_id AND d.metric_key = p.metric_key""",
    "x_decisions": """
SELECT experiment_id, configured_metric_count, completed_metric_count, excluded_metric_count, primary_metric,
  CASE WHEN NOT primary_done THEN 'not_decision_ready_primary_metric_unavailable'
       WHEN primary_hit THEN 'detectable_primary_effect_requires_business_review'
       WHEN excluded_metric_count > 0 THEN 'primary_not_detectable_supporting_metrics_incomplete'
       WHEN NOT any_hit THEN 'no_detectable_effect_in_completed_metric_family'
       ELSE 'mixed_completed_evidence_requires_review' END AS decision_status
FROM (SELECT experiment_id, count(*) AS configured_metric_count, count(outcome_type) AS completed_metric_count,
    count(*) - count(outcome_type) AS excluded_metric_count, max(metric_key) FILTER (WHERE metric_role = 'primary') AS primary_metric,
    count(*) FILTER (WHERE metric_role = 'primary' AND outcome_type = 'binary') > 0 AS primary_done,
    count(*) FILTER (WHERE metric_role = 'primary' AND statistically_detectable) > 0 AS primary_hit,
    count(*) FILTER (WHERE statistically_detectable) > 0 AS any_hit FROM x_evidence GROUP BY 1)""",
}

BODIES: dict[str, str] = {
    "experiment_candidates": "SELECT * FROM x_candidates",
    "variant_assignment": """SELECT assignment_id, experiment_id, user_id,
  CAST(('0x' || substr(md5(assignment_id), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS draw, variant, allocation_probability FROM experiment_assignments""",
    "experiment_assignment_base": "SELECT * FROM x_base",
    "experiment_event_outcomes": "SELECT * FROM x_events",
    "experiment_revenue_outcomes": "SELECT * FROM x_revenue",
    "experiment_assignment_outcomes": "SELECT * FROM x_outcomes",
    "experiment_variant_summary": "SELECT * FROM x_summary",
    "experiment_maturity": """SELECT experiment_id, variant, count(*) AS assigned_user_count, count(*) FILTER (WHERE is_exposed) AS exposed_user_count,
  count(*) FILTER (WHERE analysis_window_mature) AS mature_analysis_window_count,
  CAST(count(*) FILTER (WHERE analysis_window_mature) AS DOUBLE) / count(*) AS mature_analysis_window_rate FROM x_base GROUP BY 1, 2""",
    "variant_differences": """
SELECT r.experiment_id, r.variant AS reference_variant, c.variant AS comparison_variant, r.assigned_user_count AS reference_assigned_user_count,
  c.assigned_user_count AS comparison_assigned_user_count,
  """ + ", ".join(f"round((c.{c} - r.{c}) * 100.0, 9) AS {o}_difference_pp" for c, o in (
        ("exposure_rate", "exposure_rate"), ("onboarding_completion_48h_rate", "onboarding_completion_48h"),
        ("overall_feature_use_7d_rate", "overall_feature_use_7d"), ("trial_start_conversion_7d", "trial_start_conversion_7d"),
        ("paid_conversion_14d", "paid_conversion_14d"), ("cancellation_or_expiry_30d_rate", "cancellation_or_expiry_30d"))) + """,
  round(c.revenue_per_assigned_user_30d - r.revenue_per_assigned_user_30d, 9) AS revenue_per_assigned_user_30d_difference_gbp, 'descriptive_only' AS interpretation
FROM x_summary r JOIN x_summary c ON c.experiment_id = r.experiment_id AND r.variant = 'control' AND c.variant <> 'control'""",
    "metric_support": """SELECT metric_key, CAST(sum(assigned_user_count) AS BIGINT) AS assigned_user_count, support_status, support_status = 'supported' AS allowed
FROM x_plan GROUP BY metric_key, support_status""",
    "metric_plan": "SELECT * FROM x_plan",
    "binary_outcome_counts": "SELECT * FROM x_counts",
    "experiment_guards": """SELECT *, arm_count = 2 AND unexpected_arm_rows = 0 AS two_arms, lineage_count = 1 AND missing_lineage_rows = 0 AS one_lineage, immature_rows = 0 AS all_mature
FROM (SELECT experiment_id, count(DISTINCT variant) AS arm_count, count(*) FILTER (WHERE variant NOT IN ('control', 'treatment')) AS unexpected_arm_rows,
  count(*) FILTER (WHERE NOT analysis_window_mature) AS immature_rows, count(DISTINCT observation_cutoff_at) AS lineage_count,
  count(*) FILTER (WHERE observation_cutoff_at IS NULL) AS missing_lineage_rows FROM x_base GROUP BY 1)""",
    "srm_check": f"SELECT * REPLACE ({_r('chi_square', 'p_value')}) FROM x_srm",
    "two_proportion_test": f"SELECT * EXCLUDE (pool) REPLACE ({_r('control_rate', 'treatment_rate', 'absolute_effect', 'z_statistic', 'relative_effect', 'p_value')}) FROM x_ztest",
    "newcombe_interval": f"""SELECT * REPLACE ({_r('control_rate', 'treatment_rate', 'control_low', 'control_high', 'treatment_low', 'treatment_high', 'absolute_effect')}),
  round(greatest(-1.0, absolute_effect - sqrt((treatment_rate - treatment_low) ** 2 + (control_high - control_rate) ** 2)), 9) AS confidence_interval_low,
  round(least(1.0, absolute_effect + sqrt((treatment_high - treatment_rate) ** 2 + (control_rate - control_low) ** 2)), 9) AS confidence_interval_high
FROM (SELECT *, {_wilson('control')}, {_wilson('treatment')}, treatment_rate - control_rate AS absolute_effect FROM x_sides)""",
    "bootstrap_mean_diff": f"SELECT * REPLACE ({_r('confidence_interval_low', 'confidence_interval_high')}) FROM x_boot",
    "permutation_test": f"SELECT * REPLACE ({_r('permutation_p_value')}) FROM x_perm",
    "mean_diff_inference": f"SELECT * REPLACE ({_r('control_mean', 'treatment_mean', 'absolute_effect', 'relative_effect', 'confidence_interval_low', 'confidence_interval_high', 'permutation_p_value')}) FROM x_means",
    "outcome_diagnostics": """SELECT experiment_id, metric_key, variant, count(*) AS user_count, count(*) FILTER (WHERE minor_units = 0) AS zero_count,
  CAST(count(*) FILTER (WHERE minor_units = 0) AS DOUBLE) / count(*) AS zero_rate, count(*) FILTER (WHERE minor_units > 0) AS positive_count,
  CAST(count(*) FILTER (WHERE minor_units > 0) AS DOUBLE) / count(*) AS positive_rate, count(DISTINCT minor_units) AS unique_value_count,
  min(minor_units) / 100.0 AS minimum, max(minor_units) / 100.0 AS maximum FROM x_values GROUP BY 1, 2, 3""",
    "mean_reconciliation": """SELECT v.experiment_id, v.variant, v.n AS mature_count, s.assigned_user_count, v.n = s.assigned_user_count AS population_matches,
  CASE WHEN v.n = s.assigned_user_count THEN abs(v.m - s.revenue_per_assigned_user_30d) <= 1e-12 END AS mean_reconciled
FROM (SELECT experiment_id, variant, count(*) AS n, CAST(sum(CAST(round(successful_revenue_gbp_30d * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*) AS m
  FROM x_outcomes WHERE analysis_window_mature AND experiment_id IN (SELECT experiment_id FROM x_plan WHERE inference_status = 'pending_continuous_inference') GROUP BY 1, 2) v
JOIN x_summary s ON s.experiment_id = v.experiment_id AND s.variant = v.variant""",
    "blocked_metrics": """
SELECT p.experiment_id, p.metric_key, p.metric_role, coalesce(s.n, 0) AS mature_count,
  CASE WHEN coalesce(s.n, 0) = 0 THEN 'no_mature_user' WHEN s.other > 0 THEN 'unexpected_arm' WHEN s.c * s.t = 0 THEN 'missing_arm'
    WHEN NOT coalesce(s.ca > 0 AND s.ca < 1 AND s.ta > 0 AND s.ta < 1, false) THEN 'invalid_allocation'
    WHEN p.experiment_id NOT IN (SELECT experiment_id FROM x_srm WHERE NOT mismatch_detected) THEN 'sample_ratio_mismatch'
    WHEN p.inference_status NOT IN ('ready_binary', 'pending_continuous_inference') THEN p.inference_status END AS blocked_reason
FROM x_plan p LEFT JOIN (
  SELECT experiment_id, count(*) FILTER (WHERE analysis_window_mature) AS n, count(*) FILTER (WHERE analysis_window_mature AND (variant IS NULL OR variant NOT IN ('control', 'treatment'))) AS other,
    count(*) FILTER (WHERE analysis_window_mature AND variant = 'control') AS c, count(*) FILTER (WHERE analysis_window_mature AND variant = 'treatment') AS t,
    max(allocation_probability) FILTER (WHERE analysis_window_mature AND variant = 'control') AS ca, max(allocation_probability) FILTER (WHERE analysis_window_mature AND variant = 'treatment') AS ta
  FROM x_outcomes GROUP BY 1) s ON s.experiment_id = p.experiment_id""",
    "holm_adjust": """
SELECT experiment_id, metric_key, metric_role, test, round(raw_p_value, 9) AS raw_p_value, m AS family_size, round(adj, 9) AS holm_adjusted_p_value, adj < 0.05 AS detectable_after_holm
FROM (SELECT *, max(least(1.0, raw_p_value * (m - rk + 1))) OVER (PARTITION BY experiment_id ORDER BY rk) AS adj FROM (
  SELECT *, count(*) OVER (PARTITION BY experiment_id) AS m, row_number() OVER (PARTITION BY experiment_id ORDER BY raw_p_value, metric_key) AS rk
  FROM x_pvalues WHERE metric_role <> 'primary'))""",
    "binary_mde": f"""
SELECT experiment_id, metric_key, metric_role, round(control_rate, 9) AS control_rate, control_total, treatment_total, round(o, 9) AS absolute_observed_effect_pp,
  round(m, 9) AS mde_pp, round(o / m, 9) AS effect_to_mde_ratio, CASE WHEN m IS NULL THEN 'not_estimable_saturated_baseline' ELSE 'estimated' END AS status
FROM (SELECT *, abs((treatment_rate - control_rate) * 100.0) AS o, CASE WHEN control_rate NOT IN (0, 1) THEN
  {_ZA + _ZB!r} * sqrt(control_rate * (1.0 - control_rate) * (1.0::DOUBLE / control_total + 1.0::DOUBLE / treatment_total)) * 100.0 END AS m FROM x_sides)""",
    "mean_mde": f"""
SELECT experiment_id, metric_key, metric_role, control_count, treatment_count, {_r('control_stddev', 'treatment_stddev')}, round(o, 9) AS absolute_observed_effect,
  round(m, 9) AS mde, round(o / nullif(m, 0), 9) AS effect_to_mde_ratio
FROM (SELECT *, abs(s2 / 100.0 / treatment_count - s1 / 100.0 / control_count) AS o,
  {_ZA + _ZB!r} * sqrt(control_stddev * control_stddev / control_count + treatment_stddev * treatment_stddev / treatment_count) AS m FROM x_moments)""",
    "experiment_decisions": "SELECT * FROM x_decisions",
    "experiment_evidence": """SELECT d.experiment_id, d.decision_status, e.metric_role, e.metric_key, e.outcome_type, round(e.p_value, 9) AS p_value,
  e.statistically_detectable, e.inference_status FROM x_decisions d JOIN x_evidence e ON e.experiment_id = d.experiment_id""",
}

# Evidence in full: the finished reports of tests, intervals, adjustment and sensitivity side by side.
BODIES["decision_evidence"] = f"""
SELECT p.experiment_id, p.metric_key, p.metric_role, p.inference_status, d.outcome_type, round(d.effect, 9) AS effect, d.effect_unit,
  round(d.lo, 9) AS confidence_interval_low, round(d.hi, 9) AS confidence_interval_high, round(d.p, 9) AS raw_p_value, d.statistically_detectable, round(d.mde, 9) AS mde,
  h.holm_adjusted_p_value
FROM x_plan p LEFT JOIN (
  SELECT z.experiment_id, z.metric_key, 'binary' AS outcome_type, z.absolute_effect * 100.0 AS effect, 'percentage_points' AS effect_unit,
    greatest(-1.0, z.absolute_effect - sqrt((n.treatment_rate - n.treatment_low) ** 2 + (n.control_high - n.control_rate) ** 2)) * 100.0 AS lo,
    least(1.0, z.absolute_effect + sqrt((n.treatment_high - n.treatment_rate) ** 2 + (n.control_rate - n.control_low) ** 2)) * 100.0 AS hi,
    z.p_value AS p, z.statistically_detectable, m.mde_pp AS mde
  FROM x_ztest z JOIN (SELECT *, {_wilson('control')}, {_wilson('treatment')} FROM x_sides) n ON n.experiment_id = z.experiment_id AND n.metric_key = z.metric_key
    LEFT JOIN ({BODIES["binary_mde"]}) m ON m.experiment_id = z.experiment_id AND m.metric_key = z.metric_key
  UNION ALL SELECT x.experiment_id, x.metric_key, 'continuous', x.absolute_effect, 'GBP_per_assigned_user', x.confidence_interval_low, x.confidence_interval_high,
    x.permutation_p_value, x.statistically_detectable, m.mde
  FROM x_means x LEFT JOIN ({BODIES["mean_mde"]}) m ON m.experiment_id = x.experiment_id AND m.metric_key = x.metric_key) d
  ON d.experiment_id = p.experiment_id AND d.metric_key = p.metric_key
LEFT JOIN ({BODIES["holm_adjust"]}) h ON h.experiment_id = p.experiment_id AND h.metric_key = p.metric_key"""
