"""Oracle SQL of the reporting marts and their roll-ups."""

from __future__ import annotations


def _sum(*names: str) -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)


def _rate(num: str, den: str, alias: str) -> str:
    return f"CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0) AS {alias}"


_HORIZONS = (30, 90, 180, 365)

SHARED: dict[str, str] = {
    "ev_cutoff": "SELECT max(ts) AS observation_cutoff_at FROM events",
    "ord_cutoff": "SELECT max(o_orderdate) AS observation_cutoff_at FROM orders",
    "m_lifecycle": """
SELECT i.installation_id, i.installed_at, CAST(i.installed_at AS DATE) AS installed_date,
  CAST(strftime(i.installed_at, '%Y%m%d') AS INT) AS installed_date_key, i.platform, i.acquisition_channel, i.country_code,
  count(u.user_id) AS registered_user_count, count(u.user_id) > 0 AS has_signup, min(u.signed_up_at) AS first_signed_up_at,
  count(u.onboarding_started_at) AS onboarding_started_user_count, count(u.onboarding_started_at) > 0 AS has_onboarding_started,
  min(u.onboarding_started_at) AS first_onboarding_started_at,
  count(u.onboarding_completed_at) AS onboarding_completed_user_count, count(u.onboarding_completed_at) > 0 AS has_onboarding_completed,
  min(u.onboarding_completed_at) AS first_onboarding_completed_at
FROM installations i LEFT JOIN users u ON u.installation_id = i.installation_id
GROUP BY i.installation_id, i.installed_at, i.platform, i.acquisition_channel, i.country_code""",
    "m_installs": """
SELECT installed_date_key, installed_date, platform, acquisition_channel, country_code, count(*) AS installation_count,
  count(*) FILTER (WHERE has_signup) AS installations_with_signup,
  CAST(count(*) FILTER (WHERE has_signup) AS DOUBLE) / count(*) AS install_to_signup_rate
FROM m_lifecycle GROUP BY ALL""",
    "m_signups": """
SELECT CAST(strftime(u.signed_up_at, '%Y%m%d') AS INT) AS signed_up_date_key, CAST(u.signed_up_at AS DATE) AS signed_up_date,
  i.platform, i.acquisition_channel, i.country_code, count(*) AS registered_user_count,
  count(u.onboarding_started_at) AS onboarding_started_user_count, count(u.onboarding_completed_at) AS onboarding_completed_user_count,
  CAST(count(u.onboarding_started_at) AS DOUBLE) / count(*) AS onboarding_start_rate,
  CAST(count(u.onboarding_completed_at) AS DOUBLE) / count(*) AS onboarding_completion_rate
FROM users u JOIN installations i ON i.installation_id = u.installation_id GROUP BY ALL""",
    "m_calendar": """
SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS full_date FROM (
  SELECT min(d) AS lo, max(d) AS hi FROM (SELECT CAST(installed_at AS DATE) AS d FROM installations
    UNION ALL SELECT CAST(signed_up_at AS DATE) FROM users UNION ALL SELECT CAST(ts AS DATE) FROM events))""",
    "m_daily": """
SELECT CAST(strftime(c.full_date, '%Y%m%d') AS INT) AS date_key, c.full_date, week(c.full_date) AS iso_week,
  isodow(c.full_date) >= 6 AS is_weekend, coalesce(i.n, 0) AS installation_count, coalesce(s.n, 0) AS signup_count,
  coalesce(e.c1, 0) AS session_count, coalesce(e.c2, 0) AS active_installation_count, coalesce(e.c3, 0) AS registered_dau,
  coalesce(e.c4, 0) AS feature_use_event_count, coalesce(e.c5, 0) AS feature_user_count, coalesce(e.c6, 0) AS paywall_view_count,
  coalesce(e.c7, 0) AS paywall_view_user_count, coalesce(e.c8, 0) AS onboarding_started_count,
  coalesce(e.c9, 0) AS onboarding_completed_count, coalesce(e.c10, 0) AS trial_start_count,
  coalesce(e.c11, 0) AS paid_subscription_start_count, coalesce(e.c12, 0) AS cancellation_requested_count,
  coalesce(e.c13, 0) AS subscription_expired_count, coalesce(e.c14, 0) AS payment_failed_event_count
FROM m_calendar c
LEFT JOIN (SELECT CAST(installed_at AS DATE) AS d, count(*) AS n FROM installations GROUP BY 1) i ON i.d = c.full_date
LEFT JOIN (SELECT CAST(signed_up_at AS DATE) AS d, count(*) AS n FROM users GROUP BY 1) s ON s.d = c.full_date
LEFT JOIN (SELECT CAST(occurred_at AS DATE) AS d,
    count(*) FILTER (WHERE event_name = 'session_started') AS c1,
    count(DISTINCT installation_id) FILTER (WHERE event_name = 'session_started') AS c2,
    count(DISTINCT user_id) FILTER (WHERE event_name = 'session_started') AS c3,
    count(*) FILTER (WHERE event_name = 'feature_used') AS c4,
    count(DISTINCT user_id) FILTER (WHERE event_name = 'feature_used') AS c5,
    count(*) FILTER (WHERE event_name = 'paywall_viewed') AS c6,
    count(DISTINCT user_id) FILTER (WHERE event_name = 'paywall_viewed') AS c7,
    count(*) FILTER (WHERE event_name = 'onboarding_started') AS c8,
    count(*) FILTER (WHERE event_name = 'onboarding_completed') AS c9,
    count(*) FILTER (WHERE event_name = 'trial_started') AS c10,
    count(*) FILTER (WHERE event_name = 'subscription_started') AS c11,
    count(*) FILTER (WHERE event_name = 'cancellation_requested') AS c12,
    count(*) FILTER (WHERE event_name = 'subscription_expired') AS c13,
    count(*) FILTER (WHERE event_name = 'payment_failed') AS c14
  FROM product_events GROUP BY 1) e ON e.d = c.full_date""",
    "m_revenue": f"""
SELECT CAST(strftime(c.full_date, '%Y%m%d') AS INT) AS date_key, c.full_date,
  count(t.attempted_at) AS payment_attempt_count,
  count(*) FILTER (WHERE t.payment_status = 'succeeded') AS successful_payment_count,
  count(*) FILTER (WHERE t.payment_status = 'failed') AS failed_payment_count,
  CAST(coalesce(sum(t.amount_gbp) FILTER (WHERE t.payment_status = 'succeeded'), 0) AS DOUBLE) AS successful_payment_revenue_gbp,
  count(*) FILTER (WHERE t.transaction_type = 'initial_charge') AS initial_charge_attempt_count,
  count(*) FILTER (WHERE t.transaction_type = 'initial_charge' AND t.payment_status = 'succeeded') AS successful_initial_charge_count,
  CAST(coalesce(sum(t.amount_gbp) FILTER (WHERE t.transaction_type = 'initial_charge' AND t.payment_status = 'succeeded'), 0) AS DOUBLE) AS initial_charge_revenue_gbp,
  count(*) FILTER (WHERE t.transaction_type = 'renewal') AS renewal_attempt_count,
  count(*) FILTER (WHERE t.transaction_type = 'renewal' AND t.payment_status = 'succeeded') AS successful_renewal_count,
  count(*) FILTER (WHERE t.transaction_type = 'renewal' AND t.payment_status = 'failed') AS failed_renewal_count,
  CAST(coalesce(sum(t.amount_gbp) FILTER (WHERE t.transaction_type = 'renewal' AND t.payment_status = 'succeeded'), 0) AS DOUBLE) AS renewal_revenue_gbp,
  {_rate("count(*) FILTER (WHERE t.payment_status = 'failed')", "count(t.attempted_at)", "payment_failure_rate")},
  {_rate("count(*) FILTER (WHERE t.transaction_type = 'renewal' AND t.payment_status = 'succeeded')",
         "count(*) FILTER (WHERE t.transaction_type = 'renewal')", "renewal_success_rate")}
FROM (SELECT CAST(unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS full_date FROM lineitem) c
LEFT JOIN transactions t ON CAST(t.attempted_at AS DATE) = c.full_date GROUP BY c.full_date""",
    "m_weekly": f"""
SELECT m.period_start, m.period_end, m.acquisition_channel, CAST(m.spend AS DOUBLE) AS marketing_spend_gbp,
  CAST(m.impressions AS BIGINT) AS impressions, CAST(m.clicks AS BIGINT) AS clicks,
  count(i.installation_id) AS installation_count, count(*) FILTER (WHERE i.has_signup) AS installations_with_signup,
  {_rate("count(*) FILTER (WHERE i.has_signup)", "count(i.installation_id)", "install_to_signup_rate")},
  {_rate("m.clicks", "m.impressions", "click_through_rate")}, {_rate("m.spend", "m.clicks", "cost_per_click_gbp")},
  {_rate("m.spend", "count(i.installation_id)", "cost_per_install_gbp")}
FROM marketing_spend m LEFT JOIN m_lifecycle i ON i.acquisition_channel = m.acquisition_channel
  AND i.installed_date BETWEEN m.period_start AND m.period_end
GROUP BY m.period_start, m.period_end, m.acquisition_channel, m.spend, m.impressions, m.clicks""",
    "m_features": """
SELECT CAST(occurred_at AS DATE) AS full_date, feature_name, count(*) AS feature_use_event_count,
  count(DISTINCT installation_id) AS feature_installation_count, count(DISTINCT user_id) AS feature_user_count,
  count(DISTINCT session_id) AS feature_session_count, CAST(strftime(CAST(occurred_at AS DATE), '%Y%m%d') AS INT) AS date_key
FROM product_events WHERE event_name = 'feature_used' AND feature_name IS NOT NULL GROUP BY 1, 2, 7""",
    "m_prediction": """
SELECT t.subscription_id, t.user_id, t.installation_id, t.billing_period, t.price_gbp, i.platform, i.acquisition_channel,
  i.country_code, i.installed_at, u.signed_up_at, u.onboarding_started_at, u.onboarding_completed_at, t.trial_started_at,
  t.trial_ends_at, c.observation_cutoff_at, t.trial_ends_at <= c.observation_cutoff_at AS is_mature_trial,
  t.subscription_started_at IS NOT NULL AND t.subscription_started_at <= c.observation_cutoff_at AS converted_to_paid
FROM trials t JOIN installations i ON i.installation_id = t.installation_id JOIN users u ON u.user_id = t.user_id, ev_cutoff c""",
    "m_trials": """
SELECT CAST(date_trunc('month', trial_started_at) AS DATE) AS trial_cohort_month, billing_period, platform, acquisition_channel,
  count(*) AS trial_count, count(*) FILTER (WHERE is_mature_trial) AS mature_trial_count,
  count(*) FILTER (WHERE NOT is_mature_trial) AS immature_trial_count,
  count(*) FILTER (WHERE is_mature_trial AND converted_to_paid) AS mature_trial_paid_conversion_count,
  CAST(count(*) FILTER (WHERE is_mature_trial AND converted_to_paid) AS DOUBLE)
    / nullif(count(*) FILTER (WHERE is_mature_trial), 0) AS trial_to_paid_conversion_rate
FROM m_prediction GROUP BY 1, 2, 3, 4""",
    "m_retention_base": "SELECT s.subscription_id, s.user_id, s.installation_id, CAST(date_trunc('month', s.subscription_started_at) AS DATE) AS paid_cohort_month, "
    "s.subscription_started_at, s.billing_period, s.expired_at, i.platform, i.acquisition_channel, c.observation_cutoff_at, "
    + ", ".join(
        f"s.subscription_started_at + INTERVAL {n} DAY <= c.observation_cutoff_at AS eligible_d{n}, "
        f"s.subscription_started_at + INTERVAL {n} DAY <= c.observation_cutoff_at AND (s.expired_at IS NULL OR s.expired_at > s.subscription_started_at + INTERVAL {n} DAY) AS retained_d{n}"
        for n in _HORIZONS)
    + " FROM paid_subscriptions s JOIN installations i ON i.installation_id = s.installation_id, ord_cutoff c",
    "m_retention": "SELECT paid_cohort_month, billing_period, platform, acquisition_channel, count(*) AS paid_subscription_count, "
    + ", ".join(
        f"count(*) FILTER (WHERE eligible_d{n}) AS mature_d{n}_count, count(*) FILTER (WHERE retained_d{n}) AS retained_d{n}_count, "
        + _rate(f"count(*) FILTER (WHERE retained_d{n})", f"count(*) FILTER (WHERE eligible_d{n})", f"paid_retention_d{n}")
        for n in _HORIZONS)
    + " FROM m_retention_base GROUP BY 1, 2, 3, 4",
    "m_channels": f"""
SELECT acquisition_channel, count(*) AS marketing_period_count, sum(marketing_spend_gbp) AS marketing_spend_gbp,
  {_sum("impressions", "clicks", "installation_count", "installations_with_signup")},
  {_rate("sum(clicks)", "sum(impressions)", "click_through_rate")}, {_rate("sum(marketing_spend_gbp)", "sum(clicks)", "cost_per_click_gbp")},
  {_rate("sum(marketing_spend_gbp)", "sum(installation_count)", "cost_per_install_gbp")},
  {_rate("sum(installations_with_signup)", "sum(installation_count)", "install_to_signup_rate")}
FROM m_weekly GROUP BY 1""",
    "m_share": """
SELECT feature_name, count(*) AS feature_use_event_count,
  CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS feature_use_event_share
FROM product_events WHERE feature_name IS NOT NULL AND event_name = 'feature_used' GROUP BY 1""",
}


def _install_totals(*by: str) -> str:
    keys = "".join(f"{b}, " for b in by)
    return (f"SELECT {keys}count(*) AS installation_count, count(*) FILTER (WHERE has_signup) AS installations_with_signup, "
            f"{_rate('count(*) FILTER (WHERE has_signup)', 'count(*)', 'install_to_signup_rate')} FROM m_lifecycle"
            + (" GROUP BY " + ", ".join(by) if by else ""))


_SIGNUP_TOTALS = f"""count(*) AS registered_user_count, count(u.onboarding_started_at) AS onboarding_started_user_count,
  count(u.onboarding_completed_at) AS onboarding_completed_user_count,
  {_rate("count(u.onboarding_started_at)", "count(*)", "onboarding_start_rate")},
  {_rate("count(u.onboarding_completed_at)", "count(*)", "onboarding_completion_rate")}"""


def _monthly(*names: str) -> str:
    return f"SELECT CAST(date_trunc('month', full_date) AS DATE) AS month_start, {_sum(*names)} FROM m_daily GROUP BY 1"


def _revenue(key: str, extra: str = "", paid: bool = True) -> str:
    group = " GROUP BY 1" if key else ""
    first = f"{key} AS month_start, " if key else ""
    counts = ["payment_attempt_count", "failed_payment_count", "renewal_attempt_count", "successful_renewal_count"]
    counts += ["successful_payment_count"] if paid else []
    money = "CAST(sum(CAST(successful_payment_revenue_gbp AS DECIMAL(28,2))) AS DOUBLE) AS successful_payment_revenue_gbp"
    return (f"SELECT {first}{_sum(*counts)}, {money}, {extra}{_rate('sum(failed_payment_count)', 'sum(payment_attempt_count)', 'payment_failure_rate')}, "
            f"{_rate('sum(successful_renewal_count)', 'sum(renewal_attempt_count)', 'renewal_success_rate')} FROM m_revenue{group}")


def _retention(key: str = "", retained: bool = True) -> str:
    parts = []
    for n in _HORIZONS:
        parts.append(f"count(*) FILTER (WHERE eligible_d{n}) AS mature_d{n}_count")
        if retained:
            parts.append(f"count(*) FILTER (WHERE retained_d{n}) AS retained_d{n}_count")
        parts.append(_rate(f"count(*) FILTER (WHERE retained_d{n})", f"count(*) FILTER (WHERE eligible_d{n})", f"paid_retention_d{n}"))
    return f"SELECT {key + ', ' if key else ''}count(*) AS paid_subscription_count, {', '.join(parts)} FROM m_retention_base" + (
        f" GROUP BY {key}" if key else "")


def _trials(key: str = "") -> str:
    return (f"SELECT {key + ', ' if key else ''}{_sum('trial_count', 'mature_trial_count', 'immature_trial_count', 'mature_trial_paid_conversion_count')}, "
            f"{_rate('sum(mature_trial_paid_conversion_count)', 'sum(mature_trial_count)', 'trial_to_paid_conversion_rate')} FROM m_trials"
            + (f" GROUP BY {key}" if key else ""))


def _leader(label: str, table: str, name: str, value: str, best: str = "DESC", cond: str = "") -> str:
    return (f"SELECT * FROM (SELECT '{label}' AS highlight, {name} AS leader, CAST({value} AS DOUBLE) AS value FROM {table} "
            f"WHERE {value} IS NOT NULL {cond} ORDER BY {value} {best}, {name} {best} LIMIT 1)")


BODIES: dict[str, str] = {
    "trial_conversion_cohorts": "SELECT * FROM m_trials",
    "observation_cutoff": "SELECT * FROM ev_cutoff",
    "installation_lifecycle": "SELECT * FROM m_lifecycle",
    "daily_product_kpis": "SELECT * FROM m_daily",
    "daily_subscription_revenue": "SELECT * FROM m_revenue",
    "installation_cohort_funnel": "SELECT * FROM m_installs",
    "signup_cohort_funnel": "SELECT * FROM m_signups",
    "weekly_acquisition_performance": "SELECT * FROM m_weekly",
    "daily_feature_engagement": "SELECT * FROM m_features",
    "paid_retention_base": "SELECT * FROM m_retention_base",
    "paid_retention_cohorts": "SELECT * FROM m_retention",
    "trial_prediction_base": "SELECT * FROM m_prediction",
    "metric_registry_upsert": """
SELECT concat('activity_', CAST(k AS VARCHAR)) AS metric_key, definition, revision FROM (
  SELECT k, definition, revision, row_number() OVER (PARTITION BY k ORDER BY revision DESC) AS rn FROM (
    SELECT installation_id AS k, 'app_install' AS definition, CAST(-1 AS BIGINT) AS revision FROM installations
    UNION ALL SELECT user_id, event_type, event_id FROM events)) WHERE rn = 1""",
    "monthly_growth": _monthly("installation_count", "signup_count", "paywall_view_count", "trial_start_count", "paid_subscription_start_count"),
    "funnel_summary": f"SELECT * FROM ({_install_totals()}) CROSS JOIN (SELECT {_SIGNUP_TOTALS} FROM users u)",
    "channel_performance": "SELECT * FROM m_channels",
    "platform_funnel": _install_totals("platform"),
    "country_funnel": _install_totals("country_code"),
    "period_comparison": " UNION ALL ".join(
        f"SELECT '{m}' AS measure, b AS baseline, c AS comparison, CAST(c - b AS DOUBLE) / nullif(CAST(b AS DOUBLE), 0) * 100.0 AS percent_change FROM ("
        f"SELECT CAST(coalesce(sum({m}) FILTER (WHERE year(full_date) = 2023), 0) AS BIGINT) AS b, "
        f"CAST(coalesce(sum({m}) FILTER (WHERE year(full_date) = 2024), 0) AS BIGINT) AS c FROM m_daily WHERE month(full_date) IN (1, 2, 12))"
        for m in ("installation_count", "signup_count", "trial_start_count", "paid_subscription_start_count")),
    "channel_highlights": " UNION ALL ".join([
        _leader("highest_install_volume", "m_channels", "acquisition_channel", "installation_count"),
        _leader("highest_signup_conversion", "m_channels", "acquisition_channel", "install_to_signup_rate"),
        _leader("lowest_cost_per_install", "m_channels", "acquisition_channel", "cost_per_install_gbp", "ASC", "AND cost_per_install_gbp > 0"),
        _leader("highest_marketing_spend", "m_channels", "acquisition_channel", "marketing_spend_gbp")]),
    "monthly_engagement": f"""SELECT CAST(date_trunc('month', full_date) AS DATE) AS month_start, avg(registered_dau) AS average_registered_dau,
  max(registered_dau) AS peak_registered_dau, {_sum("session_count", "feature_use_event_count", "paywall_view_count", "trial_start_count", "paid_subscription_start_count")}
FROM m_daily GROUP BY 1""",
    "feature_share": "SELECT * FROM m_share",
    "top_feature": _leader("top_feature", "m_share", "feature_name", "feature_use_event_count"),
    "revenue_summary": _revenue("", "CAST(sum(failed_renewal_count) AS BIGINT) AS failed_renewal_count, "
                                "CAST(sum(CAST(renewal_revenue_gbp AS DECIMAL(28,2))) AS DOUBLE) AS renewal_revenue_gbp, "),
    "monthly_revenue": _revenue("CAST(date_trunc('month', full_date) AS DATE)"),
    "trial_conversion_summary": _trials(),
    "retention_summary": _retention(),
    "retention_by_billing": _retention("billing_period"),
    "retention_by_channel": _retention("acquisition_channel"),
    "business_leaders": " UNION ALL ".join([
        _leader("best_signup_channel", "m_channels", "acquisition_channel", "install_to_signup_rate"),
        _leader("lowest_positive_cpi", "m_channels", "acquisition_channel", "cost_per_install_gbp", "ASC", "AND cost_per_install_gbp > 0"),
        _leader("best_d365_channel", f"({_retention('acquisition_channel')})", "acquisition_channel", "paid_retention_d365"),
        _leader("top_feature", "m_share", "feature_name", "feature_use_event_count")]),
    "overview_product": f"SELECT {_sum('installation_count', 'signup_count', 'session_count', 'feature_use_event_count', 'trial_start_count', 'paid_subscription_start_count')} FROM m_daily",
    "overview_funnel": f"""SELECT * FROM ({_install_totals()}) CROSS JOIN (SELECT {_SIGNUP_TOTALS} FROM users u)
CROSS JOIN (SELECT mature_trial_count, mature_trial_paid_conversion_count, trial_to_paid_conversion_rate FROM ({_trials()}))""",
    "overview_revenue": _revenue(""),
    "app_channel": "SELECT * EXCLUDE (marketing_period_count) REPLACE (coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks) FROM m_channels",
    "app_platform_funnel": f"""SELECT * FROM ({_install_totals('platform')}) JOIN (
  SELECT i.platform, {_SIGNUP_TOTALS} FROM users u JOIN installations i ON i.installation_id = u.installation_id GROUP BY 1) USING (platform)""",
    "app_feature_summary": """SELECT feature_name, CAST(sum(feature_use_event_count) AS BIGINT) AS feature_use_event_count,
  CAST(sum(feature_installation_count) AS BIGINT) AS feature_installation_count_days, CAST(sum(feature_user_count) AS BIGINT) AS feature_user_days,
  CAST(sum(feature_session_count) AS BIGINT) AS feature_session_count,
  CAST(sum(feature_use_event_count) AS DOUBLE) / CAST(sum(sum(feature_use_event_count)) OVER () AS DOUBLE) AS feature_use_share
FROM m_features GROUP BY 1""",
    "app_retention_summary": _retention(),
    "app_monthly_product": _monthly("installation_count", "signup_count", "session_count", "feature_use_event_count", "trial_start_count", "paid_subscription_start_count"),
    "app_monthly_engagement": _monthly("session_count", "feature_use_event_count", "paywall_view_count", "trial_start_count"),
    "app_monthly_revenue": _revenue("CAST(date_trunc('month', full_date) AS DATE)", paid=False),
    "app_trial_channel": _trials("acquisition_channel"),
    "app_retention_channel": _retention("acquisition_channel", retained=False),
    "retention_curve": " UNION ALL ".join(
        f"SELECT {n} AS horizon_days, count(*) FILTER (WHERE eligible_d{n}) AS eligible_count, count(*) FILTER (WHERE retained_d{n}) AS retained_count, "
        f"{_rate(f'count(*) FILTER (WHERE retained_d{n})', f'count(*) FILTER (WHERE eligible_d{n})', 'retention_rate')} FROM m_retention_base"
        for n in _HORIZONS),
    "reporting_context": """SELECT k AS analytics_build_run_id, k AS ingestion_batch_id, m AS observation_cutoff_at FROM (
  SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS k, max(ts) AS m FROM events GROUP BY 1) ORDER BY k DESC LIMIT 1""",
}
