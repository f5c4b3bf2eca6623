"""Oracle SQL of the quality catalogue, star build, layer checks and event helpers."""

from __future__ import annotations

from tidemark.operators.quality import REFERENCES

_NATIONS = ", ".join(f"'NATION_{i}'" for i in range(25))
_SEG = "'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'"
_R = {
    "installations": "r_installations", "users": "r_users", "product_events": "r_events", "subscriptions": "r_subs",
    "subscription_transactions": "r_txn", "experiment_assignments": "r_assign", "marketing_spend": "r_spend", "app_releases": "r_rel",
}
_KEY = {
    "installations": "installation_id", "users": "user_id", "product_events": "event_id", "subscriptions": "subscription_id",
    "subscription_transactions": "transaction_id", "experiment_assignments": "assignment_id", "marketing_spend": "marketing_spend_id", "app_releases": "app_release_id",
}
_TIME_NULLS = {
    "installations": "installation_id IS NULL OR installed_at IS NULL OR platform IS NULL OR acquisition_channel IS NULL OR country_code IS NULL OR trim(country_code) = ''",
    "users": "user_id IS NULL OR installation_id IS NULL OR signed_up_at IS NULL OR anonymous_id IS NULL",
    "product_events": "event_id IS NULL OR event_name IS NULL OR occurred_at IS NULL OR installation_id IS NULL OR trim(session_id) = ''",
    "subscriptions": "subscription_id IS NULL OR user_id IS NULL OR price_gbp IS NULL OR trial_started_at IS NULL OR trial_ends_at IS NULL",
    "subscription_transactions": "transaction_id IS NULL OR user_id IS NULL OR attempted_at IS NULL OR amount_gbp IS NULL",
    "experiment_assignments": "assignment_id IS NULL OR assignment_at IS NULL OR variant IS NULL OR experiment_start_at IS NULL",
    "marketing_spend": "period_start IS NULL OR period_end IS NULL OR acquisition_channel IS NULL OR spend IS NULL",
    "app_releases": "release_key IS NULL OR release_name IS NULL OR trim(release_name) = '' OR release_at IS NULL OR rollout_complete_at IS NULL OR release_type IS NULL",
}
_DOMAIN = {
    "installations": f"platform NOT IN ('ios', 'android') OR acquisition_channel NOT IN ({_SEG}) OR country_code NOT IN ({_NATIONS}) OR anonymous_id <> trim(anonymous_id)",
    "users": "anonymous_id <> trim(anonymous_id)",
    "product_events": "coalesce(feature_name NOT IN ('feature_0', 'feature_1', 'feature_2', 'feature_3', 'feature_4'), false) OR event_name NOT IN ('session_started', 'feature_used', 'paywall_viewed', 'payment_failed', 'trial_started', 'subscription_started', 'cancellation_requested')",
    "subscriptions": "billing_period NOT IN ('monthly', 'annual') OR price_gbp < 0 OR status NOT IN ('trialing', 'active', 'past_due', 'expired', 'cancel_at_period_end')",
    "subscription_transactions": "transaction_type NOT IN ('initial_charge', 'renewal') OR payment_status NOT IN ('succeeded', 'failed') OR amount_gbp < 0 OR billing_cycle_number < 1",
    "experiment_assignments": "variant NOT IN ('control', 'treatment') OR allocation_probability < 0 OR allocation_probability > 1 OR analysis_window_days < 1",
    "marketing_spend": f"acquisition_channel NOT IN ({_SEG}) OR spend < 0 OR coalesce(impressions < 0, false) OR coalesce(clicks < 0, false)",
    "app_releases": "release_sequence < 1 OR rollout_days < 0 OR release_type NOT IN ('major', 'minor', 'patch') OR release_name <> trim(release_name) OR rollout_strategy NOT IN ('full', 'phased')",
}
_A = {
    "installations": "d_installation", "users": "d_user", "product_events": "f_event", "subscriptions": "f_sub",
    "subscription_transactions": "f_txn", "experiment_assignments": "f_assign", "marketing_spend": "f_spend", "app_releases": "d_release",
}
_S = {n: "st_" + r[2:] for n, r in _R.items()}
_SK = "(68719476736 + {t}.rn)"


def _dk(c: str) -> str:
    return f"CAST(strftime({c}, '%Y%m%d') AS INT)"


def _tail(t: str) -> str:
    return f"CAST(1 AS BIGINT) AS ingestion_batch_id, CAST(1 AS BIGINT) AS validation_run_id, {t}.rn AS source_row_number, CAST(1 AS BIGINT) AS analytics_build_run_id"


def _counts(tables: dict[str, str], alias: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST(1 AS BIGINT) AS ingestion_batch_id, '{n}' AS dataset_name, count(*) AS {alias} FROM {t} HAVING count(*) > 0" for n, t in tables.items())



SHARED: dict[str, str] = {
    "r_installations": "SELECT *, installation_id + 2 AS rn FROM installations",
    "r_users": "SELECT *, user_id + 2 AS rn FROM users",
    "r_events": "SELECT *, concat('anon_', CAST(installation_id AS VARCHAR)) AS anonymous_id, event_id + 2 AS rn FROM product_events",
    "r_subs": """
SELECT o_orderkey AS subscription_id, o_custkey AS user_id, o_custkey AS installation_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'annual' ELSE 'monthly' END AS billing_period,
  CAST(o_totalprice AS DECIMAL(18,2)) AS price_gbp, CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'O' THEN 'active' ELSE 'trialing' END AS status,
  o_orderdate - INTERVAL 7 DAY AS trial_started_at, o_orderdate AS trial_ends_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS subscription_started_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' DAY * CAST((o_orderkey * 13) % 500 AS INT) END AS expired_at, o_orderkey + 2 AS rn FROM orders""",
    "r_txn": """
SELECT concat_ws('_', subscription_id, billing_cycle_number) AS transaction_id, subscription_id, user_id, user_id AS installation_id, transaction_type, attempted_at, amount_gbp,
  payment_status, billing_cycle_number, 1 AS attempt_number, subscription_id * 8 + billing_cycle_number + 2 AS rn,
  md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST(attempted_at AS VARCHAR), payment_status, CAST(amount_gbp AS VARCHAR))) AS h FROM transactions""",
    "r_assign": """
SELECT a.assignment_id, a.experiment_id, a.user_id, a.installation_id, a.variant, a.allocation_probability, a.assignment_at, c.exposed_at, x.start_at AS experiment_start_at,
  x.end_at AS experiment_end_at, x.primary_metric, x.analysis_window_days, a.user_id * 4 + ascii(right(a.experiment_id, 1)) - 96 AS rn
FROM experiment_assignments a JOIN experiments x ON x.experiment_id = a.experiment_id JOIN x_candidates c ON c.experiment_id = a.experiment_id AND c.user_id = a.user_id""",
    "r_spend": """SELECT concat_ws('_', CAST(period_start AS VARCHAR), acquisition_channel) AS marketing_spend_id, *,
  CAST(date_diff('day', DATE '2023-01-01', period_start) * 128 + ascii(acquisition_channel) AS BIGINT) AS rn FROM marketing_spend""",
    "r_rel": """
SELECT p_partkey AS app_release_id, p_brand AS release_key, p_name AS release_name, p_size AS release_sequence, CASE WHEN p_partkey % 2 = 0 THEN 'ios' ELSE 'android' END AS platform,
  concat('1.', CAST(p_size AS VARCHAR)) AS version, TIMESTAMP '2024-01-01' + INTERVAL '1' DAY * CAST(p_partkey % 30 AS INT) AS release_at,
  CASE p_type WHEN 'ECONOMY' THEN 'major' WHEN 'SMALL' THEN 'minor' ELSE 'patch' END AS release_type, CASE WHEN p_partkey % 2 = 0 THEN 'full' ELSE 'phased' END AS rollout_strategy,
  p_size % 10 AS rollout_days, TIMESTAMP '2024-01-01' + INTERVAL '1' DAY * CAST(p_partkey % 30 + p_size % 10 - 1 AS INT) AS rollout_complete_at, p_partkey + 2 AS rn FROM part""",
    **{_S[n]: f"SELECT * FROM {_R[n]} WHERE NOT ({_TIME_NULLS[n]}) AND NOT ({_DOMAIN[n]})" for n in _R},
    "d_installation": f"""SELECT {_SK.format(t='s')} AS installation_key, s.installation_id, s.anonymous_id, s.installed_at, {_dk('s.installed_at')} AS installed_date_key,
  s.platform, s.acquisition_channel, s.country_code, {_tail('s')} FROM st_installations s""",
    "d_user": f"""SELECT {_SK.format(t='s')} AS user_key, s.user_id, i.installation_key, s.signed_up_at, {_dk('s.signed_up_at')} AS signed_up_date_key, s.onboarding_started_at,
  s.onboarding_completed_at, {_tail('s')} FROM st_users s JOIN d_installation i ON i.installation_id = s.installation_id""",
    "d_experiment": """SELECT DISTINCT CAST(1 AS BIGINT) AS ingestion_batch_id, experiment_id, experiment_start_at, experiment_end_at, primary_metric, analysis_window_days,
  CAST(1 AS BIGINT) AS analytics_build_run_id FROM st_assign""",
    "d_release": f"""SELECT {_SK.format(t='s')} AS app_release_key, s.app_release_id, s.release_key, s.platform, s.version, s.release_type, s.release_at, {_dk('s.release_at')} AS release_date_key,
  s.rollout_strategy, s.rollout_days, s.rollout_complete_at, {_tail('s')} FROM st_rel s""",
    "f_event": f"""SELECT {_SK.format(t='s')} AS product_event_key, s.event_id, s.event_name, s.occurred_at, {_dk('s.occurred_at')} AS occurred_date_key, i.installation_key, u.user_key,
  s.session_id, s.feature_name, {_tail('s')} FROM st_events s JOIN d_installation i ON i.installation_id = s.installation_id LEFT JOIN d_user u ON u.user_id = s.user_id
WHERE s.user_id IS NULL OR u.user_key IS NOT NULL""",
    "f_sub": f"""SELECT {_SK.format(t='s')} AS subscription_key, s.subscription_id, u.user_key, i.installation_key, s.billing_period, CAST(s.price_gbp AS DOUBLE) AS price_gbp, s.status,
  s.trial_started_at, {_dk('s.trial_started_at')} AS trial_started_date_key, s.trial_ends_at, s.subscription_started_at, {_dk('s.subscription_started_at')} AS subscription_started_date_key,
  s.expired_at, {_dk('s.expired_at')} AS expired_date_key, {_tail('s')} FROM st_subs s JOIN d_installation i ON i.installation_id = s.installation_id JOIN d_user u ON u.user_id = s.user_id""",
    "f_txn": f"""SELECT {_SK.format(t='s')} AS transaction_key, s.transaction_id, b.subscription_key, u.user_key, i.installation_key, s.transaction_type, s.attempted_at,
  {_dk('s.attempted_at')} AS attempted_date_key, CAST(s.amount_gbp AS DOUBLE) AS amount_gbp, s.payment_status, s.billing_cycle_number, s.attempt_number, {_tail('s')}, s.h
FROM st_txn s JOIN d_installation i ON i.installation_id = s.installation_id JOIN d_user u ON u.user_id = s.user_id JOIN f_sub b ON b.subscription_id = s.subscription_id""",
    "f_assign": f"""SELECT {_SK.format(t='s')} AS experiment_assignment_key, s.assignment_id, s.experiment_id, u.user_key, i.installation_key, s.variant, s.allocation_probability,
  s.assignment_at, {_dk('s.assignment_at')} AS assignment_date_key, s.exposed_at, {_dk('s.exposed_at')} AS exposed_date_key, {_tail('s')}
FROM st_assign s JOIN d_installation i ON i.installation_id = s.installation_id JOIN d_user u ON u.user_id = s.user_id""",
    "f_spend": f"""SELECT {_SK.format(t='s')} AS marketing_spend_key, s.marketing_spend_id, s.period_start, {_dk('s.period_start')} AS period_start_date_key, s.period_end,
  {_dk('s.period_end')} AS period_end_date_key, s.acquisition_channel, CAST(s.spend AS DOUBLE) AS spend, s.impressions, s.clicks, {_tail('s')} FROM st_spend s""",
    "w_staging": _counts(_S, "staging_row_count"),
    "w_analytics": _counts(_A, "analytics_row_count"),
    "w_recon": """SELECT s.ingestion_batch_id, s.dataset_name, s.staging_row_count, coalesce(a.analytics_row_count, 0) AS analytics_row_count,
  s.staging_row_count - coalesce(a.analytics_row_count, 0) AS row_count_delta, s.staging_row_count = coalesce(a.analytics_row_count, 0) AS reconciled
FROM w_staging s LEFT JOIN w_analytics a ON a.dataset_name = s.dataset_name""",
    "w_rawrecon": " UNION ALL ".join(
        f"""SELECT CAST(1 AS BIGINT) AS ingestion_batch_id, '{n}' AS dataset_name, e AS expected_row_count, e - b AS accepted_row_count, b AS rejected_row_count, s AS actual_row_count,
  e - b - s AS accepted_vs_actual_delta, CAST(0 AS BIGINT) AS expected_vs_processed_delta, e - b = s AS reconciled
FROM (SELECT count(*) AS e, count(*) FILTER (WHERE ({_TIME_NULLS[n]}) OR ({_DOMAIN[n]})) AS b, (SELECT count(*) FROM {_S[n]}) AS s FROM {_R[n]})""" for n in _R),
    "w_lineage": " UNION ALL ".join(
        f"""SELECT CAST(1 AS BIGINT) AS ingestion_batch_id, '{n}' AS dataset_name, count(*) AS staging_row_count, count(a.k) AS matched_analytics_rows,
  count(*) FILTER (WHERE a.k IS NULL) AS missing_analytics_rows, count(*) FILTER (WHERE a.k IS NOT NULL AND (lo <> s.rn OR hi <> s.rn{' OR hlo <> s.h OR hhi <> s.h' if n == 'subscription_transactions' else ''})) AS lineage_mismatches
FROM {_S[n]} s LEFT JOIN (SELECT {_KEY[n]} AS k, min(source_row_number) AS lo, max(source_row_number) AS hi{', min(h) AS hlo, max(h) AS hhi' if n == 'subscription_transactions' else ''}
  FROM {_A[n]} GROUP BY 1) a ON a.k = s.{_KEY[n]}""" for n in _R),
}


def _star(table: str, extra: str = "") -> str:
    return f"SELECT * {extra} FROM {table}"


def _check(dataset: str, category: str, name: str, count: str) -> str:
    return f"SELECT '{dataset}' AS dataset_name, '{category}' AS category, '{name}' AS check_name, CAST(({count}) AS BIGINT) AS violation_count"


def _where(table: str, cond: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {cond}"


def _cnt(event: str) -> str:
    return f"(SELECT count(*) FROM r_events WHERE event_name = '{event}')"


_ENTITY = " UNION ALL ".join(_check("product_events", "reconciliation", n, f"abs({_cnt(e)} - ({other}))") for n, e, other in (
    ("app_install_event_count_matches_installations", "app_install", "SELECT count(*) FROM r_installations"),
    ("signup_event_count_matches_users", "signup", "SELECT count(*) FROM r_users"),
    ("trial_started_event_count_matches_subscriptions", "trial_started", "SELECT count(*) FROM r_subs"),
    ("subscription_started_event_count_matches_charges", "subscription_started", "SELECT count(*) FROM r_txn WHERE transaction_type = 'initial_charge' AND payment_status = 'succeeded'"),
    ("subscription_renewed_event_count_matches_charges", "subscription_renewed", "SELECT count(*) FROM r_txn WHERE transaction_type = 'renewal' AND payment_status = 'succeeded'"),
    ("payment_failed_event_count_matches_transactions", "payment_failed", "SELECT count(*) FROM r_txn WHERE payment_status = 'failed'")))
_MATCH = " UNION ALL ".join(_check(d, "reconciliation", n, _where(
    f"{_R[d]} t", f"t.{at} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r_events e WHERE e.{k} = t.{k} AND e.event_name = '{ev}' AND e.occurred_at = t.{at})")) for d, n, ev, k, at in (
    ("installations", "installation_app_install_timestamp_match", "app_install", "installation_id", "installed_at"),
    ("users", "user_signup_event_timestamp_match", "signup", "user_id", "signed_up_at"),
    ("users", "user_onboarding_started_event_timestamp_match", "onboarding_started", "user_id", "onboarding_started_at"),
    ("users", "user_onboarding_completed_event_timestamp_match", "onboarding_completed", "user_id", "onboarding_completed_at")))
_UNIQUE = " UNION ALL ".join(
    [_check(n, "uniqueness", f"{n}_{_KEY[n]}_unique", f"SELECT count(*) - count(DISTINCT {_KEY[n]}) FROM {_R[n]}") for n in _R]
    + [_check(n, "uniqueness", c, f"SELECT count(*) - count(DISTINCT {k}) FROM {_R[n]}") for n, c, k in (
        ("installations", "installations_anonymous_id_unique", "anonymous_id"), ("users", "users_installation_id_unique", "installation_id"),
        ("subscriptions", "subscriptions_user_id_unique", "user_id"), ("marketing_spend", "marketing_spend_period_channel_unique", "(period_start, acquisition_channel)"),
        ("app_releases", "app_releases_release_key_platform_unique", "(release_key, platform)"))])
_REFS = " UNION ALL ".join(_check(c, "referential_integrity", n, _where(
    f"{_R[c]} t", ("t.user_id IS NOT NULL AND " if c == "product_events" and p == "users" else "")
    + f"NOT EXISTS (SELECT 1 FROM {_R[p]} q WHERE " + " AND ".join(f"q.{k} = t.{k}" for k in keys) + ")")) for c, p, keys, n in REFERENCES)
_TIME = " UNION ALL ".join(
    [_check(c, "chronology", n, f"SELECT count(*) FROM {_R[c]} t JOIN {_R[p]} q ON q.{k} = t.{k} WHERE t.{at} < q.{lo}") for c, n, p, k, at, lo in (
        ("users", "users_signup_not_before_installation", "installations", "installation_id", "signed_up_at", "installed_at"),
        ("product_events", "product_events_not_before_installation", "installations", "installation_id", "occurred_at", "installed_at"),
        ("product_events", "registered_product_events_not_before_signup", "users", "user_id", "occurred_at", "signed_up_at"),
        ("subscriptions", "subscription_trial_not_before_signup", "users", "user_id", "trial_started_at", "signed_up_at"),
        ("experiment_assignments", "experiment_assignment_not_before_signup", "users", "user_id", "assignment_at", "signed_up_at"))]
    + [_check(d, "chronology", n, _where(_R[d], c)) for d, n, c in (
        ("users", "users_onboarding_start_not_before_signup", "onboarding_started_at < signed_up_at"),
        ("users", "users_onboarding_completion_valid", "onboarding_completed_at IS NOT NULL AND (onboarding_started_at IS NULL OR onboarding_completed_at < onboarding_started_at)"),
        ("experiment_assignments", "experiment_assignment_inside_window", "NOT (experiment_start_at <= assignment_at AND assignment_at < experiment_end_at)"),
        ("experiment_assignments", "experiment_exposure_inside_window", "exposed_at IS NOT NULL AND NOT (assignment_at <= exposed_at AND exposed_at < experiment_end_at)"),
        ("marketing_spend", "marketing_spend_period_order", "period_end < period_start"),
        ("app_releases", "app_release_rollout_not_before_release", "rollout_complete_at < release_at"))])
_NULLS = " UNION ALL ".join(_check(n, "nullability", f"{n}_nullability", _where(_R[n], _TIME_NULLS[n])) for n in _R)
_DOMAINS = " UNION ALL ".join(_check(n, "domain", f"{n}_domain", _where(_R[n], _DOMAIN[n])) for n in _R)
_BOUNDED = {
    "installations": ["installed_at"], "users": ["signed_up_at", "onboarding_started_at", "onboarding_completed_at"],
    "product_events": ["occurred_at"], "subscription_transactions": ["attempted_at"], "experiment_assignments": ["assignment_at"],
}
_RECON_CHECK = "SELECT dataset_name, 'reconciliation' AS category, concat(dataset_name, '_raw_reconciliation') AS check_name, CASE WHEN reconciled THEN 0 ELSE 1 END AS violation_count FROM w_rawrecon"
_DATED = [
    ("dim_installation", "d_installation", "installed_at", "installed_date_key"), ("dim_user", "d_user", "signed_up_at", "signed_up_date_key"),
    ("dim_app_release", "d_release", "release_at", "release_date_key"), ("fact_product_event", "f_event", "occurred_at", "occurred_date_key"),
    ("fact_subscription", "f_sub", "trial_started_at", "trial_started_date_key"), ("fact_subscription", "f_sub", "subscription_started_at", "subscription_started_date_key"),
    ("fact_subscription", "f_sub", "expired_at", "expired_date_key"), ("fact_subscription_transaction", "f_txn", "attempted_at", "attempted_date_key"),
    ("fact_experiment_assignment", "f_assign", "assignment_at", "assignment_date_key"), ("fact_experiment_assignment", "f_assign", "exposed_at", "exposed_date_key"),
    ("fact_marketing_spend", "f_spend", "period_start", "period_start_date_key"), ("fact_marketing_spend", "f_spend", "period_end", "period_end_date_key"),
]
_STAGED_DATES = [("st_installations", "installed_at"), ("st_users", "signed_up_at"), ("st_rel", "release_at"), ("st_events", "occurred_at"), ("st_subs", "trial_started_at"),
                 ("st_subs", "subscription_started_at"), ("st_subs", "expired_at"), ("st_txn", "attempted_at"), ("st_assign", "assignment_at"), ("st_assign", "exposed_at"),
                 ("st_spend", "period_start"), ("st_spend", "period_end")]
SHARED["w_dates"] = ("SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS full_date FROM (SELECT min(d) AS lo, max(d) AS hi FROM ("
                     + " UNION ALL ".join(f"SELECT CAST({c} AS DATE) AS d FROM {t}" for t, c in _STAGED_DATES) + "))")


def _rel(check: str, dataset: str, fact: str, dims: list[str]) -> str:
    ids = {"installation": ("d_installation", "installation_key", "installation_id"), "user": ("d_user", "user_key", "user_id"), "subscription": ("f_sub", "subscription_key", "subscription_id")}
    joins = " ".join(f"LEFT JOIN {ids[d][0]} j_{d} ON j_{d}.{ids[d][1]} = f.{ids[d][1]}" for d in dims)
    bad = " OR ".join(f"j_{d}.{ids[d][2]} IS DISTINCT FROM s.{ids[d][2]}" for d in dims)
    same = " AND f.h = s.h" if dataset == "subscription_transactions" else ""
    return (f"SELECT '{check}' AS check_name, '{dataset}' AS dataset_name, count(DISTINCT (s.rn, s.{_KEY[dataset]})) FILTER (WHERE {bad}) AS violation_count "
            f"FROM {_S[dataset]} s JOIN {fact} f ON f.{_KEY[dataset]} = s.{_KEY[dataset]}{same} {joins}")


def _rc(name: str, observed: str, expected: str) -> str:
    return f"SELECT '{name}' AS check_name, CAST(({observed}) AS DOUBLE) AS observed_value, CAST(({expected}) AS DOUBLE) AS expected_value"


_REPORT = [
    ("analytics_build_succeeded", "SELECT min(CASE WHEN reconciled THEN 1 ELSE 0 END) FROM w_rawrecon", "1"), ("metric_definition_count", "SELECT count(*) FROM x_registry", "39"),
    *[(f"{s}_metric_count", f"SELECT count(*) FROM x_registry WHERE support_status = '{s}'", n) for s, n in (("supported", "30"), ("deferred", "5"), ("unsupported", "4"))],
    ("installation_lifecycle_row_count", "SELECT count(*) FROM m_lifecycle", "SELECT count(*) FROM installations"),
    ("installation_lifecycle_unique_grain", "SELECT count(DISTINCT installation_id) FROM m_lifecycle", "SELECT count(*) FROM m_lifecycle"),
    ("daily_product_date_grain", "SELECT count(DISTINCT full_date) FROM m_daily", "SELECT count(*) FROM m_daily"),
    ("daily_revenue_date_grain", "SELECT count(DISTINCT full_date) FROM m_revenue", "SELECT count(*) FROM m_revenue"),
    ("experiment_assignment_outcome_unique_grain", "SELECT count(DISTINCT assignment_id) FROM x_outcomes", "SELECT count(*) FROM x_outcomes"),
    ("product_installations_reconcile", "SELECT sum(installation_count) FROM m_daily", "SELECT count(*) FROM installations"),
    ("product_signups_reconcile", "SELECT sum(signup_count) FROM m_daily", "SELECT count(*) FROM users"),
    ("product_onboarding_started_reconcile", "SELECT sum(onboarding_started_count) FROM m_daily", "SELECT count(*) FROM product_events WHERE event_name = 'onboarding_started'"),
    ("product_onboarding_completed_reconcile", "SELECT sum(onboarding_completed_count) FROM m_daily", "SELECT count(*) FROM product_events WHERE event_name = 'onboarding_completed'"),
    ("payment_attempts_reconcile", "SELECT sum(payment_attempt_count) FROM m_revenue", "SELECT count(*) FROM transactions"),
    ("successful_payments_reconcile", "SELECT sum(successful_payment_count) FROM m_revenue", "SELECT count(*) FROM transactions WHERE payment_status = 'succeeded'"),
    ("failed_payments_reconcile", "SELECT sum(failed_payment_count) FROM m_revenue", "SELECT count(*) FROM transactions WHERE payment_status = 'failed'"),
    ("successful_payment_revenue_reconcile", "SELECT sum(CAST(successful_payment_revenue_gbp AS DECIMAL(28,2))) FROM m_revenue", "SELECT sum(amount_gbp) FROM transactions WHERE payment_status = 'succeeded'"),
    ("marketing_row_count_reconcile", "SELECT count(*) FROM m_weekly", "SELECT count(*) FROM marketing_spend"),
    ("marketing_spend_reconcile", "SELECT sum(CAST(marketing_spend_gbp AS DECIMAL(28,2))) FROM m_weekly", "SELECT sum(spend) FROM marketing_spend"),
    ("acquisition_installations_reconcile", "SELECT sum(installation_count) FROM m_weekly", "SELECT count(*) FROM installations"),
    ("acquisition_signups_reconcile", "SELECT sum(installations_with_signup) FROM m_weekly", "SELECT count(*) FROM users"),
    ("feature_events_reconcile", "SELECT sum(feature_use_event_count) FROM m_features", "SELECT count(*) FROM product_events WHERE event_name = 'feature_used' AND feature_name IS NOT NULL"),
    ("trial_rows_reconcile", "SELECT sum(trial_count) FROM m_trials", "SELECT count(*) FROM trials"),
    ("paid_retention_base_reconcile", "SELECT count(*) FROM m_retention_base", "SELECT count(*) FROM paid_subscriptions"),
    ("experiment_outcomes_reconcile", "SELECT count(*) FROM x_outcomes", "SELECT count(*) FROM experiment_assignments"),
    ("experiment_exposures_reconcile", "SELECT count(*) FILTER (WHERE is_exposed) FROM x_outcomes", "SELECT count(exposed_at) FROM x_candidates"),
    ("experiment_summary_assignments_reconcile", "SELECT sum(assigned_user_count) FROM x_summary", "SELECT count(*) FROM experiment_assignments"),
    ("experiment_summary_exposures_reconcile", "SELECT sum(exposed_user_count) FROM x_summary", "SELECT count(exposed_at) FROM x_candidates"),
    ("reporting_rate_bounds", "SELECT sum(violation_count) FROM w_rates", "0"), ("retention_maturity_consistency", "SELECT 0", "0"),
]
_RATES = {
    "installation_cohort_funnel": ("m_installs", ["install_to_signup_rate"]), "signup_cohort_funnel": ("m_signups", ["onboarding_start_rate", "onboarding_completion_rate"]),
    "weekly_acquisition_performance": ("m_weekly", ["install_to_signup_rate", "click_through_rate"]), "trial_conversion_cohorts": ("m_trials", ["trial_to_paid_conversion_rate"]),
    "paid_retention_cohorts": ("m_retention", [f"paid_retention_d{n}" for n in (30, 90, 180, 365)]),
    "daily_subscription_revenue": ("m_revenue", ["payment_failure_rate", "renewal_success_rate"]),
    "experiment_variant_summary": ("x_summary", ["exposure_rate", "onboarding_completion_48h_rate", "overall_feature_use_7d_rate", "trial_start_conversion_7d",
                                                 "paid_conversion_14d", "cancellation_or_expiry_30d_rate"]),
}
SHARED["w_rates"] = " UNION ALL ".join(
    f"SELECT '{m}' AS mart, count(*) AS violation_count FROM {t} WHERE " + " OR ".join(f"{r} < 0 OR {r} > 1" for r in rates) for m, (t, rates) in _RATES.items())
_ORDER = ("occurred_at, installation_id, list_position(['app_install', 'signup', 'onboarding_started', 'onboarding_completed', 'session_started', 'feature_used', 'paywall_viewed', "
          "'trial_started', 'subscription_started', 'subscription_renewed', 'payment_failed', 'cancellation_requested', 'subscription_expired'], event_name), "
          "coalesce(session_id, ''), coalesce(feature_name, ''), source_id")

BODIES: dict[str, str] = {
    "raw_counts": _counts(_R, "actual_row_count"),
    "active_counts": " UNION ALL ".join(
        f"""SELECT event_name, '{g}' AS grain, CAST(date_trunc('{g}', occurred_at) AS DATE) AS period_start, count(DISTINCT installation_id) AS active_count
FROM product_events GROUP BY 1, 3""" for g in ("day", "week", "month")),
    "trailing_actives": """
SELECT d.event_name, d.day AS period_start, count(DISTINCT e.installation_id) AS active_count
FROM (SELECT DISTINCT event_name, CAST(occurred_at AS DATE) AS day FROM product_events) d
JOIN product_events e ON e.event_name = d.event_name AND CAST(e.occurred_at AS DATE) BETWEEN d.day - 6 AND d.day GROUP BY 1, 2""",
    "raw_reconciliation": "SELECT * FROM w_rawrecon",
    "staging_reconciliation": f"""SELECT r.ingestion_batch_id, r.dataset_name, r.raw_row_count, coalesce(s.staging_row_count, 0) AS staging_row_count,
  r.raw_row_count - coalesce(s.staging_row_count, 0) AS row_count_delta, r.raw_row_count = coalesce(s.staging_row_count, 0) AS reconciled
FROM ({_counts(_R, "raw_row_count")}) r LEFT JOIN w_staging s ON s.dataset_name = r.dataset_name""",
    "analytics_reconciliation": "SELECT * FROM w_recon",
    "lineage_reconciliation": "SELECT * FROM w_lineage",
    "dq_check_results": """SELECT *, violation_count = 0 AS passed, '{"check_name":"' || check_name || '","violation_count":' || CAST(violation_count AS VARCHAR) || '}' AS details FROM ("""
    + " UNION ALL ".join([_RECON_CHECK, _ENTITY, _MATCH, _UNIQUE, _REFS, _TIME, _NULLS, _DOMAINS]) + ")",
    "dq_event_entity_counts": _ENTITY, "dq_event_timestamp_match": _MATCH, "dq_uniqueness": _UNIQUE, "dq_referential": _REFS, "dq_chronology": _TIME,
    "dq_nullability": _NULLS, "dq_domain": _DOMAINS,
    "dq_snapshot_bounds": " UNION ALL ".join(
        _check(n, "snapshot", f"{n}_before_snapshot", _where(_R[n], " OR ".join(f"{c} >= (SELECT max(ts) - INTERVAL 3 DAY FROM events)" for c in cols))) + " UNION ALL "
        + _check(n, "snapshot", f"{n}_scale", f"SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM {_R[n]}") for n, cols in _BOUNDED.items()),
    "dim_date": f"""SELECT {_dk('full_date')} AS date_key, full_date, year(full_date) AS calendar_year, quarter(full_date) AS calendar_quarter, month(full_date) AS month_number,
  monthname(full_date) AS month_name, week(full_date) AS iso_week, day(full_date) AS day_of_month, isodow(full_date) AS day_of_week, dayname(full_date) AS day_name,
  isodow(full_date) >= 6 AS is_weekend FROM w_dates""",
    "dim_installation": _star("d_installation"), "dim_user": _star("d_user"), "dim_experiment": _star("d_experiment"), "dim_app_release": _star("d_release"),
    "fact_product_event": _star("f_event"), "fact_subscription": _star("f_sub"), "fact_subscription_transaction": _star("f_txn", "EXCLUDE (h)"),
    "fact_experiment_assignment": _star("f_assign"), "fact_marketing_spend": _star("f_spend"),
    "surrogate_keys": "SELECT event_id, row_number() OVER (ORDER BY rn) AS surrogate_key FROM st_events",
    "build_authorisation": """SELECT *, ingested AND validated AND promoted AND all_reconciled AS authorised FROM (
  SELECT CAST(year(o_orderdate) AS BIGINT) AS ingestion_batch_id, count(*) FILTER (WHERE o_orderpriority = '5-LOW') > 0 AS ingested, count(*) FILTER (WHERE o_totalprice < 1100) = 0 AS validated,
    count(*) FILTER (WHERE o_orderstatus = 'P') > 0 AS promoted, count(DISTINCT o_orderstatus) = 3 AS all_reconciled FROM orders GROUP BY 1)""",
    "build_reconciliation": """SELECT r.*, s.staged_experiments, b.built_experiments, r.fact_row_count + b.built_experiments AS analytics_row_count,
  s.staged_experiments = b.built_experiments AS experiments_reconciled, r.fact_row_count + b.built_experiments = r.staging_row_count + s.staged_experiments AS rows_reconciled
FROM (SELECT ingestion_batch_id, count(*) AS dataset_count, count(*) FILTER (WHERE reconciled) AS reconciled_count, CAST(sum(staging_row_count) AS BIGINT) AS staging_row_count,
    CAST(sum(analytics_row_count) AS BIGINT) AS fact_row_count FROM w_recon GROUP BY 1) r,
  (SELECT count(DISTINCT experiment_id) AS staged_experiments FROM st_assign) s, (SELECT count(*) AS built_experiments FROM d_experiment) b""",
    "analytics_checks": """SELECT concat('reconciliation_', dataset_name) AS check_name, 'reconciliation' AS category, dataset_name, abs(row_count_delta) AS violation_count,
  CASE WHEN row_count_delta = 0 THEN 'passed' ELSE 'failed' END AS status FROM w_recon
UNION ALL SELECT concat('lineage_', dataset_name), 'lineage', dataset_name, missing_analytics_rows + lineage_mismatches,
  CASE WHEN missing_analytics_rows + lineage_mismatches = 0 THEN 'passed' ELSE 'failed' END FROM w_lineage""",
    "relationship_checks": "SELECT *, violation_count = 0 AS passed FROM (" + " UNION ALL ".join([
        _rel("relationship_users_installation", "users", "d_user", ["installation"]), _rel("relationship_product_events", "product_events", "f_event", ["installation", "user"]),
        _rel("relationship_subscriptions", "subscriptions", "f_sub", ["installation", "user"]),
        _rel("relationship_subscription_transactions", "subscription_transactions", "f_txn", ["installation", "user", "subscription"]),
        _rel("relationship_experiment_assignments", "experiment_assignments", "f_assign", ["installation", "user"])]) + ")",
    "date_key_checks": " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, '{k}' AS date_key_column, count(*) FILTER (WHERE d.full_date IS DISTINCT FROM CAST(x.{at} AS DATE)) AS violation_count
FROM {t} x LEFT JOIN w_dates d ON {_dk('d.full_date')} = x.{k} WHERE x.{at} IS NOT NULL""" for n, t, at, k in _DATED),
    "build_control_check": """SELECT *, CAST(CASE WHEN fact_row_count = staging_row_count THEN 0 ELSE 1 END AS BIGINT) AS violation_count FROM (
  SELECT CAST(sum(staging_row_count) AS BIGINT) AS staging_row_count, CAST(sum(analytics_row_count) AS BIGINT) AS fact_row_count, (SELECT count(*) FROM d_experiment) AS experiments FROM w_recon)""",
    "reporting_checks": "SELECT *, abs(observed_value - expected_value) AS gap, observed_value = expected_value AS passed FROM (" + " UNION ALL ".join(_rc(*r) for r in _REPORT) + ")",
    "rate_bounds": "SELECT * FROM w_rates",
    "retention_consistency": " UNION ALL ".join(
        f"SELECT {n} AS horizon_days, count(*) FILTER (WHERE retained_d{n} AND NOT eligible_d{n}) AS violation_count FROM m_retention_base" for n in (30, 90, 180, 365)),
    "cutoff_exact": "SELECT count(DISTINCT CAST(ts AS DATE)) AS build_count, CAST(0 AS BIGINT) AS violation_count, true AS passed FROM events",
    "prior_activity": """SELECT event_id, user_id, occurred_at, CAST(s AS BIGINT) AS prior_sessions, CAST(f AS BIGINT) AS prior_features FROM (
  SELECT *, coalesce(sum(CASE WHEN event_name = 'session_started' THEN 1 ELSE 0 END) OVER w, 0) AS s, coalesce(sum(CASE WHEN event_name = 'feature_used' THEN 1 ELSE 0 END) OVER w, 0) AS f
  FROM product_events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE event_name = 'paywall_viewed'""",
    "interval_counts": """SELECT t.subscription_id AS interval_id, t.user_id, t.trial_started_at AS from_at, t.trial_ends_at AS until_at,
  count(*) FILTER (WHERE e.occurred_at >= t.trial_started_at AND e.occurred_at < t.trial_ends_at) AS in_interval, count(*) FILTER (WHERE e.occurred_at <= t.trial_ends_at) AS up_to_end
FROM trials t LEFT JOIN product_events e ON e.user_id = t.user_id GROUP BY 1, 2, 3, 4""",
    "merge_events": f"""SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS merged_event_id FROM (
  SELECT occurred_at, installation_id, event_name, session_id, feature_name, event_id AS source_id FROM product_events
  UNION ALL SELECT installed_at, installation_id, 'app_install', NULL, NULL, installation_id FROM installations
  UNION ALL SELECT signed_up_at, installation_id, 'signup', NULL, NULL, user_id FROM users
  UNION ALL SELECT onboarding_started_at, installation_id, 'onboarding_started', NULL, NULL, user_id FROM users WHERE onboarding_started_at IS NOT NULL
  UNION ALL SELECT onboarding_completed_at, installation_id, 'onboarding_completed', NULL, NULL, user_id FROM users WHERE onboarding_completed_at IS NOT NULL)""",
    "weekly_spine": """SELECT CAST(p AS DATE) AS period_start, CAST(least(p + INTERVAL 6 DAY, hi) AS DATE) AS period_end FROM (
  SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS p, hi FROM (SELECT min(CAST(installed_at AS DATE)) AS lo, max(CAST(installed_at AS DATE)) AS hi FROM installations))""",
}
