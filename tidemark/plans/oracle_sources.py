"""DuckDB text of the data model over the Parquet views, for checking the Spark results independently."""

from __future__ import annotations

import re

SOURCES: dict[str, str] = {
    "installations": """
SELECT CAST(c.c_custkey AS BIGINT) AS installation_id, concat('anon_', CAST(c.c_custkey AS VARCHAR)) AS anonymous_id,
  TIMESTAMP '2023-12-20 00:00:00' + INTERVAL '1' HOUR * CAST((c.c_custkey * 37) % 600 AS INT) AS installed_at,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'ios' ELSE 'android' END AS platform,
  c.c_mktsegment AS acquisition_channel, n.n_name AS country_code
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "users": """
SELECT installation_id AS user_id, installation_id, anonymous_id,
  installed_at + INTERVAL '1' HOUR * CAST(installation_id % 48 AS INT) AS signed_up_at,
  CASE WHEN installation_id % 9 <> 0 THEN installed_at + INTERVAL '1' HOUR * CAST(installation_id % 48 + 1 AS INT) END AS onboarding_started_at,
  CASE WHEN installation_id % 9 <> 0 AND installation_id % 3 <> 0 THEN installed_at + INTERVAL '1' HOUR * CAST(installation_id % 48 + 3 AS INT) END AS onboarding_completed_at
FROM installations WHERE installation_id % 8 <> 7""",
    "product_events": """
SELECT e.event_id, e.ts AS occurred_at, e.user_id AS installation_id, u.user_id,
  CASE e.event_type WHEN 'view' THEN 'session_started' WHEN 'click' THEN 'feature_used' WHEN 'signup' THEN 'paywall_viewed'
    WHEN 'error' THEN 'payment_failed' ELSE CASE WHEN e.event_id % 3 = 0 THEN 'trial_started' WHEN e.event_id % 3 = 1 THEN 'subscription_started' ELSE 'cancellation_requested' END END AS event_name,
  CASE WHEN e.event_type = 'click' THEN concat('feature_', CAST(e.event_id % 5 AS VARCHAR)) END AS feature_name,
  concat(CAST(e.user_id AS VARCHAR), '_', CAST(CAST(e.ts AS DATE) AS VARCHAR)) AS session_id
FROM events e LEFT JOIN users u ON u.user_id = e.user_id AND e.ts >= u.signed_up_at""",
    "trials": """
SELECT u.user_id AS subscription_id, u.user_id, u.installation_id,
  CASE WHEN u.user_id % 5 = 0 THEN 'annual' ELSE 'monthly' END AS billing_period,
  CAST(CASE WHEN u.user_id % 5 = 0 THEN 99.99 ELSE 11.99 END AS DECIMAL(18,2)) AS price_gbp,
  TIMESTAMP '2024-01-03 06:00:00' + INTERVAL '1' HOUR * CAST((u.user_id * 31) % 480 AS INT) AS trial_started_at,
  TIMESTAMP '2024-01-10 06:00:00' + INTERVAL '1' HOUR * CAST((u.user_id * 31) % 480 AS INT) AS trial_ends_at,
  CASE WHEN u.user_id % 3 = 0 THEN TIMESTAMP '2024-01-10 06:00:00' + INTERVAL '1' HOUR * CAST((u.user_id * 31) % 480 AS INT) END AS subscription_started_at
FROM users u WHERE u.signed_up_at <= TIMESTAMP '2024-01-03 06:00:00' + INTERVAL '1' HOUR * CAST((u.user_id * 31) % 480 AS INT)""",
    "paid_subscriptions": """
SELECT o_orderkey AS subscription_id, o_custkey AS user_id, o_custkey AS installation_id,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'annual' ELSE 'monthly' END AS billing_period,
  o_orderdate AS subscription_started_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' DAY * CAST((o_orderkey * 13) % 500 AS INT) END AS expired_at
FROM orders""",
    "transactions": """
SELECT l.l_orderkey AS subscription_id, l.l_linenumber AS billing_cycle_number, o.o_custkey AS user_id, l.l_shipdate AS attempted_at,
  CASE WHEN l.l_linenumber = 1 THEN 'initial_charge' ELSE 'renewal' END AS transaction_type,
  CASE WHEN l.l_returnflag = 'R' THEN 'failed' ELSE 'succeeded' END AS payment_status,
  CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount_gbp
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "event_payments": """
SELECT event_id AS transaction_id, user_id, ts AS attempted_at,
  CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS payment_status,
  CAST(CASE WHEN event_id % 4 = 0 THEN 99.99 ELSE 11.99 END AS DECIMAL(18,2)) AS amount_gbp
FROM events WHERE event_type = 'purchase' AND event_id % 3 = 1""",
    "marketing_spend": """
SELECT CAST(date_trunc('week', e.ts) AS DATE) AS period_start, CAST(date_trunc('week', e.ts) + INTERVAL '6' DAY AS DATE) AS period_end, i.acquisition_channel,
  CAST(coalesce(sum(CAST(e.value AS DECIMAL(18,2))) FILTER (WHERE e.event_type = 'purchase'), 0) AS DECIMAL(18,2)) AS spend,
  CAST(count(*) FILTER (WHERE e.event_type = 'view') AS INT) AS impressions, CAST(count(*) FILTER (WHERE e.event_type = 'click') AS INT) AS clicks
FROM events e JOIN installations i ON i.installation_id = e.user_id WHERE e.ts IS NOT NULL GROUP BY 1, 2, 3""",
    "experiments": """
SELECT 'exp_a' AS experiment_id, TIMESTAMP '2024-01-02 00:00:00' AS start_at, TIMESTAMP '2024-01-12 00:00:00' AS end_at, 7 AS analysis_window_days, 'paywall_viewers' AS eligibility_rule, 'trial_start_conversion_7d' AS primary_metric, 'paid_conversion_14d' AS secondary_metric, 'revenue_per_assigned_user_30d' AS commercial_metric, 'cancellation_or_expiry_30d' AS guardrail_metric
UNION ALL SELECT 'exp_b', TIMESTAMP '2023-12-22 00:00:00', TIMESTAMP '2024-01-15 00:00:00', 14, 'new_signups', 'onboarding_completion_48h', 'activation_48h', 'trial_start_conversion_14d', 'd7_return_rate'
UNION ALL SELECT 'exp_c', TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-25 00:00:00', 14, 'onboarded_session_users', 'ai_assistant_use_7d', 'return_session_7d', 'trial_start_conversion_14d', 'overall_feature_use_7d'""",
    "experiment_assignments": """
SELECT concat(experiment_id, ':', CAST(user_id AS VARCHAR)) AS assignment_id, experiment_id, user_id, installation_id, assignment_at,
  CASE WHEN substr(md5(concat(experiment_id, ':', CAST(user_id AS VARCHAR))), 1, 1) < '8' THEN 'control' ELSE 'treatment' END AS variant,
  CAST(0.5 AS DOUBLE) AS allocation_probability
FROM (SELECT x.experiment_id, u.user_id, u.installation_id,
    CASE WHEN x.eligibility_rule = 'new_signups' THEN max(CASE WHEN u.signed_up_at >= x.start_at AND u.signed_up_at < x.end_at THEN u.signed_up_at END)
         ELSE min(CASE WHEN e.occurred_at >= x.start_at AND e.occurred_at < x.end_at AND e.occurred_at >= u.signed_up_at
              AND ((x.eligibility_rule = 'paywall_viewers' AND e.event_name = 'paywall_viewed')
                OR (x.eligibility_rule = 'onboarded_session_users' AND e.event_name = 'session_started' AND e.occurred_at >= u.onboarding_completed_at)) THEN e.occurred_at END) END AS assignment_at
  FROM users u CROSS JOIN experiments x LEFT JOIN product_events e ON e.user_id = u.user_id
  GROUP BY x.experiment_id, x.eligibility_rule, u.user_id, u.installation_id) t WHERE assignment_at IS NOT NULL""",
}


def _needed(text: str, available: dict[str, str]) -> set[str]:
    found: set[str] = set()
    todo = [text]
    while todo:
        current = todo.pop()
        for name in available:
            if name not in found and re.search(rf"\b{name}\b", current):
                found.add(name)
                todo.append(available[name])
    return found


def compose(body: str, shared: dict[str, str]) -> str:
    """Prefix ``body`` with the sources and shared steps it mentions, in definition order."""
    everything = {**SOURCES, **shared}
    needed = _needed(body, everything)
    texts = [body, *[everything[n] for n in needed]]
    uses = {n: sum(len(re.findall(rf"\b{n}\b", t)) for t in texts) for n in needed}
    recursive = {n for n in needed if re.search(rf"\b{n}\b", everything[n])}
    ctes = [f"{name} AS {'MATERIALIZED ' if uses[name] > 1 and name not in recursive else ''}({text.strip()}\n)" for name, text in everything.items() if name in needed]
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()
