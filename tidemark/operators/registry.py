"""Metric registry: which metrics exist, their unit, and whether they may be computed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.fixed import fixed_rows

# Metric key, domain, unit, support status.
METRICS = [
    ("installation_count", "acquisition", "count", "supported"),
    ("signup_count", "funnel", "count", "supported"),
    ("install_to_signup_rate", "funnel", "rate", "supported"),
    ("onboarding_start_rate", "funnel", "rate", "supported"),
    ("onboarding_completion_rate", "funnel", "rate", "supported"),
    ("registered_dau", "engagement", "count", "supported"),
    ("session_count", "engagement", "count", "supported"),
    ("feature_use_event_count", "engagement", "count", "supported"),
    ("paywall_view_count", "engagement", "count", "supported"),
    ("trial_start_count", "subscription", "count", "supported"),
    ("paid_subscription_start_count", "subscription", "count", "supported"),
    ("trial_to_paid_conversion_rate", "subscription", "rate", "supported"),
    ("successful_payment_revenue_gbp", "revenue", "GBP", "supported"),
    ("payment_failure_rate", "revenue", "rate", "supported"),
    ("renewal_success_rate", "subscription", "rate", "supported"),
    ("paid_retention_d30", "retention", "rate", "supported"),
    ("paid_retention_d90", "retention", "rate", "supported"),
    ("paid_retention_d180", "retention", "rate", "supported"),
    ("paid_retention_d365", "retention", "rate", "supported"),
    ("marketing_spend_gbp", "acquisition", "GBP", "supported"),
    ("marketing_ctr", "acquisition", "rate", "supported"),
    ("marketing_cpc_gbp", "acquisition", "GBP", "supported"),
    ("cost_per_install_gbp", "acquisition", "GBP", "supported"),
    ("experiment_exposure_rate", "experiment", "rate", "supported"),
    ("onboarding_completion_48h", "experiment", "rate", "supported"),
    ("trial_start_conversion_7d", "experiment", "rate", "supported"),
    ("paid_conversion_14d", "experiment", "rate", "supported"),
    ("revenue_per_assigned_user_30d", "experiment", "GBP", "supported"),
    ("cancellation_or_expiry_30d", "experiment", "rate", "supported"),
    ("overall_feature_use_7d", "experiment", "rate", "supported"),
    ("average_session_duration_seconds", "engagement", "seconds", "unsupported"),
    ("recognized_revenue_gbp", "revenue", "GBP", "unsupported"),
    ("net_revenue_gbp", "revenue", "GBP", "unsupported"),
    ("campaign_attributed_cac_gbp", "acquisition", "GBP", "unsupported"),
    ("customer_ltv_gbp", "revenue", "GBP", "deferred"),
    ("activation_48h", "experiment", "rate", "deferred"),
    ("d7_return_rate", "experiment", "rate", "deferred"),
    ("ai_assistant_use_7d", "experiment", "rate", "deferred"),
    ("return_session_7d", "experiment", "rate", "deferred"),
]

# Metric key -> outcome column it is computed from.
BINARY_METRICS = {
    "onboarding_completion_48h": "onboarding_completed_48h",
    "overall_feature_use_7d": "feature_used_7d",
    "trial_start_conversion_7d": "trial_started_7d",
    "paid_conversion_14d": "paid_started_14d",
    "cancellation_or_expiry_30d": "cancellation_or_expiry_30d",
}
CONTINUOUS_METRICS = {"revenue_per_assigned_user_30d": "successful_revenue_gbp_30d"}


def metric_registry(spark: SparkSession) -> DataFrame:
    """The 39 definitions as a frame; its size is fixed."""
    return fixed_rows(spark, METRICS, ["metric_key", "metric_domain", "metric_unit", "support_status"])
