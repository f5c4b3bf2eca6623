"""Reporting marts and their roll-ups bound to the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import marts, reports
from tidemark.sources import Warehouse


def cutoff(w: Warehouse) -> DataFrame:
    return marts.observation_cutoff(w.raw_events, column="ts")


def order_cutoff(w: Warehouse) -> DataFrame:
    return marts.observation_cutoff(w.paid_subscriptions, column="subscription_started_at")


def lifecycle(w: Warehouse) -> DataFrame:
    return marts.installation_lifecycle(w.installations, w.users)


def install_funnel(w: Warehouse) -> DataFrame:
    return marts.installation_cohort_funnel(lifecycle(w))


def signup_funnel(w: Warehouse) -> DataFrame:
    return marts.signup_cohort_funnel(w.users, w.installations)


def daily_product(w: Warehouse) -> DataFrame:
    calendar = marts.date_dimension(marts.day_bounds(
        (w.installations, "installed_at"), (w.users, "signed_up_at"), (w.raw_events, "ts")))
    return marts.daily_product_kpis(calendar, w.installations, w.users, w.product_events)


def daily_revenue(w: Warehouse) -> DataFrame:
    # The line items carry the attempt time, so the calendar needs no join.
    calendar = marts.date_dimension(marts.day_bounds((w.table("lineitem"), "l_shipdate")))
    return marts.daily_subscription_revenue(calendar, w.transactions)


def weekly_acquisition(w: Warehouse) -> DataFrame:
    return marts.weekly_acquisition_performance(w.marketing_spend, lifecycle(w))


def features(w: Warehouse) -> DataFrame:
    return marts.daily_feature_engagement(w.product_events)


def trial_cohorts(w: Warehouse) -> DataFrame:
    return marts.trial_conversion_cohorts(w.trials, w.installations, cutoff(w))


def retention_base(w: Warehouse) -> DataFrame:
    return marts.paid_retention_base(w.paid_subscriptions, w.installations, order_cutoff(w))


def retention(w: Warehouse) -> DataFrame:
    return marts.paid_retention_cohorts(retention_base(w))


def channels(w: Warehouse) -> DataFrame:
    return reports.channel_performance(weekly_acquisition(w))


def daily_contexts(w: Warehouse) -> DataFrame:
    """Every day of events is one ingested batch with its own build."""
    day = F.to_date("ts")
    key = (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("long")
    tagged = w.raw_events.select("ts", key.alias("ingestion_batch_id"), key.alias("analytics_build_run_id"))
    return marts.observation_cutoff(tagged, ["ingestion_batch_id", "analytics_build_run_id"], "ts")


def registry_upsert(w: Warehouse) -> DataFrame:
    """Activity definitions per installation: every event is a revision, the newest one wins."""
    current = w.installations.select(
        F.concat(F.lit("activity_"), F.col("installation_id").cast("string")).alias("metric_key"),
        F.lit("app_install").alias("definition"), F.lit(-1).cast("long").alias("revision"))
    changes = w.raw_events.select(
        F.concat(F.lit("activity_"), F.col("user_id").cast("string")).alias("metric_key"),
        F.col("event_type").alias("definition"), F.col("event_id").alias("revision"))
    return reports.upsert_registry(current, changes)


QUERIES = {
    "trial_conversion_cohorts": trial_cohorts,
    "observation_cutoff": cutoff,
    "installation_lifecycle": lifecycle,
    "daily_product_kpis": daily_product,
    "daily_subscription_revenue": daily_revenue,
    "installation_cohort_funnel": install_funnel,
    "signup_cohort_funnel": signup_funnel,
    "weekly_acquisition_performance": weekly_acquisition,
    "daily_feature_engagement": features,
    "paid_retention_base": retention_base,
    "paid_retention_cohorts": retention,
    "trial_prediction_base": lambda w: marts.trial_prediction_base(w.trials, w.installations, w.users, cutoff(w)),
    "metric_registry_upsert": registry_upsert,
    "monthly_growth": lambda w: reports.monthly_growth(daily_product(w)),
    "funnel_summary": lambda w: reports.funnel_summary(install_funnel(w), signup_funnel(w)),
    "channel_performance": channels,
    "platform_funnel": lambda w: reports.install_totals(install_funnel(w), "platform"),
    "country_funnel": lambda w: reports.install_totals(install_funnel(w), "country_code"),
    "period_comparison": lambda w: reports.period_comparison(daily_product(w), 2023, 2024, (1, 2, 12)),
    "channel_highlights": lambda w: reports.channel_highlights(channels(w)),
    "monthly_engagement": lambda w: reports.monthly_engagement(daily_product(w)),
    "feature_share": lambda w: reports.feature_share(features(w)),
    "top_feature": lambda w: reports.top_feature(features(w)),
    "revenue_summary": lambda w: reports.revenue(daily_revenue(w), renewals=True),
    "monthly_revenue": lambda w: reports.monthly_revenue(daily_revenue(w)),
    "trial_conversion_summary": lambda w: reports.trial_summary(trial_cohorts(w)),
    "retention_summary": lambda w: reports.retention_totals(retention(w)),
    "retention_by_billing": lambda w: reports.retention_totals(retention(w), "billing_period"),
    "retention_by_channel": lambda w: reports.retention_totals(retention(w), "acquisition_channel"),
    "business_leaders": lambda w: reports.business_leaders(
        channels(w), reports.retention_totals(retention(w), "acquisition_channel"), reports.feature_share(features(w))),
    "overview_product": lambda w: reports.overview_product(daily_product(w)),
    "overview_funnel": lambda w: reports.overview_funnel(install_funnel(w), signup_funnel(w), trial_cohorts(w)),
    "overview_revenue": lambda w: reports.revenue(daily_revenue(w)),
    "app_channel": lambda w: reports.app_channel(weekly_acquisition(w)),
    "app_platform_funnel": lambda w: reports.app_platform_funnel(install_funnel(w), signup_funnel(w)),
    "app_feature_summary": lambda w: reports.app_feature_summary(features(w)),
    "app_retention_summary": lambda w: reports.retention_totals(retention(w)),
    "app_monthly_product": lambda w: reports.by_month(
        daily_product(w), "installation_count", "signup_count", "session_count", "feature_use_event_count",
        "trial_start_count", "paid_subscription_start_count"),
    "app_monthly_engagement": lambda w: reports.by_month(
        daily_product(w), "session_count", "feature_use_event_count", "paywall_view_count", "trial_start_count"),
    "app_monthly_revenue": lambda w: reports.monthly_revenue(daily_revenue(w)).drop("successful_payment_count"),
    "app_trial_channel": lambda w: reports.trial_summary(trial_cohorts(w), "acquisition_channel"),
    "app_retention_channel": lambda w: reports.retention_totals(retention(w), "acquisition_channel").drop(
        *[f"retained_d{n}_count" for n in marts.HORIZONS]),
    "retention_curve": lambda w: reports.retention_curve(reports.retention_totals(retention(w))),
    "reporting_context": lambda w: reports.latest_context(daily_contexts(w)),
}
