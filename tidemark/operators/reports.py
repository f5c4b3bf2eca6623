"""Business roll-ups over the marts.  Rates are always recomputed from counts, never averaged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import month_of, rate
from tidemark.operators.marts import HORIZONS


def _sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two one-row frames side by side; the right one is a scalar subquery, not a join."""
    packed = right.select(F.struct(*right.columns).alias("r")).scalar()
    return left.withColumn("__r", packed).select(*left.columns, "__r.*")


# --- growth ---------------------------------------------------------------------------------------------

def by_month(daily: DataFrame, *measures: str) -> DataFrame:
    return daily.groupBy(month_of(F.col("full_date")).alias("month_start")).agg(*_sums(*measures))


def monthly_growth(daily: DataFrame) -> DataFrame:
    return by_month(daily, "installation_count", "signup_count", "paywall_view_count", "trial_start_count",
                    "paid_subscription_start_count")


_INSTALL = ("installation_count", "installations_with_signup")
_SIGNUP = ("registered_user_count", "onboarding_started_user_count", "onboarding_completed_user_count")


def install_totals(cohorts: DataFrame, *by: str) -> DataFrame:
    out = cohorts.groupBy(*by).agg(*_sums(*_INSTALL))
    return out.withColumn("install_to_signup_rate", rate(F.col("installations_with_signup"), F.col("installation_count")))


def signup_totals(cohorts: DataFrame, *by: str) -> DataFrame:
    users = F.col("registered_user_count")
    return cohorts.groupBy(*by).agg(*_sums(*_SIGNUP)).withColumns({
        "onboarding_start_rate": rate(F.col("onboarding_started_user_count"), users),
        "onboarding_completion_rate": rate(F.col("onboarding_completed_user_count"), users),
    })


def funnel_summary(install_cohorts: DataFrame, signup_cohorts: DataFrame) -> DataFrame:
    return beside(install_totals(install_cohorts), signup_totals(signup_cohorts))


def channel_performance(weekly: DataFrame) -> DataFrame:
    spend, installs = F.col("marketing_spend_gbp"), F.col("installation_count")
    return weekly.groupBy("acquisition_channel").agg(
        F.count(F.lit(1)).alias("marketing_period_count"),
        *_sums("marketing_spend_gbp", "impressions", "clicks", *_INSTALL),
    ).withColumns({
        "click_through_rate": rate(F.col("clicks"), F.col("impressions")),
        "cost_per_click_gbp": rate(spend, F.col("clicks")),
        "cost_per_install_gbp": rate(spend, installs),
        "install_to_signup_rate": rate(F.col("installations_with_signup"), installs),
    })


def period_comparison(daily: DataFrame, baseline_year: int, comparison_year: int,
                      months: Sequence[int] = (1, 2, 3, 4, 5, 6)) -> DataFrame:
    """Same calendar months of two years, one row per measure; the change is NULL on an empty baseline."""
    fields = ["installation_count", "signup_count", "trial_start_count", "paid_subscription_start_count"]
    year = F.year("full_date")
    chosen = daily.where(F.month("full_date").isin(*months) & year.isin(baseline_year, comparison_year))
    total = lambda f, y: F.coalesce(F.sum(F.when(year == y, F.col(f))), F.lit(0))
    pairs = chosen.agg(F.array(*[
        F.struct(F.lit(f).alias("measure"), total(f, baseline_year).alias("baseline"), total(f, comparison_year).alias("comparison"))
        for f in fields]).alias("m"))
    change = rate(F.col("comparison") - F.col("baseline"), F.col("baseline")) * 100.0
    return pairs.select(F.inline("m")).withColumn("percent_change", change)


def leaders(df: DataFrame, name: str, wanted: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """Arg-max / arg-min rows of one frame in a single aggregate, ties broken by name.

    ``wanted`` lists (label, value column, highest?).  The lowest is taken among positive values only; a label
    without a qualifying row yields no row.
    """
    def best(label: str, value: str, highest: bool) -> Column:
        key = F.struct(F.col(value).cast("double").alias("value"), F.col(name).alias("leader"))
        usable = F.col(value).isNotNull() if highest else F.col(value) > 0
        pick = (F.max if highest else F.min)(F.when(usable, key))
        return F.struct(F.lit(label).alias("highlight"), pick["leader"].alias("leader"), pick["value"].alias("value"))

    return df.agg(F.array(*[best(*w) for w in wanted]).alias("a")).select(F.inline("a")).where(F.col("leader").isNotNull())


def channel_highlights(channels: DataFrame) -> DataFrame:
    return leaders(channels, "acquisition_channel", [
        ("highest_install_volume", "installation_count", True),
        ("highest_signup_conversion", "install_to_signup_rate", True),
        ("lowest_cost_per_install", "cost_per_install_gbp", False),
        ("highest_marketing_spend", "marketing_spend_gbp", True),
    ])


def business_leaders(channels: DataFrame, retention_by_channel: DataFrame, features: DataFrame) -> DataFrame:
    """Best signup channel, cheapest install, best one-year retention and top feature."""
    by_channel = leaders(channels, "acquisition_channel", [
        ("best_signup_channel", "install_to_signup_rate", True), ("lowest_positive_cpi", "cost_per_install_gbp", False)])
    return by_channel.union(
        leaders(retention_by_channel, "acquisition_channel", [("best_d365_channel", "paid_retention_d365", True)])
    ).union(leaders(features, "feature_name", [("top_feature", "feature_use_event_count", True)]))


# --- engagement and money -------------------------------------------------------------------------------

def monthly_engagement(daily: DataFrame) -> DataFrame:
    return daily.groupBy(month_of(F.col("full_date")).alias("month_start")).agg(
        F.avg("registered_dau").alias("average_registered_dau"),
        F.max("registered_dau").alias("peak_registered_dau"),
        *_sums("session_count", "feature_use_event_count", "paywall_view_count", "trial_start_count",
               "paid_subscription_start_count"))


def feature_share(daily_features: DataFrame) -> DataFrame:
    """Share of all feature use.  The window only sees the aggregated feature list."""
    totals = daily_features.groupBy("feature_name").agg(*_sums("feature_use_event_count"))
    n = F.col("feature_use_event_count")
    return totals.withColumn("feature_use_event_share", rate(n, F.sum(n).over(Window.partitionBy())))


def top_feature(daily_features: DataFrame) -> DataFrame:
    return leaders(feature_share(daily_features), "feature_name", [("top_feature", "feature_use_event_count", True)])


def revenue(daily: DataFrame, *by: Column | str, renewals: bool = False) -> DataFrame:
    extra = ["failed_renewal_count", "renewal_revenue_gbp"] if renewals else []
    return daily.groupBy(*by).agg(*_sums(
        "payment_attempt_count", "successful_payment_count", "failed_payment_count",
        "successful_payment_revenue_gbp", "renewal_attempt_count", "successful_renewal_count", *extra,
    )).withColumns({
        "payment_failure_rate": rate(F.col("failed_payment_count"), F.col("payment_attempt_count")),
        "renewal_success_rate": rate(F.col("successful_renewal_count"), F.col("renewal_attempt_count")),
    })


def monthly_revenue(daily: DataFrame) -> DataFrame:
    return revenue(daily, month_of(F.col("full_date")).alias("month_start"))


def trial_summary(cohorts: DataFrame, *by: str) -> DataFrame:
    return cohorts.groupBy(*by).agg(*_sums(
        "trial_count", "mature_trial_count", "immature_trial_count", "mature_trial_paid_conversion_count",
    )).withColumn("trial_to_paid_conversion_rate",
                  rate(F.col("mature_trial_paid_conversion_count"), F.col("mature_trial_count")))


def retention_totals(cohorts: DataFrame, *by: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    sums = [c for n in horizons for c in (f"mature_d{n}_count", f"retained_d{n}_count")]
    return cohorts.groupBy(*by).agg(*_sums("paid_subscription_count", *sums)).withColumns({
        f"paid_retention_d{n}": rate(F.col(f"retained_d{n}_count"), F.col(f"mature_d{n}_count")) for n in horizons})


def retention_curve(summary: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Horizons as rows."""
    points = F.array(*[F.struct(
        F.lit(n).alias("horizon_days"), F.col(f"mature_d{n}_count").alias("eligible_count"),
        F.col(f"retained_d{n}_count").alias("retained_count"), F.col(f"paid_retention_d{n}").alias("retention_rate"),
    ) for n in horizons])
    return summary.select(F.inline(points))


# --- dashboard sets -------------------------------------------------------------------------------------

def overview_product(daily: DataFrame) -> DataFrame:
    return daily.agg(*_sums("installation_count", "signup_count", "session_count", "feature_use_event_count",
                            "trial_start_count", "paid_subscription_start_count"))


def overview_funnel(install_cohorts: DataFrame, signup_cohorts: DataFrame, trial_cohorts: DataFrame) -> DataFrame:
    trial = trial_summary(trial_cohorts).select(
        "mature_trial_count", "mature_trial_paid_conversion_count", "trial_to_paid_conversion_rate")
    return beside(funnel_summary(install_cohorts, signup_cohorts), trial)


def app_channel(weekly: DataFrame) -> DataFrame:
    return channel_performance(weekly).drop("marketing_period_count").fillna(0, subset=["impressions", "clicks"])


def app_platform_funnel(install_cohorts: DataFrame, signup_cohorts: DataFrame) -> DataFrame:
    return install_totals(install_cohorts, "platform").join(signup_totals(signup_cohorts, "platform"), "platform")


def app_feature_summary(daily_features: DataFrame) -> DataFrame:
    n = F.col("feature_use_event_count")
    return daily_features.groupBy("feature_name").agg(
        F.sum(n).alias("feature_use_event_count"),
        F.sum("feature_installation_count").alias("feature_installation_count_days"),
        F.sum("feature_user_count").alias("feature_user_days"),
        F.sum("feature_session_count").alias("feature_session_count"),
    ).withColumn("feature_use_share", rate(n, F.sum(n).over(Window.partitionBy())))


# --- context and metric registry ------------------------------------------------------------------------

def latest_context(cutoffs: DataFrame) -> DataFrame:
    """Newest build with its cutoff (one row); a top-1 report by definition."""
    return cutoffs.agg(F.max(F.struct("analytics_build_run_id", "ingestion_batch_id", "observation_cutoff_at")).alias("c")).select("c.*")


def metric_support(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """State per requested metric whether it may be computed: only ``supported`` ones may."""
    known = registry.select("metric_key", "support_status")
    status = F.coalesce("support_status", F.lit("unknown"))
    return requested.join(known, "metric_key", "left").select(
        *requested.columns, status.alias("support_status"), (status == "supported").alias("allowed"))


class UnsupportedMetric(ValueError):
    """A requested metric is deferred, unsupported or unknown."""


def require_supported(requested: DataFrame, registry: DataFrame) -> None:
    """Raise when any requested metric may not be computed; the list is bounded by the registry."""
    refused = metric_support(requested, registry).where(~F.col("allowed")).select("metric_key", "support_status").distinct()
    bad = [f"{r.metric_key} ({r.support_status})" for r in refused.sort("metric_key").toLocalIterator()]
    if bad:
        raise UnsupportedMetric(", ".join(bad))


def upsert_registry(current: DataFrame, changes: DataFrame, key: str = "metric_key", version: str = "revision") -> DataFrame:
    """Insert new definitions and replace existing ones: the highest revision per key wins."""
    row = F.struct(version, *[c for c in current.columns if c != version])
    return current.unionByName(changes).groupBy(key).agg(F.max(row).alias("r")).select("r.*")
