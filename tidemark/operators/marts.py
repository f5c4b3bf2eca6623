"""Reporting marts: lifecycle, daily KPIs, cohort funnels, acquisition, engagement, conversion and retention.

Every mart takes DataFrames with business columns.  ``lineage`` names extra grouping columns (batch and
build ids) when several builds live in one table; all joins and groupings then carry them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import count_when, date_key, days, distinct_when, money, month_of, rate, share, sum_when

HORIZONS = (30, 90, 180, 365)


# --- calendar -----------------------------------------------------------------------------------------

def day_bounds(*columns: tuple[DataFrame, str | Sequence[str]]) -> DataFrame:
    """One row with the first and last day over several timestamp or date columns.

    Every frame is read once for all its columns; only map-side minima and maxima move.
    """
    def ends(df: DataFrame, names: Sequence[str]) -> DataFrame:
        first = [F.to_date(F.min(c)) for c in names]
        last = [F.to_date(F.max(c)) for c in names]
        low, high = (first[0], last[0]) if len(names) == 1 else (F.least(*first), F.greatest(*last))
        return df.agg(low.alias("first_day"), high.alias("last_day"))

    parts = [ends(df, [c] if isinstance(c, str) else list(c)) for df, c in columns]
    return reduce(DataFrame.unionByName, parts).agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def date_dimension(bounds: DataFrame) -> DataFrame:
    """Every day between the bounds with its calendar attributes."""
    day = F.col("full_date")
    iso_dow = F.weekday(day) + 1
    return (
        bounds.where(F.col("first_day").isNotNull())
        .select(F.explode(F.sequence("first_day", "last_day", F.make_dt_interval(days=F.lit(1)))).alias("full_date"))
        .select(
            date_key(day).alias("date_key"),
            "full_date",
            F.year(day).alias("calendar_year"),
            F.quarter(day).alias("calendar_quarter"),
            F.month(day).alias("month_number"),
            F.date_format(day, "MMMM").alias("month_name"),
            F.weekofyear(day).alias("iso_week"),
            F.dayofmonth(day).alias("day_of_month"),
            iso_dow.alias("day_of_week"),
            F.date_format(day, "EEEE").alias("day_name"),
            (iso_dow >= 6).alias("is_weekend"),
        )
    )


# --- installations and users --------------------------------------------------------------------------

def installation_lifecycle(installations: DataFrame, users: DataFrame) -> DataFrame:
    """One row per installation with what its registered users did, not assuming one user each."""
    started, completed = F.col("onboarding_started_at"), F.col("onboarding_completed_at")
    rollup = users.groupBy("installation_id").agg(
        F.count(F.lit(1)).alias("registered"),
        F.min("signed_up_at").alias("first_signed_up_at"),
        F.count(started).alias("started"),
        F.min(started).alias("first_onboarding_started_at"),
        F.count(completed).alias("completed"),
        F.min(completed).alias("first_onboarding_completed_at"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return installations.join(rollup, "installation_id", "left").select(
        "installation_id", "installed_at", F.to_date("installed_at").alias("installed_date"),
        date_key(F.col("installed_at")).alias("installed_date_key"),
        "platform", "acquisition_channel", "country_code",
        n("registered").alias("registered_user_count"), (n("registered") > 0).alias("has_signup"),
        "first_signed_up_at",
        n("started").alias("onboarding_started_user_count"), (n("started") > 0).alias("has_onboarding_started"),
        "first_onboarding_started_at",
        n("completed").alias("onboarding_completed_user_count"), (n("completed") > 0).alias("has_onboarding_completed"),
        "first_onboarding_completed_at",
    )


def installation_cohort_funnel(lifecycle: DataFrame, lineage: Sequence[str] = ()) -> DataFrame:
    return lifecycle.groupBy(
        *lineage, "installed_date_key", "installed_date", "platform", "acquisition_channel", "country_code"
    ).agg(
        F.count(F.lit(1)).alias("installation_count"),
        count_when(F.col("has_signup")).alias("installations_with_signup"),
        share(F.col("has_signup")).alias("install_to_signup_rate"),
    )


def signup_cohort_funnel(users: DataFrame, installations: DataFrame, lineage: Sequence[str] = ()) -> DataFrame:
    where = installations.select(*lineage, "installation_id", "platform", "acquisition_channel", "country_code")
    started, completed = F.col("onboarding_started_at").isNotNull(), F.col("onboarding_completed_at").isNotNull()
    return (
        users.join(where, [*lineage, "installation_id"])
        .groupBy(*lineage, date_key(F.col("signed_up_at")).alias("signed_up_date_key"),
                 F.to_date("signed_up_at").alias("signed_up_date"), "platform", "acquisition_channel", "country_code")
        .agg(
            F.count(F.lit(1)).alias("registered_user_count"),
            count_when(started).alias("onboarding_started_user_count"),
            count_when(completed).alias("onboarding_completed_user_count"),
            share(started).alias("onboarding_start_rate"),
            share(completed).alias("onboarding_completion_rate"),
        )
    )


# --- daily spines ---------------------------------------------------------------------------------------

_EVENT_COUNTS = {
    "session_count": "session_started",
    "feature_use_event_count": "feature_used",
    "paywall_view_count": "paywall_viewed",
    "onboarding_started_count": "onboarding_started",
    "onboarding_completed_count": "onboarding_completed",
    "trial_start_count": "trial_started",
    "paid_subscription_start_count": "subscription_started",
    "cancellation_requested_count": "cancellation_requested",
    "subscription_expired_count": "subscription_expired",
    "payment_failed_event_count": "payment_failed",
}


def daily_event_counts(events: DataFrame) -> DataFrame:
    """Event and distinct-actor counts per day.

    Events first collapse to (day, installation, user): the distinct counts then expand that much smaller
    table instead of every event, and a day or user holding most events is pre-aggregated on the map side.
    """
    name = F.col("event_name")
    per_actor = events.groupBy(F.to_date("occurred_at").alias("full_date"), "installation_id", "user_id").agg(
        *[count_when(name == event).alias(c) for c, event in _EVENT_COUNTS.items()])
    did = lambda c: F.col(c) > 0
    return per_actor.groupBy("full_date").agg(
        *[F.sum(c).alias(c) for c in _EVENT_COUNTS],
        distinct_when(did("session_count"), F.col("installation_id")).alias("active_installation_count"),
        distinct_when(did("session_count"), F.col("user_id")).alias("registered_dau"),
        distinct_when(did("feature_use_event_count"), F.col("user_id")).alias("feature_user_count"),
        distinct_when(did("paywall_view_count"), F.col("user_id")).alias("paywall_view_user_count"),
    )


def daily_product_kpis(calendar: DataFrame, installations: DataFrame, users: DataFrame, events: DataFrame) -> DataFrame:
    """One row per calendar day; days without activity show 0."""
    installs = installations.groupBy(F.to_date("installed_at").alias("full_date")).agg(F.count(F.lit(1)).alias("installation_count"))
    signups = users.groupBy(F.to_date("signed_up_at").alias("full_date")).agg(F.count(F.lit(1)).alias("signup_count"))
    activity = daily_event_counts(events)
    counts = ["installation_count", "signup_count", *[c for c in activity.columns if c != "full_date"]]
    return (
        calendar.select("date_key", "full_date", "iso_week", "is_weekend")
        .join(installs, "full_date", "left").join(signups, "full_date", "left").join(activity, "full_date", "left")
        .fillna(0, subset=counts)
    )


def daily_subscription_revenue(calendar: DataFrame, transactions: DataFrame) -> DataFrame:
    """Payment attempts, collected cash, failures and renewals per calendar day; rates NULL without attempts."""
    ok, failed = F.col("payment_status") == "succeeded", F.col("payment_status") == "failed"
    first, renewal = F.col("transaction_type") == "initial_charge", F.col("transaction_type") == "renewal"
    amount = F.col("amount_gbp")
    daily = transactions.groupBy(F.to_date("attempted_at").alias("full_date")).agg(
        F.count(F.lit(1)).alias("payment_attempt_count"),
        count_when(ok).alias("successful_payment_count"),
        count_when(failed).alias("failed_payment_count"),
        money(sum_when(ok, amount)).alias("successful_payment_revenue_gbp"),
        count_when(first).alias("initial_charge_attempt_count"),
        count_when(first & ok).alias("successful_initial_charge_count"),
        money(sum_when(first & ok, amount)).alias("initial_charge_revenue_gbp"),
        count_when(renewal).alias("renewal_attempt_count"),
        count_when(renewal & ok).alias("successful_renewal_count"),
        count_when(renewal & failed).alias("failed_renewal_count"),
        money(sum_when(renewal & ok, amount)).alias("renewal_revenue_gbp"),
    )
    filled = calendar.select("date_key", "full_date").join(daily, "full_date", "left").fillna(
        0, subset=[c for c in daily.columns if c != "full_date"])
    return filled.withColumns({
        "payment_failure_rate": rate(F.col("failed_payment_count"), F.col("payment_attempt_count")),
        "renewal_success_rate": rate(F.col("successful_renewal_count"), F.col("renewal_attempt_count")),
    })


# --- acquisition and engagement -------------------------------------------------------------------------

def weekly_acquisition_performance(spend: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Spend records with the installs of their channel inside the period.

    The range condition becomes an equi-join: installs are counted per (channel, day) first, and each
    period is unfolded into its days, so neither side is matched on the few channel names alone.
    """
    daily = lifecycle.groupBy("acquisition_channel", F.col("installed_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n_install"), count_when(F.col("has_signup")).alias("n_signup"))
    grain = ["period_start", "period_end", "acquisition_channel", "spend", "impressions", "clicks"]
    unfolded = spend.select(*grain, F.explode(
        F.sequence("period_start", "period_end", F.make_dt_interval(days=F.lit(1)))).alias("day"))
    installs = F.coalesce(F.sum("n_install"), F.lit(0))
    signups = F.coalesce(F.sum("n_signup"), F.lit(0))
    per_period = unfolded.join(daily, ["acquisition_channel", "day"], "left").groupBy(*grain).agg(
        installs.alias("installation_count"), signups.alias("installations_with_signup"))
    return per_period.select(
        "period_start", "period_end", "acquisition_channel", money(F.col("spend")).alias("marketing_spend_gbp"),
        F.col("impressions").cast("long").alias("impressions"), F.col("clicks").cast("long").alias("clicks"),
        "installation_count", "installations_with_signup",
        rate(F.col("installations_with_signup"), F.col("installation_count")).alias("install_to_signup_rate"),
        rate(F.col("clicks"), F.col("impressions")).alias("click_through_rate"),
        rate(F.col("spend"), F.col("clicks")).alias("cost_per_click_gbp"),
        rate(F.col("spend"), F.col("installation_count")).alias("cost_per_install_gbp"),
    )


def daily_feature_engagement(events: DataFrame) -> DataFrame:
    """Feature use per day and feature.  Pre-aggregated per actor and session before the three distinct counts."""
    used = events.where((F.col("event_name") == "feature_used") & F.col("feature_name").isNotNull())
    grain = [F.to_date("occurred_at").alias("full_date"), F.col("feature_name")]
    slim = used.groupBy(*grain, "installation_id", "user_id", "session_id").agg(F.count(F.lit(1)).alias("n"))
    return slim.groupBy("full_date", "feature_name").agg(
        F.sum("n").alias("feature_use_event_count"),
        F.count_distinct("installation_id").alias("feature_installation_count"),
        F.count_distinct("user_id").alias("feature_user_count"),
        F.count_distinct("session_id").alias("feature_session_count"),
    ).withColumn("date_key", date_key(F.col("full_date")))


# --- maturity, conversion, retention --------------------------------------------------------------------

def observation_cutoff(events: DataFrame, lineage: Sequence[str] = (), column: str = "occurred_at") -> DataFrame:
    """Latest observed event, per build when lineage columns are given."""
    return events.groupBy(*lineage).agg(F.max(column).alias("observation_cutoff_at"))


def with_cutoff(df: DataFrame, cutoff: DataFrame, lineage: Sequence[str] = ()) -> DataFrame:
    """Attach the cutoff: one value as a scalar subquery, or one row per build by key."""
    if lineage:
        return df.join(cutoff, list(lineage))
    return df.withColumn("observation_cutoff_at", cutoff.scalar())


def trial_prediction_base(trials: DataFrame, installations: DataFrame, users: DataFrame, cutoff: DataFrame,
                          lineage: Sequence[str] = ()) -> DataFrame:
    """Row-level trial label.  Columns describing the state after the outcome are left out on purpose."""
    i = installations.select(*lineage, "installation_id", "platform", "acquisition_channel", "country_code", "installed_at")
    u = users.select(*lineage, "user_id", "signed_up_at", "onboarding_started_at", "onboarding_completed_at")
    joined = trials.join(i, [*lineage, "installation_id"]).join(u, [*lineage, "user_id"])
    paid_at = F.col("subscription_started_at")
    seen = F.col("observation_cutoff_at")
    return with_cutoff(joined, cutoff, lineage).select(
        *lineage, "subscription_id", "user_id", "installation_id", "billing_period", "price_gbp",
        "platform", "acquisition_channel", "country_code", "installed_at", "signed_up_at",
        "onboarding_started_at", "onboarding_completed_at", "trial_started_at", "trial_ends_at",
        "observation_cutoff_at",
        (F.col("trial_ends_at") <= seen).alias("is_mature_trial"),
        F.coalesce(paid_at <= seen, F.lit(False)).alias("converted_to_paid"),
    )


def trial_conversion_cohorts(trials: DataFrame, installations: DataFrame, cutoff: DataFrame,
                             lineage: Sequence[str] = ()) -> DataFrame:
    """Monthly trial cohorts; only trials whose end has been observed enter the conversion rate."""
    i = installations.select(*lineage, "installation_id", "platform", "acquisition_channel")
    seen = F.col("observation_cutoff_at")
    mature = F.col("trial_ends_at") <= seen
    paid = mature & (F.col("subscription_started_at") <= seen)
    return (
        with_cutoff(trials.join(i, [*lineage, "installation_id"]), cutoff, lineage)
        .groupBy(*lineage, month_of(F.col("trial_started_at")).alias("trial_cohort_month"),
                 "billing_period", "platform", "acquisition_channel")
        .agg(
            F.count(F.lit(1)).alias("trial_count"),
            count_when(mature).alias("mature_trial_count"),
            count_when(~mature).alias("immature_trial_count"),
            count_when(paid).alias("mature_trial_paid_conversion_count"),
            rate(count_when(paid), count_when(mature)).alias("trial_to_paid_conversion_rate"),
        )
    )


def paid_retention_base(subscriptions: DataFrame, installations: DataFrame, cutoff: DataFrame,
                        horizons: Sequence[int] = HORIZONS, lineage: Sequence[str] = ()) -> DataFrame:
    """One row per paid subscription with an eligible/retained flag pair per horizon."""
    i = installations.select(*lineage, "installation_id", "platform", "acquisition_channel")
    start, end, seen = F.col("subscription_started_at"), F.col("expired_at"), F.col("observation_cutoff_at")

    def flags(n: int) -> list[Column]:
        eligible = start + days(n) <= seen
        alive = end.isNull() | (end > start + days(n))
        return [eligible.alias(f"eligible_d{n}"), (eligible & alive).alias(f"retained_d{n}")]

    paid = subscriptions.where(start.isNotNull()).join(i, [*lineage, "installation_id"])
    return with_cutoff(paid, cutoff, lineage).select(
        *lineage, "subscription_id", "user_id", "installation_id", month_of(start).alias("paid_cohort_month"),
        "subscription_started_at", "billing_period", "expired_at", "platform", "acquisition_channel",
        "observation_cutoff_at", *[f for n in horizons for f in flags(n)])


def retention_measures(horizons: Sequence[int] = HORIZONS) -> list[Column]:
    out: list[Column] = []
    for n in horizons:
        eligible, retained = count_when(F.col(f"eligible_d{n}")), count_when(F.col(f"retained_d{n}"))
        out += [eligible.alias(f"mature_d{n}_count"), retained.alias(f"retained_d{n}_count"),
                rate(retained, eligible).alias(f"paid_retention_d{n}")]
    return out


def paid_retention_cohorts(base: DataFrame, horizons: Sequence[int] = HORIZONS, lineage: Sequence[str] = ()) -> DataFrame:
    return base.groupBy(*lineage, "paid_cohort_month", "billing_period", "platform", "acquisition_channel").agg(
        F.count(F.lit(1)).alias("paid_subscription_count"), *retention_measures(horizons))
