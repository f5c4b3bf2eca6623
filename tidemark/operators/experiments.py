"""Experiment assignment, outcome windows and inference over a whole table of experiments and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import count_when, days, elapsed_seconds, hours, money, rate, share, sum_when
from tidemark.operators.marts import with_cutoff

# Eligibility rule -> event that triggers the assignment, and whether onboarding must be finished.
ELIGIBILITY = {
    "new_signups": ("signup", False),
    "paywall_viewers": ("paywall_viewed", False),
    "onboarded_session_users": ("session_started", True),
}


def trigger_assignments(users: DataFrame, events: DataFrame, experiments: DataFrame) -> DataFrame:
    """First trigger of every (experiment, user) inside the experiment window, with its exposure time.

    Signups and trigger events form one stream of moments that meets the experiments on the trigger name,
    so users are never paired with experiments they did not trigger.
    """
    rule = F.col("eligibility_rule")
    trigger = F.coalesce(*[F.when(rule == r, F.lit(t)) for r, (t, _) in ELIGIBILITY.items()])
    onboarded = rule.isin(*[r for r, (_, need) in ELIGIBILITY.items() if need])
    config = experiments.select("experiment_id", "start_at", "end_at", rule.alias("rule"),
                                trigger.alias("trigger"), onboarded.alias("needs_onboarding"))
    person = users.select("user_id", "installation_id", "signed_up_at", "onboarding_started_at", "onboarding_completed_at")
    signups = person.withColumns({"trigger": F.lit("signup"), "moment": F.col("signed_up_at")})
    wanted = [t for t, _ in ELIGIBILITY.values() if t != "signup"]
    seen = events.where(F.col("event_name").isin(*wanted) & F.col("user_id").isNotNull()).select(
        "user_id", F.col("event_name").alias("trigger"), F.col("occurred_at").alias("moment")).join(person, "user_id")
    at = F.col("moment")
    inside = (
        (at >= F.col("start_at")) & (at < F.col("end_at")) & (at >= F.col("signed_up_at"))
        & (~F.col("needs_onboarding") | (at >= F.col("onboarding_completed_at")))
    )
    first = signups.unionByName(seen).join(config, "trigger").where(inside).groupBy(
        "experiment_id", "user_id").agg(
        F.min("moment").alias("assignment_at"), F.first("installation_id").alias("installation_id"),
        F.first("rule").alias("eligibility_rule"), F.first("end_at").alias("end_at"),
        F.first("onboarding_started_at").alias("started"))
    later = (F.col("started") >= F.col("assignment_at")) & (F.col("started") < F.col("end_at"))
    exposed = F.when(F.col("eligibility_rule") == "new_signups", F.when(later, F.col("started"))).otherwise(F.col("assignment_at"))
    return first.select("experiment_id", "user_id", "installation_id", "eligibility_rule", "assignment_at",
                        exposed.alias("exposed_at"))


def draw_variant(assigned: DataFrame, allocation: Sequence[tuple[str, float]] = (("control", 0.5), ("treatment", 0.5))) -> DataFrame:
    """Variant from a hash of (experiment, user): the same user lands in the same arm in any row order."""
    key = F.concat_ws(":", "experiment_id", F.col("user_id").cast("string"))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(2**32)
    chosen: Column = F.lit(allocation[-1][0])
    probability: Column = F.lit(float(allocation[-1][1]))
    upper = 1.0 - allocation[-1][1]
    for name, p in reversed(allocation[:-1]):
        chosen = F.when(F.col("draw") < upper, name).otherwise(chosen)
        probability = F.when(F.col("draw") < upper, F.lit(float(p))).otherwise(probability)
        upper -= p
    return assigned.withColumns({"assignment_id": key, "draw": draw}).withColumns(
        {"variant": chosen, "allocation_probability": probability})


def assignment_base(assignments: DataFrame, experiments: DataFrame, users: DataFrame, installations: DataFrame,
                    cutoff: DataFrame) -> DataFrame:
    """Assignments with experiment, user and installation context and window maturity."""
    x = experiments.select("experiment_id", "analysis_window_days")
    u = users.select("user_id", "signed_up_at", "onboarding_completed_at")
    i = installations.select("installation_id", "platform", "acquisition_channel", "country_code")
    joined = assignments.join(x, "experiment_id").join(u, "user_id").join(i, "installation_id")
    return with_cutoff(joined, cutoff).select(
        "assignment_id", "experiment_id", "analysis_window_days", "user_id", "installation_id", "variant",
        "allocation_probability", "assignment_at", "exposed_at", F.col("exposed_at").isNotNull().alias("is_exposed"),
        elapsed_seconds(F.col("assignment_at"), F.col("exposed_at")).alias("exposure_delay_seconds"),
        "onboarding_completed_at", "platform", "acquisition_channel", "country_code", "observation_cutoff_at",
        (F.col("assignment_at") + days(F.col("analysis_window_days")) <= F.col("observation_cutoff_at")).alias("analysis_window_mature"),
    )


def _in_window(base: DataFrame, facts: DataFrame, at: str, reach: int) -> DataFrame:
    """Facts of the assigned user in ``[assignment, assignment + max(reach, window))``.

    An inner equi-join on the user with a range residue: a user holding most facts is split by adaptive
    execution on either side, and the aggregate above combines partially before its shuffle.
    """
    slim = base.select("assignment_id", "user_id", "assignment_at", "analysis_window_days")
    end = F.col("assignment_at") + days(F.greatest(F.lit(reach), F.col("analysis_window_days")))
    return slim.join(facts.where(F.col("user_id").isNotNull()), "user_id").where(
        (F.col(at) >= F.col("assignment_at")) & (F.col(at) < end))


def event_outcomes(base: DataFrame, events: DataFrame) -> DataFrame:
    """Counts and flags in the 7, 14, 30 day and per-experiment windows, for assignments with any event."""
    hits = _in_window(base, events.select("user_id", "event_name", "occurred_at"), "occurred_at", 30)

    def inside(*names: str, n: int | Column) -> Column:
        return F.col("event_name").isin(*names) & (F.col("occurred_at") < F.col("assignment_at") + days(n))

    any_of = lambda *names, n: F.coalesce(F.bool_or(inside(*names, n=n)), F.lit(False))
    window = F.col("analysis_window_days")
    return hits.groupBy("assignment_id").agg(
        count_when(inside("session_started", n=7)).alias("session_count_7d"),
        count_when(inside("feature_used", n=7)).alias("feature_use_event_count_7d"),
        count_when(inside("paywall_viewed", n=7)).alias("paywall_view_count_7d"),
        any_of("trial_started", n=7).alias("trial_started_7d"),
        any_of("trial_started", n=14).alias("trial_started_14d"),
        any_of("subscription_started", n=14).alias("paid_started_14d"),
        any_of("subscription_started", n=30).alias("paid_started_30d"),
        any_of("cancellation_requested", "subscription_expired", n=30).alias("cancellation_or_expiry_30d"),
        any_of("trial_started", n=window).alias("trial_started_analysis_window"),
        any_of("subscription_started", n=window).alias("paid_started_analysis_window"),
    )


def revenue_outcomes(base: DataFrame, payments: DataFrame) -> DataFrame:
    """Collected cash in 30 days and in the experiment window, for assignments with any successful payment."""
    paid = payments.where(F.col("payment_status") == "succeeded").select("user_id", "attempted_at", "amount_gbp")
    hits = _in_window(base, paid, "attempted_at", 30)
    within = lambda n: F.col("attempted_at") < F.col("assignment_at") + days(n)
    return hits.groupBy("assignment_id").agg(
        sum_when(within(30), F.col("amount_gbp")).alias("successful_revenue_gbp_30d"),
        sum_when(within(F.col("analysis_window_days")), F.col("amount_gbp")).alias("successful_revenue_gbp_analysis_window"))


COUNT_OUTCOMES = ["session_count_7d", "feature_use_event_count_7d", "paywall_view_count_7d"]
FLAG_OUTCOMES = ["trial_started_7d", "trial_started_14d", "paid_started_14d", "paid_started_30d",
                 "cancellation_or_expiry_30d", "trial_started_analysis_window", "paid_started_analysis_window"]
MONEY_OUTCOMES = ["successful_revenue_gbp_30d", "successful_revenue_gbp_analysis_window"]


def assignment_outcomes(base: DataFrame, events: DataFrame, payments: DataFrame) -> DataFrame:
    """One row per assignment with every outcome; nothing observed means 0 or false."""
    done, at = F.col("onboarding_completed_at"), F.col("assignment_at")
    joined = base.join(event_outcomes(base, events), "assignment_id", "left").join(
        revenue_outcomes(base, payments), "assignment_id", "left")
    return joined.fillna(0, subset=COUNT_OUTCOMES).fillna(False, subset=FLAG_OUTCOMES).withColumns({
        **{c: money(F.coalesce(F.col(c), F.lit(0))) for c in MONEY_OUTCOMES},
        "feature_used_7d": F.coalesce(F.col("feature_use_event_count_7d"), F.lit(0)) > 0,
        "onboarding_completed_48h": F.coalesce((done >= at) & (done < at + hours(48)), F.lit(False)),
    })


def variant_summary(outcomes: DataFrame) -> DataFrame:
    """Descriptive counts, rates and means per experiment and variant."""
    n = F.count(F.lit(1))
    # Cents as integers: the sum is exact and independent of row order.
    revenue = F.sum(F.round(F.col("successful_revenue_gbp_30d") * 100).cast("long")) / 100.0
    flag = F.col
    return outcomes.groupBy("experiment_id", "variant").agg(
        n.alias("assigned_user_count"),
        count_when(flag("is_exposed")).alias("exposed_user_count"),
        share(flag("is_exposed")).alias("exposure_rate"),
        F.avg("allocation_probability").alias("average_allocation_probability"),
        count_when(flag("onboarding_completed_48h")).alias("onboarding_completed_48h_count"),
        share(flag("onboarding_completed_48h")).alias("onboarding_completion_48h_rate"),
        count_when(flag("feature_used_7d")).alias("feature_used_7d_count"),
        share(flag("feature_used_7d")).alias("overall_feature_use_7d_rate"),
        count_when(flag("trial_started_7d")).alias("trial_started_7d_count"),
        share(flag("trial_started_7d")).alias("trial_start_conversion_7d"),
        count_when(flag("paid_started_14d")).alias("paid_started_14d_count"),
        share(flag("paid_started_14d")).alias("paid_conversion_14d"),
        revenue.alias("successful_revenue_gbp_30d"),
        rate(revenue, n).alias("revenue_per_assigned_user_30d"),
        count_when(flag("cancellation_or_expiry_30d")).alias("cancellation_or_expiry_30d_count"),
        share(flag("cancellation_or_expiry_30d")).alias("cancellation_or_expiry_30d_rate"),
        F.avg("session_count_7d").alias("average_session_count_7d"),
        F.avg("feature_use_event_count_7d").alias("average_feature_use_event_count_7d"),
    )


def experiment_maturity(outcomes: DataFrame) -> DataFrame:
    mature = F.col("analysis_window_mature")
    return outcomes.groupBy("experiment_id", "variant").agg(
        F.count(F.lit(1)).alias("assigned_user_count"),
        count_when(F.col("is_exposed")).alias("exposed_user_count"),
        count_when(mature).alias("mature_analysis_window_count"),
        share(mature).alias("mature_analysis_window_rate"))
