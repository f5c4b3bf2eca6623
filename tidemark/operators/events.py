"""Helpers over event histories: prior activity, interval counts, merging streams, weekly periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import ordered_prefix


def _minute(ts: Column) -> Column:
    return F.timestamp_diff("MINUTE", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def prior_activity(events: DataFrame) -> DataFrame:
    """Sessions and feature uses of the user before each paywall view, ordered by (time, event id).

    Running counts come in two levels, minutes and events inside a minute, so a user with most of the events
    is spread over as many tasks as there are minutes of activity.
    """
    name = F.col("event_name")
    mine = events.where(F.col("user_id").isNotNull() & name.isin("session_started", "feature_used", "paywall_viewed")).select(
        "event_id", "user_id", "occurred_at", "event_name")
    hit = lambda event: F.when(name == event, 1).otherwise(0)
    counted = ordered_prefix(mine, [F.col("occurred_at"), F.col("event_id")], [_minute(F.col("occurred_at"))],
                             {"prior_sessions": hit("session_started"), "prior_features": hit("feature_used")}, ["user_id"])
    # A paywall view adds to neither count, so the inclusive total is the count before it.
    return counted.where(F.col("event_name") == "paywall_viewed").select("event_id", "user_id", "occurred_at", "prior_sessions", "prior_features")


def interval_counts(intervals: DataFrame, events: DataFrame) -> DataFrame:
    """Per interval: the user's events in [from, until), and all up to and including ``until``.

    Events and interval ends of a user are put in one order and get running counts; an interval is the difference of two.
    So one user with many events and many intervals costs their sum, not their product.
    """
    moments = events.where(F.col("user_id").isNotNull() & F.col("occurred_at").isNotNull()).groupBy("user_id", "occurred_at").agg(F.count(F.lit(1)).alias("n"))
    moments = moments.select("user_id", F.col("occurred_at").alias("at"), F.lit(1).alias("side"), "n", F.lit(None).cast("string").alias("mark"), F.lit(None).cast(dict(intervals.dtypes)["interval_id"]).alias("interval_id"))
    ends = F.array(F.struct(F.col("from_at").alias("at"), F.lit(0).alias("side"), F.lit("from").alias("mark")),
                   F.struct(F.col("until_at").alias("at"), F.lit(0).alias("side"), F.lit("until").alias("mark")),
                   F.struct(F.col("until_at").alias("at"), F.lit(2).alias("side"), F.lit("upto").alias("mark")))
    marks = intervals.select("user_id", "interval_id", F.inline(ends)).where(F.col("user_id").isNotNull() & F.col("at").isNotNull())
    rows = moments.unionByName(marks.withColumn("n", F.lit(0).cast("long")))
    counted = ordered_prefix(rows, [F.col("at"), F.col("side")], [F.to_date("at"), F.col("at")], {"c": F.col("n")}, ["user_id"])
    seen = lambda mark: F.max(F.when(F.col("mark") == mark, F.col("c")))
    counts = counted.where(F.col("mark").isNotNull()).groupBy("interval_id").agg(
        F.greatest(seen("until") - seen("from"), F.lit(0)).alias("in_interval"), seen("upto").alias("up_to_end"))
    return intervals.join(counts, "interval_id", "left").fillna(0, subset=["in_interval", "up_to_end"])


# Order of simultaneous events.
PRIORITY = ["app_install", "signup", "onboarding_started", "onboarding_completed", "session_started", "feature_used", "paywall_viewed",
            "trial_started", "subscription_started", "subscription_renewed", "payment_failed", "cancellation_requested", "subscription_expired"]


INSTALLATIONS = 1_024  # installation ids of a slice


def merge_events(*streams: DataFrame) -> DataFrame:
    """Union of event streams in one total order, renumbered from 1.

    Order: time, installation, name priority, session, feature, then the original id.  Numbers are ranks
    inside (moment, installation range) slices plus the count of all earlier ones; no task sorts the whole
    history.  A name that has no priority is refused.
    """
    columns = ["occurred_at", "installation_id", "event_name", "session_id", "feature_name", "source_id"]
    merged = streams[0].select(*columns)
    for s in streams[1:]:
        merged = merged.unionByName(s.select(*columns))
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("event_name"))
    order = [F.col("occurred_at"), F.col("installation_id"), rank, F.coalesce("session_id", F.lit("")), F.coalesce("feature_name", F.lit("")), F.col("source_id")]
    known = merged.where(F.when(rank > 0, True).otherwise(F.raise_error(F.concat(F.lit("unknown event name: "), F.coalesce("event_name", F.lit("NULL"))))))
    # Date-only stamps put a whole day into one moment: ranges of installations split it.
    at = F.col("occurred_at")
    return ordered_prefix(known, order, [_minute(at), at, F.floor(F.col("installation_id") / INSTALLATIONS)], {"merged_event_id": F.lit(1)})


def weekly_spine(bounds: DataFrame) -> DataFrame:
    """Inclusive 7-day periods from the first to the last day; the last one is clipped."""
    starts = bounds.select("last_day", F.explode(F.sequence("first_day", "last_day", F.make_dt_interval(days=F.lit(7)))).alias("period_start"))
    return starts.select("period_start", F.least(F.date_add("period_start", 6), F.col("last_day")).alias("period_end"))
