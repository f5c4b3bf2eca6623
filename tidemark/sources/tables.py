"""Map the Parquet tables at hand onto the product-analytics data model.

Each property is a lazy DataFrame; nothing is read before an action, and column pruning and filters reach
the Parquet scan because only projections and equi-joins are used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import days, hours
from tidemark.functions.fixed import fixed_rows
from tidemark.session import tune

EXPERIMENTS = [
    # experiment_id, start_at, end_at, window days, eligibility rule, four metric roles
    ("exp_a", "2024-01-02", "2024-01-12", 7, "paywall_viewers", "trial_start_conversion_7d",
     "paid_conversion_14d", "revenue_per_assigned_user_30d", "cancellation_or_expiry_30d"),
    ("exp_b", "2023-12-22", "2024-01-15", 14, "new_signups", "onboarding_completion_48h",
     "activation_48h", "trial_start_conversion_14d", "d7_return_rate"),
    ("exp_c", "2024-01-05", "2024-01-25", 14, "onboarded_session_users", "ai_assistant_use_7d",
     "return_session_7d", "trial_start_conversion_14d", "overall_feature_use_7d"),
]


class Warehouse:
    """The eight logical datasets plus their experiment configuration, over one Parquet directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = tune(spark)
        self.path = path.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One Parquet table; files are listed and the schema read once per warehouse."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def installations(self) -> DataFrame:
        c = self.table("customer")
        n = self.table("nation").select("n_nationkey", F.col("n_name").alias("country_code"))
        key = F.col("c_custkey")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            key.cast("long").alias("installation_id"),
            F.concat(F.lit("anon_"), key.cast("string")).alias("anonymous_id"),
            (F.expr("TIMESTAMP_NTZ'2023-12-20 00:00:00'") + hours(((key * 37) % 600).cast("int"))).alias("installed_at"),
            F.when(key % 2 == 0, "ios").otherwise("android").alias("platform"),
            F.col("c_mktsegment").alias("acquisition_channel"),
            "country_code",
        )

    @cached_property
    def users(self) -> DataFrame:
        i = F.col("installation_id")
        after = lambda h: F.col("installed_at") + hours((i % 48 + h).cast("int"))
        return self.installations.where(i % 8 != 7).select(
            i.alias("user_id"),
            "installation_id",
            "anonymous_id",
            after(0).alias("signed_up_at"),
            F.when(i % 9 != 0, after(1)).alias("onboarding_started_at"),
            F.when((i % 9 != 0) & (i % 3 != 0), after(3)).alias("onboarding_completed_at"),
        )

    @cached_property
    def raw_events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def product_events(self) -> DataFrame:
        e = self.raw_events
        u = self.users.select("user_id", "signed_up_at")
        eid, kind = F.col("event_id"), F.col("event_type")
        # Users are unique by id, so the event side is the only one that can be skewed; a left join lets
        # adaptive execution split it.
        typed = e.select(
            eid,
            F.col("ts").alias("occurred_at"),
            F.col("user_id").alias("installation_id"),
            F.when(kind == "view", "session_started").when(kind == "click", "feature_used")
            .when(kind == "signup", "paywall_viewed").when(kind == "error", "payment_failed")
            .when(eid % 3 == 0, "trial_started").when(eid % 3 == 1, "subscription_started")
            .otherwise("cancellation_requested").alias("event_name"),
            F.when(kind == "click", F.concat(F.lit("feature_"), (eid % 5).cast("string"))).alias("feature_name"),
            F.concat_ws("_", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"),
        )
        known = (typed.installation_id == u.user_id) & (typed.occurred_at >= u.signed_up_at)
        return typed.join(u, known, "left").select(
            "event_id", "occurred_at", "installation_id", "user_id", "event_name", "feature_name", "session_id")

    @cached_property
    def trials(self) -> DataFrame:
        uid = F.col("user_id")
        start = F.expr("TIMESTAMP_NTZ'2024-01-03 06:00:00'") + hours(((uid * 31) % 480).cast("int"))
        annual = uid % 5 == 0
        return self.users.where(F.col("signed_up_at") <= start).select(
            uid.alias("subscription_id"),
            uid,
            "installation_id",
            F.when(annual, "annual").otherwise("monthly").alias("billing_period"),
            F.when(annual, F.lit("99.99")).otherwise(F.lit("11.99")).cast("decimal(18,2)").alias("price_gbp"),
            start.alias("trial_started_at"),
            (start + days(7)).alias("trial_ends_at"),
            F.when(uid % 3 == 0, start + days(7)).alias("subscription_started_at"),
        )

    @cached_property
    def paid_subscriptions(self) -> DataFrame:
        day = F.col("o_orderdate")
        return self.table("orders").select(
            F.col("o_orderkey").alias("subscription_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_custkey").alias("installation_id"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "annual").otherwise("monthly").alias("billing_period"),
            day.alias("subscription_started_at"),
            F.when(F.col("o_orderstatus") == "F", day + days(((F.col("o_orderkey") * 13) % 500).cast("int"))).alias("expired_at"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        l = self.table("lineitem")
        o = self.table("orders").select("o_orderkey", "o_custkey")
        return l.join(o, l.l_orderkey == o.o_orderkey).select(
            F.col("l_orderkey").alias("subscription_id"),
            F.col("l_linenumber").alias("billing_cycle_number"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_shipdate").alias("attempted_at"),
            F.when(F.col("l_linenumber") == 1, "initial_charge").otherwise("renewal").alias("transaction_type"),
            F.when(F.col("l_returnflag") == "R", "failed").otherwise("succeeded").alias("payment_status"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("amount_gbp"),
        )

    @cached_property
    def event_payments(self) -> DataFrame:
        eid = F.col("event_id")
        return self.raw_events.where((F.col("event_type") == "purchase") & (eid % 3 == 1)).select(
            eid.alias("transaction_id"),
            "user_id",
            F.col("ts").alias("attempted_at"),
            F.when(eid % 7 == 0, "failed").otherwise("succeeded").alias("payment_status"),
            F.when(eid % 4 == 0, F.lit("99.99")).otherwise(F.lit("11.99")).cast("decimal(18,2)").alias("amount_gbp"),
        )

    @cached_property
    def marketing_spend(self) -> DataFrame:
        """Weekly spend, impressions and clicks per channel, from the recorded events of the channel's users.

        The recorded value of a purchase event stands for money; views are impressions and clicks are clicks.
        """
        kind = F.col("event_type")
        seen = self.raw_events.join(self.installations.select(F.col("installation_id").alias("user_id"), "acquisition_channel"), "user_id")
        return seen.groupBy(F.trunc("ts", "WEEK").alias("period_start"), "acquisition_channel").agg(
            F.coalesce(F.sum(F.when(kind == "purchase", F.col("value").cast("decimal(18,2)"))), F.lit(0)).cast("decimal(18,2)").alias("spend"),
            F.count_if(kind == "view").cast("int").alias("impressions"), F.count_if(kind == "click").cast("int").alias("clicks"),
        ).where("period_start is not null").select("period_start", F.date_add("period_start", 6).alias("period_end"), "acquisition_channel", "spend", "impressions", "clicks")

    @cached_property
    def experiments(self) -> DataFrame:
        rows = fixed_rows(self.spark, EXPERIMENTS, [
            "experiment_id", "start_at", "end_at", "analysis_window_days", "eligibility_rule",
            "primary_metric", "secondary_metric", "commercial_metric", "guardrail_metric"])
        return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_at", "end_at")})

    @cached_property
    def experiment_assignments(self) -> DataFrame:
        from tidemark.operators.experiments import draw_variant, trigger_assignments

        picked = trigger_assignments(self.users, self.product_events, self.experiments)
        return draw_variant(picked).select(
            "assignment_id", "experiment_id", "user_id", "installation_id", "assignment_at", "exposed_at", "variant",
            "allocation_probability")
