"""Quality catalogue, star build, layer checks and event helpers bound to the warehouse tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import days
from tidemark.functions.pin import pin
from tidemark.operators import actives, events as ev
from tidemark.operators import experiments as ex
from tidemark.operators import marts, quality, reporting_checks as rc, star
from tidemark.operators.registry import metric_registry
from tidemark.plans import experiment_queries as eq
from tidemark.plans import mart_queries as mq
from tidemark.sources import Warehouse
from tidemark.sources.stored import StoredTables
from tidemark.sources.layers import BATCH, RULES, layers

KEYS = {n: c.key for n, c in RULES.items()}
DATED_COLUMNS = {
    "installations": ["installed_at"], "users": ["signed_up_at", "onboarding_started_at", "onboarding_completed_at"],
    "product_events": ["occurred_at"], "subscription_transactions": ["attempted_at"], "experiment_assignments": ["assignment_at"],
}


def raw(w: Warehouse) -> StoredTables:
    return layers(w).raw


def staging(w: Warehouse) -> StoredTables:
    return layers(w).staging


def built(w: Warehouse) -> StoredTables:
    return layers(w).star


def raw_files(w: Warehouse, datasets: Iterable[str] = tuple(RULES)) -> DataFrame:
    """Rows per dataset as the delivery holds them, and as the stored raw table's rows pass or break the row rules.

    Only the raw tables of ``datasets`` are read, and written if they were not.
    """
    bad = lambda n: quality.row_violation(RULES[n])
    announced = lambda n: layers(w).delivered[n].agg(F.count(F.lit(1))).scalar()
    return quality.stacked([df.agg(F.count_if(~bad(n)).alias("accepted_row_count"), F.count_if(bad(n)).alias("rejected_row_count")).select(
        F.lit(BATCH).cast("long").alias("ingestion_batch_id"), F.lit(n).alias("dataset_name"), F.lit("loaded").alias("status"), announced(n).alias("expected_row_count"), "*")
        for n, df in ((n, raw(w)[n]) for n in datasets)])


def staging_recon(w: Warehouse) -> DataFrame:
    return star.layer_reconciliation(raw(w).counts("raw_row_count"), staging(w).counts("staging_row_count"), "raw_row_count", "staging_row_count")


def analytics_recon(w: Warehouse) -> DataFrame:
    return star.layer_reconciliation(staging(w).counts("staging_row_count"), built(w).counts("analytics_row_count", star.DATASET_OF), "staging_row_count", "analytics_row_count")


def lineage(w: Warehouse) -> DataFrame:
    return star.lineage_by_digest(staging(w), built(w), KEYS)


def table(name: str, w: Warehouse) -> DataFrame:
    """One star table; decimals leave as double and the hash stays inside."""
    df = built(w)[name]
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes if c not in ("row_hash", "leaf")])


def entity_counts(w: Warehouse) -> DataFrame:
    """Events against entities, counted over the delivered rows: the raw tables hold the same rows, but six counts need none of them stored or hashed."""
    return quality.event_entity_counts(layers(w).delivered)


def all_checks(w: Warehouse) -> DataFrame:
    """The whole raw catalogue: row reconciliation, events against entities, keys, references, time order, nulls, domains."""
    t = raw(w)
    recon = star.raw_reconciliation(raw_files(w), staging(w).counts("actual_row_count")).select(
        "dataset_name", F.lit("reconciliation").alias("category"), F.concat("dataset_name", F.lit("_raw_reconciliation")).alias("check_name"),
        F.when(F.col("reconciled"), 0).otherwise(1).cast("long").alias("violation_count"))
    return quality.check_results([
        recon, quality.event_entity_counts(t), quality.event_timestamp_match(t), *quality.compiled(t, RULES)])


def bounds(w: Warehouse) -> DataFrame:
    """Everything must lie before the end of the observed day range of the events."""
    t = {n: raw(w)[n] for n in DATED_COLUMNS}
    last = mq.cutoff(w).select(F.col("observation_cutoff_at") - days(3)).scalar()
    return quality.snapshot_bounds(t, last, DATED_COLUMNS, raw_files(w, DATED_COLUMNS))


def authorisation(w: Warehouse) -> DataFrame:
    """Yearly order deliveries: a year is validated when its orders all have a price, promoted when none is pending."""
    o = w.table("orders").select(F.year("o_orderdate").cast("long").alias("ingestion_batch_id"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    # One pass over the orders; the audit frames are a few rows per year.
    per = o.groupBy("ingestion_batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") < 1100).alias("cheap"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
        F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"))
    status = lambda c: F.when(c, "succeeded").otherwise("failed").alias("status")
    batches = per.select("ingestion_batch_id", status(F.col("low") > 0))
    validations = per.select("ingestion_batch_id", status(F.col("cheap") == 0))
    promotions = per.select("ingestion_batch_id", status(F.col("pending") > 0), F.col("n").alias("expected_row_count"), F.col("n").alias("promoted_row_count"))
    recon = o.groupBy("ingestion_batch_id", F.col("o_orderstatus").alias("dataset_name")).agg(F.count(F.lit(1)).alias("staging_row_count")).withColumn("reconciled", F.lit(True))
    return star.build_authorisation(batches, validations, promotions, recon, 3)


def reporting(w: Warehouse) -> DataFrame:
    """Marts against their sources: grain, totals and maturity."""
    c, n = F.col, F.count(F.lit(1))
    life, daily, revenue, weekly = mq.lifecycle(w), mq.daily_product(w), mq.daily_revenue(w), mq.weekly_acquisition(w)
    outcomes = pin(eq.outcomes(w).select("assignment_id", "experiment_id", "variant", "is_exposed"))
    summary = outcomes.groupBy("experiment_id", "variant").agg(n.alias("a"), F.count_if("is_exposed").alias("e"))
    name, ok, failed = c("event_name"), c("payment_status") == "succeeded", c("payment_status") == "failed"
    spec = {
        "src_install": (w.installations, {"n": n}),
        "src_user": (w.users, {"n": n, "started": F.count("onboarding_started_at"), "completed": F.count("onboarding_completed_at")}),
        "src_event": (w.product_events, {"started": F.count_if(name == "onboarding_started"), "completed": F.count_if(name == "onboarding_completed"),
                                         "feature": F.count_if((name == "feature_used") & c("feature_name").isNotNull())}),
        "src_pay": (w.transactions, {"n": n, "ok": F.count_if(ok), "failed": F.count_if(failed), "money": F.sum(F.when(ok, c("amount_gbp")))}),
        "src_spend": (w.marketing_spend, {"n": n, "money": F.sum("spend")}),
        "src_trial": (w.trials, {"n": n}), "src_paid": (w.paid_subscriptions, {"n": n}),
        "src_assign": (w.experiment_assignments, {"n": n, "exposed": F.count("exposed_at")}),
        "life": (life, {"n": n, "keys": F.count_distinct("installation_id")}),
        "daily": (daily, {"n": n, "dates": F.count_distinct("full_date"), "install": F.sum("installation_count"), "signup": F.sum("signup_count"),
                          "started": F.sum("onboarding_started_count"), "completed": F.sum("onboarding_completed_count")}),
        "revenue": (revenue, {"n": n, "dates": F.count_distinct("full_date"), "attempts": F.sum("payment_attempt_count"), "ok": F.sum("successful_payment_count"),
                              "failed": F.sum("failed_payment_count"), "money": F.sum(c("successful_payment_revenue_gbp").cast("decimal(28,2)"))}),
        "weekly": (weekly, {"n": n, "money": F.sum(c("marketing_spend_gbp").cast("decimal(28,2)")), "install": F.sum("installation_count"), "signup": F.sum("installations_with_signup")}),
        "features": (mq.features(w), {"n": F.sum("feature_use_event_count")}),
        "trial": (mq.trial_cohorts(w), {"n": F.sum("trial_count")}),
        "paid": (mq.retention_base(w), {"n": n}),
        "outcome": (outcomes, {"n": n, "keys": F.count_distinct("assignment_id"), "exposed": F.count_if("is_exposed")}),
        "summary": (summary, {"a": F.sum("a"), "e": F.sum("e")}),
        "build": (star.raw_reconciliation(raw_files(w), staging(w).counts("actual_row_count")), {"ok": F.min(c("reconciled").cast("int"))}),
        "registry": (metric_registry(w.spark), {"n": n, **{s: F.count_if(c("support_status") == s) for s in ("supported", "deferred", "unsupported")}}),
        "rates": (rates(w), {"bad": F.sum("violation_count")}),
        "maturity": (rc.retention_consistency(mq.retention_base(w), marts.HORIZONS), {"bad": F.sum("violation_count")}),
    }
    checks = [
        ("analytics_build_succeeded", "build.ok", "1"), ("metric_definition_count", "registry.n", "39"), ("supported_metric_count", "registry.supported", "30"),
        ("deferred_metric_count", "registry.deferred", "5"), ("unsupported_metric_count", "registry.unsupported", "4"),
        ("installation_lifecycle_row_count", "life.n", "src_install.n"), ("installation_lifecycle_unique_grain", "life.keys", "life.n"),
        ("daily_product_date_grain", "daily.dates", "daily.n"), ("daily_revenue_date_grain", "revenue.dates", "revenue.n"),
        ("experiment_assignment_outcome_unique_grain", "outcome.keys", "outcome.n"),
        ("product_installations_reconcile", "daily.install", "src_install.n"), ("product_signups_reconcile", "daily.signup", "src_user.n"),
        ("product_onboarding_started_reconcile", "daily.started", "src_event.started"), ("product_onboarding_completed_reconcile", "daily.completed", "src_event.completed"),
        ("payment_attempts_reconcile", "revenue.attempts", "src_pay.n"), ("successful_payments_reconcile", "revenue.ok", "src_pay.ok"),
        ("failed_payments_reconcile", "revenue.failed", "src_pay.failed"), ("successful_payment_revenue_reconcile", "revenue.money", "src_pay.money"),
        ("marketing_row_count_reconcile", "weekly.n", "src_spend.n"), ("marketing_spend_reconcile", "weekly.money", "src_spend.money"),
        ("acquisition_installations_reconcile", "weekly.install", "src_install.n"), ("acquisition_signups_reconcile", "weekly.signup", "src_user.n"),
        ("feature_events_reconcile", "features.n", "src_event.feature"), ("trial_rows_reconcile", "trial.n", "src_trial.n"),
        ("paid_retention_base_reconcile", "paid.n", "src_paid.n"), ("experiment_outcomes_reconcile", "outcome.n", "src_assign.n"),
        ("experiment_exposures_reconcile", "outcome.exposed", "src_assign.exposed"), ("experiment_summary_assignments_reconcile", "summary.a", "src_assign.n"),
        ("experiment_summary_exposures_reconcile", "summary.e", "src_assign.exposed"),
        ("reporting_rate_bounds", "rates.bad", "0"), ("retention_maturity_consistency", "maturity.bad", "0"),
    ]
    return rc.reporting_checks(spec, checks)


def rates(w: Warehouse) -> DataFrame:
    return rc.rate_bounds({
        "installation_cohort_funnel": (mq.install_funnel(w), ["install_to_signup_rate"]),
        "signup_cohort_funnel": (mq.signup_funnel(w), ["onboarding_start_rate", "onboarding_completion_rate"]),
        "weekly_acquisition_performance": (mq.weekly_acquisition(w), ["install_to_signup_rate", "click_through_rate"]),
        "trial_conversion_cohorts": (mq.trial_cohorts(w), ["trial_to_paid_conversion_rate"]),
        "paid_retention_cohorts": (mq.retention(w), [f"paid_retention_d{n}" for n in marts.HORIZONS]),
        "daily_subscription_revenue": (mq.daily_revenue(w), ["payment_failure_rate", "renewal_success_rate"]),
        "experiment_variant_summary": (ex.variant_summary(eq.outcomes(w)), ["exposure_rate", "onboarding_completion_48h_rate", "overall_feature_use_7d_rate",
                                                                           "trial_start_conversion_7d", "paid_conversion_14d", "cancellation_or_expiry_30d_rate"]),
    })


def cutoffs(w: Warehouse) -> DataFrame:
    day = F.to_date("ts")
    key = (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("long")
    tagged = w.raw_events.select(F.col("ts").alias("occurred_at"), key.alias("ingestion_batch_id"), key.alias("analytics_build_run_id"))
    return rc.cutoff_exact(tagged, mq.daily_contexts(w), ["ingestion_batch_id", "analytics_build_run_id"])


def trial_intervals(w: Warehouse) -> DataFrame:
    spans = w.trials.select(F.col("subscription_id").alias("interval_id"), "user_id", F.col("trial_started_at").alias("from_at"), F.col("trial_ends_at").alias("until_at"))
    return ev.interval_counts(spans, w.product_events)


def merged(w: Warehouse) -> DataFrame:
    c = F.col
    observed = w.product_events.select("occurred_at", "installation_id", "event_name", "session_id", "feature_name", c("event_id").alias("source_id"))
    entity = lambda df, key, at, name: df.where(c(at).isNotNull()).select(
        c(at).alias("occurred_at"), "installation_id", F.lit(name).alias("event_name"), F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("feature_name"), c(key).alias("source_id"))
    return ev.merge_events(observed, entity(w.installations, "installation_id", "installed_at", "app_install"), entity(w.users, "user_id", "signed_up_at", "signup"),
                           entity(w.users, "user_id", "onboarding_started_at", "onboarding_started"), entity(w.users, "user_id", "onboarding_completed_at", "onboarding_completed"))


def dense(w: Warehouse) -> DataFrame:
    return star.dense_keys(staging(w)["product_events"].select("event_id", "source_row_number")).select("event_id", "surrogate_key")


def verdicts(w: Warehouse) -> DataFrame:
    return star.analytics_checks(analytics_recon(w), lineage(w))


def event_bitmaps(w: Warehouse) -> DataFrame:
    return pin(actives.daily_bitmaps(w.product_events.select("installation_id", "occurred_at", "event_name"), "installation_id", F.col("occurred_at"), ["event_name"]))


QUERIES = {
    "active_counts": lambda w: actives.active_counts(event_bitmaps(w), ["event_name"]),
    "trailing_actives": lambda w: actives.trailing_actives(event_bitmaps(w), 7, ["event_name"]),
    "raw_counts": lambda w: raw(w).counts("actual_row_count"),
    "raw_reconciliation": lambda w: star.raw_reconciliation(raw_files(w), staging(w).counts("actual_row_count")),
    "staging_reconciliation": staging_recon,
    "analytics_reconciliation": analytics_recon,
    "lineage_reconciliation": lineage,
    "dq_check_results": all_checks,
    "dq_event_entity_counts": entity_counts,
    "dq_event_timestamp_match": lambda w: quality.event_timestamp_match(raw(w)),
    "dq_uniqueness": lambda w: quality.uniqueness(raw(w), RULES),
    "dq_referential": lambda w: quality.referential(raw(w)),
    "dq_chronology": lambda w: quality.chronology(raw(w)),
    "dq_nullability": lambda w: quality.nullability(raw(w), RULES),
    "dq_domain": lambda w: quality.domains(raw(w), RULES),
    "dq_snapshot_bounds": bounds,
    "dim_date": lambda w: star.dim_date(staging(w)),
    **{t: partial(table, t) for t in ("dim_installation", "dim_user", "dim_experiment", "dim_app_release", "fact_product_event", "fact_subscription",
                                      "fact_subscription_transaction", "fact_experiment_assignment", "fact_marketing_spend")},
    "surrogate_keys": dense,
    "build_authorisation": authorisation,
    "build_reconciliation": lambda w: star.build_reconciliation(analytics_recon(w), staging(w)["experiment_assignments"], built(w)["dim_experiment"]),
    "analytics_checks": verdicts,
    "relationship_checks": lambda w: star.relationship_checks(staging(w), built(w), KEYS),
    "date_key_checks": lambda w: star.date_key_checks(built(w), star.dim_date(staging(w))),
    "build_control_check": lambda w: star.build_control_check(analytics_recon(w), built(w)["dim_experiment"], len(built(w)) + 1),
    "reporting_checks": reporting,
    "rate_bounds": rates,
    "retention_consistency": lambda w: rc.retention_consistency(mq.retention_base(w), marts.HORIZONS),
    "cutoff_exact": cutoffs,
    "prior_activity": lambda w: ev.prior_activity(w.product_events),
    "interval_counts": trial_intervals,
    "merge_events": merged,
    "weekly_spine": lambda w: ev.weekly_spine(marts.day_bounds((w.installations, "installed_at"))),
}
