import datetime as dt
from decimal import Decimal

import pytest

from tidemark.operators import marts, quality, reports, star
from tidemark.operators.registry import metric_registry
from tidemark.sources.contracts import Contract, Field
from tidemark.sources.layers import RULES, layers
from tidemark.sources.tables import Warehouse

T = dt.datetime


def test_maturity_boundaries(spark):
    cutoff = spark.createDataFrame([(T(2024, 3, 1),)], "observation_cutoff_at timestamp_ntz")
    inst = spark.createDataFrame([(1, "ios", "organic")], "installation_id long, platform string, acquisition_channel string")
    trials = spark.createDataFrame(
        [(1, T(2024, 2, 20), T(2024, 3, 1), T(2024, 3, 1), "monthly"), (1, T(2024, 2, 21), T(2024, 3, 1, 0, 0, 1), None, "monthly"),
         (1, T(2024, 2, 1), T(2024, 2, 8), T(2024, 3, 2), "monthly")],
        "installation_id long, trial_started_at timestamp_ntz, trial_ends_at timestamp_ntz, subscription_started_at timestamp_ntz, billing_period string")
    row = marts.trial_conversion_cohorts(trials, inst, cutoff).first()
    # Ending exactly at the cutoff is mature; a conversion after the cutoff has not been observed.
    assert (row.trial_count, row.mature_trial_count, row.immature_trial_count, row.mature_trial_paid_conversion_count) == (3, 2, 1, 1)
    assert row.trial_to_paid_conversion_rate == 0.5


def test_retention_needs_survival_beyond_the_horizon(spark):
    cutoff = spark.createDataFrame([(T(2024, 3, 31),)], "observation_cutoff_at timestamp_ntz")
    inst = spark.createDataFrame([(1, "ios", "organic")], "installation_id long, platform string, acquisition_channel string")
    subs = spark.createDataFrame(
        [(1, T(2024, 3, 1), T(2024, 3, 31)), (2, T(2024, 3, 1), T(2024, 3, 31, 0, 0, 1)), (3, T(2024, 3, 2), None), (4, None, None)],
        "subscription_id long, subscription_started_at timestamp_ntz, expired_at timestamp_ntz").selectExpr(
        "*", "1L user_id", "1L installation_id", "'monthly' billing_period")
    got = {r.subscription_id: (r.eligible_d30, r.retained_d30, r.eligible_d90) for r in marts.paid_retention_base(subs, inst, cutoff).collect()}
    assert got == {1: (True, False, False), 2: (True, True, False), 3: (False, False, False)}
    row = marts.paid_retention_cohorts(marts.paid_retention_base(subs, inst, cutoff)).first()
    assert row.mature_d30_count == 2 and row.paid_retention_d30 == 0.5 and row.paid_retention_d90 is None


def test_builds_keep_their_own_cutoff(spark):
    events = spark.createDataFrame([(1, T(2024, 1, 1)), (1, T(2024, 2, 1)), (2, T(2024, 6, 1))], "build long, occurred_at timestamp_ntz")
    cut = marts.observation_cutoff(events, ["build"])
    inst = spark.createDataFrame([(1, 1, "ios", "a"), (2, 1, "ios", "a")], "build long, installation_id long, platform string, acquisition_channel string")
    trials = spark.createDataFrame([(1, 1, T(2024, 1, 1), T(2024, 3, 1), None, "monthly"), (2, 1, T(2024, 1, 1), T(2024, 3, 1), None, "monthly")],
                                   "build long, installation_id long, trial_started_at timestamp_ntz, trial_ends_at timestamp_ntz, subscription_started_at timestamp_ntz, billing_period string")
    got = {r.build: r.mature_trial_count for r in marts.trial_conversion_cohorts(trials, inst, cut, ["build"]).collect()}
    assert got == {1: 0, 2: 1}


def test_revenue_rates_are_null_without_attempts_and_days_are_whole(spark):
    tx = spark.createDataFrame([(T(2024, 1, 1, 5), "renewal", "failed", Decimal("5.00")), (T(2024, 1, 3), "initial_charge", "succeeded", Decimal("0.10"))],
                               "attempted_at timestamp_ntz, transaction_type string, payment_status string, amount_gbp decimal(18,2)")
    cal = marts.date_dimension(marts.day_bounds((tx, "attempted_at")))
    rows = {r.full_date.day: r for r in marts.daily_subscription_revenue(cal, tx).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].payment_failure_rate == 1.0 and rows[1].renewal_success_rate == 0.0
    assert rows[2].payment_failure_rate is None and rows[2].payment_attempt_count == 0
    assert rows[3].renewal_success_rate is None and rows[3].successful_payment_revenue_gbp == 0.1


def test_overlapping_spend_periods_count_twice_and_ctr_stays_null(spark):
    D = dt.date
    spend = spark.createDataFrame([(D(2024, 1, 1), D(2024, 1, 7), "a", 10.0, None, None), (D(2024, 1, 7), D(2024, 1, 9), "a", 4.0, 100, 5), (D(2024, 1, 1), D(2024, 1, 2), "b", 1.0, 0, 0)],
                                  "period_start date, period_end date, acquisition_channel string, spend double, impressions int, clicks int")
    life = spark.createDataFrame([("a", D(2024, 1, 7), True), ("a", D(2024, 1, 9), False)], "acquisition_channel string, installed_date date, has_signup boolean")
    rows = {(r.acquisition_channel, r.period_start.day): r for r in marts.weekly_acquisition_performance(spend, life).collect()}
    assert rows["a", 1].installation_count == 1 and rows["a", 7].installation_count == 2
    assert rows["a", 1].click_through_rate is None and rows["a", 7].click_through_rate == 0.05 and rows["b", 1].cost_per_install_gbp is None
    ch = {r.acquisition_channel: r for r in reports.channel_performance(marts.weekly_acquisition_performance(spend, life)).collect()}
    assert ch["a"].installation_count == 3 and ch["b"].cost_per_click_gbp is None


def test_leaders_break_ties_by_name(spark):
    df = spark.createDataFrame([("a", 5, 0.0), ("b", 5, 2.0), ("c", 1, 1.0)], "n string, v long, c double")
    got = {r.highlight: r.leader for r in reports.leaders(df, "n", [("hi", "v", True), ("lo", "c", False)]).collect()}
    assert got == {"hi": "b", "lo": "c"}


def test_registry_refuses_unsupported(spark):
    reg = metric_registry(spark)
    assert reg.count() == 39
    reports.require_supported(spark.createDataFrame([("session_count",)], "metric_key string"), reg)
    with pytest.raises(reports.UnsupportedMetric, match="activation_48h .deferred., nope .unknown."):
        reports.require_supported(spark.createDataFrame([("activation_48h",), ("nope",), ("session_count",)], "metric_key string"), reg)


def test_quality_counts(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, " y"), (None, "")], "k long, s string")
    assert quality.duplicates(df, ["k"]).first()[0] == 3  # NULL keys count as duplicates
    c = Contract("t", "k", (Field("k", "integer", low=2), Field("s", allowed=("x",))))
    assert df.where(quality.null_violation(c)).count() == 2 and df.where(quality.domain_violation(c)).count() == 4
    parent = spark.createDataFrame([(1,)], "k long")
    assert quality.unmatched(df.where("k is not null"), parent, ["k"]).first()[0] == 0


def test_lineage_mismatch_does_not_multiply_repeated_keys(spark):
    s = spark.createDataFrame([(1, "a", 2, "h1", 1), (1, "b", 3, "h2", 1), (1, "c", 4, "h3", 1)],
                              "ingestion_batch_id long, id string, source_row_number long, row_hash string, validation_run_id long")
    a = spark.createDataFrame([(1, "a", 2, "h1", 1), (1, "b", 3, "zz", 1), (1, "b", 3, "h2", 1)], s.schema)
    row = star.lineage_reconciliation({"t": s}, {"t": a}, {"t": "id"}).first()
    assert (row.staging_row_count, row.matched_analytics_rows, row.missing_analytics_rows, row.lineage_mismatches) == (3, 2, 1, 1)


def test_compiled_relations_equal_one_check_at_a_time(spark):
    """Missing, null and repeated parents, differing other columns, times before one of several parents."""
    parents = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (1, "b", 30), (2, "c", 5), (3, None, None), (4, "d", 1)], "installation_id long, anonymous_id string, installed_at int")
    child = spark.createDataFrame([(1, "a", 20), (1, "b", 5), (1, "z", 40), (2, "c", 1), (2, None, 9), (3, None, 1), (4, "d", None), (9, "a", 1), (None, "a", 1)] * 3,
                                  "installation_id long, anonymous_id string, signed_up_at int")
    tables = {"users": child, "installations": parents}
    references = [r for r in quality.REFERENCES if r[:2] == ("users", "installations")]
    floors = [f for f in quality.FLOORS if f[:2] == ("users", "installations")]
    got = {r.check_name: r.violation_count for r in quality.related(tables, references, floors).collect()}
    for _, _, keys, check in references:
        assert got[check] == quality.unmatched(child, parents, keys).first()[0], check
    pairs = child.join(parents, "installation_id").where("signed_up_at < installed_at").count()
    assert got[floors[0][-1]] == pairs > 0


def test_uniqueness_of_all_keys_in_one_pass(spark):
    users = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (None, 3), (None, 3)], "user_id long, installation_id long")
    got = {r.check_name: r.violation_count for r in quality.uniqueness({"users": users}, {"users": RULES["users"]}).collect()}
    assert got == {"users_user_id_unique": 3, "users_installation_id_unique": 2}
    assert got["users_user_id_unique"] == quality.duplicates(users, ["user_id"]).first()[0]


def test_compiled_catalogue_reads_each_dataset_for_rows_and_keys_once(spark, sf_dir):
    t = layers(Warehouse(spark, sf_dir)).raw
    parts = quality.compiled(t, RULES)
    names = [r.check_name for p in parts for r in p.select("check_name").collect()]
    assert len(names) == len(set(names)) == 8 + 8 + 13 + 13 + 11
    plan = parts[2]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 6
