"""Physical plans with every broadcast switched off, as if no side were small."""

import pytest

import __spark_entry__ as contract

QUERIES = contract.queries()


@pytest.fixture()
def no_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "trial_conversion_cohorts", "daily_product_kpis", "weekly_acquisition_performance", "experiment_candidates", "experiment_assignment_outcomes",
    "trial_features", "dq_referential", "build_reconciliation", "snapshot_audit", "overview_funnel", "fact_product_event", "interval_counts", "binary_outcome_counts"])
def test_no_cross_join_and_no_python_workers(name, no_broadcast, sf_dir):
    plan = plan_of(QUERIES[name](no_broadcast, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in plan


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = plan_of(QUERIES["observation_cutoff"](spark, sf_dir))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan
    plan = plan_of(QUERIES["retention_summary"](spark, sf_dir))
    assert "o_totalprice" not in plan


def test_prefix_moves_rows_once(no_broadcast, sf_dir):
    df = QUERIES["surrogate_keys"](no_broadcast, sf_dir)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(__k") <= 2 and "CartesianProduct" not in final
