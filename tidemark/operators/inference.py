"""Inference for many experiments and metrics in one pass: guards, tests, intervals, resampling, multiplicity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import count_when, rate
from tidemark.functions.normal import erfc, two_sided_p, z_quantile
from tidemark.operators.registry import BINARY_METRICS, CONTINUOUS_METRICS
from tidemark.operators.resampling import resampled_sums

ROLES = ("primary", "secondary", "commercial", "guardrail")
SRM_ALPHA = 0.001


# --- plan and guards ------------------------------------------------------------------------------------

def metric_plan(assignments: DataFrame, experiments: DataFrame, registry: DataFrame) -> DataFrame:
    """Four metric roles per experiment that has assignments, each with its support and inference status."""
    running = assignments.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("assigned_user_count"))
    roles = F.array(*[F.struct(F.lit(r).alias("metric_role"), F.col(f"{r}_metric").alias("metric_key")) for r in ROLES])
    key = F.col("metric_key")
    status = (
        F.when(F.col("known_status").isNull(), "excluded_unknown_metric_contract")
        .when(F.col("known_status") != "supported", F.concat(F.lit("excluded_"), F.col("known_status")))
        .when(key.isin(*BINARY_METRICS), "ready_binary")
        .when(key.isin(*CONTINUOUS_METRICS), "pending_continuous_inference")
        .otherwise("excluded_no_inference_binding")
    )
    known = registry.select("metric_key", "metric_unit", F.col("support_status").alias("known_status"))
    return (
        running.join(experiments, "experiment_id")
        .select("experiment_id", "assigned_user_count", F.inline(roles))
        .join(known, "metric_key", "left")
        .select("experiment_id", "metric_role", "metric_key", "metric_unit", "assigned_user_count",
                F.coalesce("known_status", F.lit("unknown")).alias("support_status"), status.alias("inference_status"))
    )


def experiment_guards(outcomes: DataFrame, lineage: Sequence[str] = ("observation_cutoff_at",)) -> DataFrame:
    """One lineage, exactly the arms control and treatment, and only mature windows; counts of what violates it."""
    arm = F.lower(F.trim("variant"))
    arms = F.count_distinct(arm)
    foreign = count_when(~arm.isin("control", "treatment") | arm.isNull())
    immature = count_when(~F.coalesce(F.col("analysis_window_mature"), F.lit(False)))
    no_lineage = count_when(F.greatest(*[F.col(c).isNull() for c in lineage]) if len(lineage) > 1 else F.col(lineage[0]).isNull())
    lineages = F.count_distinct(F.struct(*lineage))
    return outcomes.groupBy("experiment_id").agg(
        arms.alias("arm_count"), foreign.alias("unexpected_arm_rows"), immature.alias("immature_rows"),
        lineages.alias("lineage_count"), no_lineage.alias("missing_lineage_rows"),
    ).withColumns({
        "two_arms": (F.col("arm_count") == 2) & (F.col("unexpected_arm_rows") == 0),
        "one_lineage": (F.col("lineage_count") == 1) & (F.col("missing_lineage_rows") == 0),
        "all_mature": F.col("immature_rows") == 0,
    })


def _arm(name: str) -> Column:
    return F.col("variant") == name


def srm_check(assigned: DataFrame, alpha: float = SRM_ALPHA) -> DataFrame:
    """Chi-square of arm sizes against the configured allocation, one row per experiment."""
    per = assigned.groupBy("experiment_id").agg(
        count_when(_arm("control")).alias("control_count"), count_when(_arm("treatment")).alias("treatment_count"),
        F.max(F.when(_arm("control"), F.col("allocation_probability"))).alias("control_allocation"),
        F.max(F.when(_arm("treatment"), F.col("allocation_probability"))).alias("treatment_allocation"))
    total = (F.col("control_count") + F.col("treatment_count")).cast("double")
    return per.withColumns({
        "expected_control_count": total * F.col("control_allocation"),
        "expected_treatment_count": total * F.col("treatment_allocation"),
    }).withColumn(
        "chi_square",
        F.pow(F.col("control_count") - F.col("expected_control_count"), F.lit(2)) / F.col("expected_control_count")
        + F.pow(F.col("treatment_count") - F.col("expected_treatment_count"), F.lit(2)) / F.col("expected_treatment_count"),
    ).withColumn("p_value", erfc(F.sqrt(F.col("chi_square") / 2.0))).withColumn("mismatch_detected", F.col("p_value") < alpha)


# --- binary outcomes ------------------------------------------------------------------------------------

def binary_outcome_counts(outcomes: DataFrame, plan: DataFrame) -> DataFrame:
    """Mature population and successes per experiment, bound metric and arm.

    One aggregate counts every bound flag; the few aggregated rows are unpivoted afterwards.
    """
    mature = outcomes.where(F.col("analysis_window_mature"))
    counted = mature.groupBy("experiment_id", "variant").agg(
        F.count(F.lit(1)).alias("assigned_mature_count"),
        *[count_when(F.col(flag)).alias(metric) for metric, flag in BINARY_METRICS.items()])
    metrics = F.array(*[F.struct(F.lit(m).alias("metric_key"), F.col(m).alias("success_count")) for m in BINARY_METRICS])
    ready = plan.where(F.col("inference_status") == "ready_binary").select("experiment_id", "metric_key", "metric_role")
    return counted.select("experiment_id", "variant", "assigned_mature_count", F.inline(metrics)).join(
        ready, ["experiment_id", "metric_key"])


def arms_side_by_side(counts: DataFrame) -> DataFrame:
    pick = lambda arm, c: F.max(F.when(_arm(arm), F.col(c)))
    return counts.groupBy("experiment_id", "metric_key", "metric_role").agg(
        *[pick(arm, c).alias(f"{arm}_{short}") for arm in ("control", "treatment")
          for c, short in (("assigned_mature_count", "total"), ("success_count", "successes"))],
    ).where((F.col("control_total") > 0) & (F.col("treatment_total") > 0))


def passing_srm(outcomes: DataFrame) -> DataFrame:
    """Experiments whose mature arms fit the allocation; a mismatch blocks outcome inference."""
    return srm_check(outcomes.where(F.col("analysis_window_mature"))).where(~F.col("mismatch_detected")).select("experiment_id")


def blocked_metrics(outcomes: DataFrame, plan: DataFrame, alpha: float = SRM_ALPHA) -> DataFrame:
    """One row per planned metric with a verdict: the first reason that keeps its inference from being read, or NULL.

    Reasons: no mature user, an unexpected arm, a missing arm, an allocation that is missing or not inside (0, 1), a sample
    ratio mismatch, a metric the registry does not support.  Nothing that was planned is left out.
    """
    mature = F.coalesce(F.col("analysis_window_mature"), F.lit(False))
    known = F.col("variant").isin("control", "treatment")
    state = outcomes.groupBy("experiment_id").agg(
        count_when(mature).alias("mature_count"), count_when(mature & ~F.coalesce(known, F.lit(False))).alias("unexpected_arm_count"))
    srm = srm_check(outcomes.where(mature), alpha).select("experiment_id", "control_count", "treatment_count", "control_allocation", "treatment_allocation", "mismatch_detected")
    share = lambda arm: F.coalesce((F.col(f"{arm}_allocation") > 0) & (F.col(f"{arm}_allocation") < 1), F.lit(False))
    reason = (
        F.when(F.coalesce("mature_count", F.lit(0)) == 0, "no_mature_user").when(F.col("unexpected_arm_count") > 0, "unexpected_arm")
        .when(F.col("control_count") * F.col("treatment_count") == 0, "missing_arm").when(~(share("control") & share("treatment")), "invalid_allocation")
        .when(F.coalesce("mismatch_detected", F.lit(True)), "sample_ratio_mismatch")
        .when(~F.col("inference_status").isin("ready_binary", "pending_continuous_inference"), F.col("inference_status")))
    joined = plan.select("experiment_id", "metric_key", "metric_role", "inference_status").join(state, "experiment_id", "left").join(srm, "experiment_id", "left")
    return joined.select("experiment_id", "metric_key", "metric_role", F.coalesce("mature_count", F.lit(0)).alias("mature_count"), reason.alias("blocked_reason"))


def two_proportion_test(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pooled z-test of treatment minus control; no variance means z = 0 and p = 1."""
    n1, n2 = F.col("control_total").cast("double"), F.col("treatment_total").cast("double")
    x1, x2 = F.col("control_successes").cast("double"), F.col("treatment_successes").cast("double")
    sides = arms_side_by_side(counts).withColumns({"control_rate": x1 / n1, "treatment_rate": x2 / n2, "pooled": (x1 + x2) / (n1 + n2)})
    variance = F.col("pooled") * (1.0 - F.col("pooled")) * (1.0 / n1 + 1.0 / n2)
    effect = F.col("treatment_rate") - F.col("control_rate")
    tested = sides.withColumns({"absolute_effect": effect, "variance": variance}).withColumn(
        "z_statistic", F.when(F.col("variance") == 0.0, 0.0).otherwise(F.try_divide(F.col("absolute_effect"), F.sqrt("variance"))))
    return tested.withColumns({
        "relative_effect": F.try_divide(F.col("treatment_rate"), F.col("control_rate")) - 1.0,
        "p_value": F.when(F.col("variance") == 0.0, 1.0).otherwise(two_sided_p(F.col("z_statistic"))),
    }).withColumn("statistically_detectable", F.col("p_value") < alpha).drop("pooled", "variance")


def newcombe_interval(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Wilson score interval per arm, combined into an interval of the difference, clamped to [-1, 1]."""
    z = z_quantile(1.0 - alpha / 2.0)
    out = arms_side_by_side(counts)
    for arm in ("control", "treatment"):
        n, p = F.col(f"{arm}_total").cast("double"), F.col(f"{arm}_rate")
        out = out.withColumn(f"{arm}_rate", F.col(f"{arm}_successes").cast("double") / n)
        scale = 1.0 + z * z / n
        centre = (p + z * z / (2.0 * n)) / scale
        half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / scale
        out = out.withColumns({f"{arm}_low": F.greatest(F.lit(0.0), centre - half), f"{arm}_high": F.least(F.lit(1.0), centre + half)})
    effect = F.col("treatment_rate") - F.col("control_rate")
    below = F.sqrt(F.pow(F.col("treatment_rate") - F.col("treatment_low"), F.lit(2)) + F.pow(F.col("control_high") - F.col("control_rate"), F.lit(2)))
    above = F.sqrt(F.pow(F.col("treatment_high") - F.col("treatment_rate"), F.lit(2)) + F.pow(F.col("control_rate") - F.col("control_low"), F.lit(2)))
    return out.withColumns({
        "absolute_effect": effect,
        "confidence_interval_low": F.greatest(F.lit(-1.0), effect - below),
        "confidence_interval_high": F.least(F.lit(1.0), effect + above),
    })


# --- mean outcomes: resampling over distinct values -----------------------------------------------------------

def mature_values(outcomes: DataFrame, plan: DataFrame) -> DataFrame:
    """Per-user values of the planned mean metrics, in integer minor units so that every sum is exact."""
    (metric, column), = CONTINUOUS_METRICS.items()
    wanted = plan.where(F.col("metric_key") == metric).where(
        F.col("inference_status") == "pending_continuous_inference").select("experiment_id", "metric_key", "metric_role")
    return outcomes.where(F.col("analysis_window_mature")).join(wanted, "experiment_id").select(
        "experiment_id", "metric_key", "metric_role", "assignment_id", "variant",
        F.round(F.col(column) * 100).cast("long").alias("minor_units"))


def value_counts(values: DataFrame, within: Sequence[str]) -> DataFrame:
    """Rows per distinct outcome: all that resampling needs to know, one partial aggregate."""
    return values.where(F.col("minor_units").isNotNull()).groupBy(*within, "minor_units").agg(F.count(F.lit(1)).alias("n"))


def bootstrap_mean_diff(values: DataFrame, replicates: int = 10_000, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the treatment minus control mean: each replicate draws as many rows per arm as the arm has, with replacement."""
    within = ["experiment_id", "metric_key", "variant"]
    counts = value_counts(values.where(F.col("variant").isin("control", "treatment")), within)
    sizes = counts.groupBy(*within).agg(F.sum("n").alias("drawn"))
    sums = resampled_sums(counts, within, ["minor_units"], ["minor_units"], sizes, replicates, "bootstrap", with_replacement=True)
    mean = lambda arm: F.sum(F.when(_arm(arm), F.col("minor_units"))) / F.sum(F.when(_arm(arm), F.col("drawn"))) / 100.0
    per_replicate = sums.groupBy("experiment_id", "metric_key", "replicate").agg((mean("treatment") - mean("control")).alias("difference"))
    bounds = F.percentile("difference", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return per_replicate.groupBy("experiment_id", "metric_key").agg(
        F.count(F.lit(1)).alias("replicates"), bounds.alias("b")).select(
        "experiment_id", "metric_key", "replicates",
        F.col("b")[0].alias("confidence_interval_low"), F.col("b")[1].alias("confidence_interval_high"))


def arm_moments(values: DataFrame) -> DataFrame:
    """Count, mean and sample deviation per arm, side by side."""
    pick = lambda arm: F.when(_arm(arm), F.col("minor_units"))
    return values.groupBy("experiment_id", "metric_key", "metric_role").agg(
        *[agg for arm in ("control", "treatment") for agg in (
            F.count(pick(arm)).alias(f"{arm}_count"), F.sum(pick(arm)).alias(f"{arm}_minor_units"),
            (F.stddev_samp(pick(arm)) / 100.0).alias(f"{arm}_stddev"))],
    ).where((F.col("control_count") > 0) & (F.col("treatment_count") > 0)).withColumns({
        f"{arm}_mean": F.col(f"{arm}_minor_units").cast("double") / 100.0 / F.col(f"{arm}_count") for arm in ("control", "treatment")})


def permutation_test(values: DataFrame, replicates: int = 10_000) -> DataFrame:
    """Two-sided randomisation p-value ``(extreme + 1) / (replicates + 1)``.

    Each replicate deals the pooled rows anew, always as many to control as control has; both arms need a row.
    """
    key = ["experiment_id", "metric_key"]
    m = arm_moments(values).select(*key, "control_count", "treatment_count", "control_minor_units", "treatment_minor_units")
    n1, n2 = F.col("control_count").cast("double"), F.col("treatment_count").cast("double")
    observed = m.withColumns({
        "observed": F.abs(F.col("treatment_minor_units") / n2 - F.col("control_minor_units") / n1),
        "pool": F.col("control_minor_units") + F.col("treatment_minor_units")})
    pooled = value_counts(values.where(F.col("variant").isin("control", "treatment")), key)
    control = resampled_sums(pooled, key, ["minor_units"], ["minor_units"], observed.select(*key, F.col("control_count").alias("drawn")), replicates, "permutation", with_replacement=False)
    diff = F.abs((F.col("pool") - F.col("minor_units")) / n2 - F.col("minor_units") / n1)
    scored = control.join(observed, key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("replicates"), count_when(diff >= F.col("observed") - 1e-9).alias("extreme_count"))
    return scored.withColumn("permutation_p_value", (F.col("extreme_count") + 1) / (F.col("replicates") + 1.0))


def mean_diff_inference(values: DataFrame, replicates: int = 10_000, alpha: float = 0.05) -> DataFrame:
    key = ["experiment_id", "metric_key"]
    effect = F.col("treatment_mean") - F.col("control_mean")
    return (
        arm_moments(values)
        .join(bootstrap_mean_diff(values, replicates, alpha).drop("replicates"), key)
        .join(permutation_test(values, replicates).drop("replicates", "extreme_count"), key)
        .select(*key, "metric_role", "control_count", "treatment_count", "control_mean", "treatment_mean",
                effect.alias("absolute_effect"),
                (F.try_divide(F.col("treatment_mean"), F.col("control_mean")) - 1.0).alias("relative_effect"),
                "confidence_interval_low", "confidence_interval_high", "permutation_p_value",
                (F.col("permutation_p_value") < alpha).alias("statistically_detectable"))
    )


def outcome_diagnostics(values: DataFrame) -> DataFrame:
    """Shape of the outcome per arm; distinct values are counted, not gathered."""
    v = F.col("minor_units")
    n = F.count(F.lit(1))
    return values.groupBy("experiment_id", "metric_key", "variant").agg(
        n.alias("user_count"), count_when(v == 0).alias("zero_count"), rate(count_when(v == 0), n).alias("zero_rate"),
        count_when(v > 0).alias("positive_count"), rate(count_when(v > 0), n).alias("positive_rate"),
        F.count_distinct(v).alias("unique_value_count"), (F.min(v) / 100.0).alias("minimum"), (F.max(v) / 100.0).alias("maximum"))


def mean_reconciliation(values: DataFrame, summary: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Mature means against the variant summary; only judged when both cover the same users."""
    means = values.groupBy("experiment_id", "variant").agg(
        F.count(F.lit(1)).alias("mature_count"), (F.sum("minor_units") / 100.0 / F.count(F.lit(1))).alias("mature_mean"))
    s = summary.select("experiment_id", "variant", "assigned_user_count", "revenue_per_assigned_user_30d")
    same = F.col("mature_count") == F.col("assigned_user_count")
    close = F.abs(F.col("mature_mean") - F.col("revenue_per_assigned_user_30d")) <= tolerance
    return means.join(s, ["experiment_id", "variant"]).select(
        "experiment_id", "variant", "mature_count", "assigned_user_count", same.alias("population_matches"),
        F.when(same, close).alias("mean_reconciled"))


# --- multiplicity, sensitivity, decisions ------------------------------------------------------------------

def completed_p_values(binary: DataFrame, means: DataFrame) -> DataFrame:
    b = binary.select("experiment_id", "metric_key", "metric_role", F.lit("two_proportion_z_test").alias("test"), F.col("p_value").alias("raw_p_value"))
    m = means.select("experiment_id", "metric_key", "metric_role", F.lit("randomization_permutation_test").alias("test"),
                     F.col("permutation_p_value").alias("raw_p_value"))
    return b.unionByName(m)


def holm_adjust(p_values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Step-down adjustment inside the supportive (non-primary) family of each experiment."""
    family = Window.partitionBy("experiment_id")
    step = family.orderBy("raw_p_value", "metric_key")
    ranked = p_values.where(F.col("metric_role") != "primary").withColumns({
        "family_size": F.count(F.lit(1)).over(family), "__rank": F.row_number().over(step)})
    candidate = F.least(F.lit(1.0), F.col("raw_p_value") * (F.col("family_size") - F.col("__rank") + 1))
    return ranked.withColumn("__c", candidate).withColumn(
        "holm_adjusted_p_value", F.max("__c").over(step.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__c", "__rank").withColumn("detectable_after_holm", F.col("holm_adjusted_p_value") < alpha)


def binary_mde(binary: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Smallest detectable difference around the control rate; NULL on a saturated baseline."""
    z = z_quantile(1 - alpha / 2) + z_quantile(power)
    p = F.col("control_rate")
    se = F.sqrt(p * (1.0 - p) * (1.0 / F.col("control_total") + 1.0 / F.col("treatment_total")))
    mde = F.when(p.isin(0.0, 1.0), None).otherwise(z * se * 100.0)
    observed = F.abs(F.col("absolute_effect") * 100.0)
    return binary.select(
        "experiment_id", "metric_key", "metric_role", "control_rate", "control_total", "treatment_total",
        observed.alias("absolute_observed_effect_pp"), mde.alias("mde_pp"),
        F.try_divide(observed, mde).alias("effect_to_mde_ratio"),
        F.when(p.isin(0.0, 1.0), "not_estimable_saturated_baseline").otherwise("estimated").alias("status"))


def mean_mde(values: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    z = z_quantile(1 - alpha / 2) + z_quantile(power)
    s1, s2 = F.col("control_stddev"), F.col("treatment_stddev")
    se = F.sqrt(s1 * s1 / F.col("control_count") + s2 * s2 / F.col("treatment_count"))
    observed = F.abs(F.col("treatment_mean") - F.col("control_mean"))
    return arm_moments(values).select(
        "experiment_id", "metric_key", "metric_role", "control_count", "treatment_count", "control_stddev", "treatment_stddev",
        observed.alias("absolute_observed_effect"), (z * se).alias("mde"), F.try_divide(observed, z * se).alias("effect_to_mde_ratio"))


def metric_evidence(plan: DataFrame, binary: DataFrame, means: DataFrame) -> DataFrame:
    """Planned metrics with their completed result, if any."""
    done = binary.select("experiment_id", "metric_key", F.lit("binary").alias("outcome_type"), "p_value", "statistically_detectable").unionByName(
        means.select("experiment_id", "metric_key", F.lit("continuous").alias("outcome_type"),
                     F.col("permutation_p_value").alias("p_value"), "statistically_detectable"))
    return plan.join(done, ["experiment_id", "metric_key"], "left")


def experiment_decisions(evidence: DataFrame) -> DataFrame:
    """One restrained status per experiment, plus its evidence as an array (at most one entry per role)."""
    done = F.col("outcome_type").isNotNull()
    primary = F.col("metric_role") == "primary"
    entry = F.struct("metric_role", "metric_key", "outcome_type", "p_value", "statistically_detectable", "inference_status")
    per = evidence.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("configured_metric_count"), count_when(done).alias("completed_metric_count"),
        count_when(~done).alias("excluded_metric_count"), F.max(F.when(primary, F.col("metric_key"))).alias("primary_metric"),
        F.coalesce(F.bool_or(primary & (F.col("outcome_type") == "binary")), F.lit(False)).alias("primary_done"),
        F.coalesce(F.bool_or(primary & F.col("statistically_detectable")), F.lit(False)).alias("primary_detectable"),
        F.coalesce(F.bool_or(F.col("statistically_detectable")), F.lit(False)).alias("any_detectable"),
        F.array_sort(F.collect_list(entry)).alias("evidence"))
    status = (
        F.when(~F.col("primary_done"), "not_decision_ready_primary_metric_unavailable")
        .when(F.col("primary_detectable"), "detectable_primary_effect_requires_business_review")
        .when(F.col("excluded_metric_count") > 0, "primary_not_detectable_supporting_metrics_incomplete")
        .when(~F.col("any_detectable"), "no_detectable_effect_in_completed_metric_family")
        .otherwise("mixed_completed_evidence_requires_review")
    )
    return per.select("experiment_id", "configured_metric_count", "completed_metric_count", "excluded_metric_count",
                      "primary_metric", status.alias("decision_status"), "evidence")


def flatten_evidence(decisions: DataFrame) -> DataFrame:
    """Nested evidence as rows, completed and excluded metrics alike."""
    return decisions.select("experiment_id", "decision_status", F.inline("evidence"))


def decision_evidence(plan: DataFrame, binary: DataFrame, intervals: DataFrame, means: DataFrame, holm: DataFrame, binary_sensitivity: DataFrame, mean_sensitivity: DataFrame) -> DataFrame:
    """One row per planned metric with all that a decision rests on: effect and interval in the metric's own unit, raw and Holm-adjusted p,
    smallest detectable effect.  A metric without a completed test keeps its status and NULLs; the primary metric has no Holm p.
    """
    key = ["experiment_id", "metric_key"]
    pp = lambda c: F.col(c) * 100.0
    low, high = "confidence_interval_low", "confidence_interval_high"
    shares = binary.select(*key, "absolute_effect", "p_value", "statistically_detectable").join(intervals.select(*key, low, high), key).join(
        binary_sensitivity.select(*key, F.col("mde_pp").alias("mde")), key, "left").select(
        *key, F.lit("binary").alias("outcome_type"), pp("absolute_effect").alias("effect"), F.lit("percentage_points").alias("effect_unit"), pp(low).alias(low), pp(high).alias(high),
        F.col("p_value").alias("raw_p_value"), "statistically_detectable", "mde")
    money = means.join(mean_sensitivity.select(*key, "mde"), key, "left").select(
        *key, F.lit("continuous").alias("outcome_type"), F.col("absolute_effect").alias("effect"), F.lit("GBP_per_assigned_user").alias("effect_unit"), low, high,
        F.col("permutation_p_value").alias("raw_p_value"), "statistically_detectable", "mde")
    done = shares.unionByName(money).join(holm.select(*key, "holm_adjusted_p_value"), key, "left")
    return plan.select(*key, "metric_role", "inference_status").join(done, key, "left")


def variant_differences(summary: DataFrame) -> DataFrame:
    """Every other arm against the reference arm: control, else baseline, else the first by name."""
    arm = F.lower(F.trim("variant"))
    preference = F.when(arm == "control", 0).when(arm == "baseline", 1).otherwise(2)
    rates = {"exposure_rate": "exposure_rate", "onboarding_completion_48h_rate": "onboarding_completion_48h",
             "overall_feature_use_7d_rate": "overall_feature_use_7d", "trial_start_conversion_7d": "trial_start_conversion_7d",
             "paid_conversion_14d": "paid_conversion_14d", "cancellation_or_expiry_30d_rate": "cancellation_or_expiry_30d"}
    revenue = "revenue_per_assigned_user_30d"
    cols = ["variant", "assigned_user_count", *rates, revenue]
    ordered = F.struct(preference.alias("preference"), arm.alias("arm"), *cols)
    reference = summary.groupBy("experiment_id").agg(F.min(ordered).alias("ref"))
    both = summary.select("experiment_id", *cols).join(reference, "experiment_id").where(F.col("variant") != F.col("ref.variant"))
    return both.select(
        "experiment_id", F.col("ref.variant").alias("reference_variant"), F.col("variant").alias("comparison_variant"),
        F.col("ref.assigned_user_count").alias("reference_assigned_user_count"),
        F.col("assigned_user_count").alias("comparison_assigned_user_count"),
        *[((F.col(c) - F.col(f"ref.{c}")) * 100.0).alias(f"{out}_difference_pp") for c, out in rates.items()],
        (F.col(revenue) - F.col(f"ref.{revenue}")).alias(f"{revenue}_difference_gbp"),
        F.lit("descriptive_only").alias("interpretation"))
