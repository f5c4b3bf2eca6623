"""Experiment outcome windows and inference bound to the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.pin import pin
from tidemark.operators import experiments as ex
from tidemark.operators import inference as inf
from tidemark.operators.registry import metric_registry
from tidemark.operators.reports import metric_support
from tidemark.plans.mart_queries import cutoff
from tidemark.sources import Warehouse


def candidates(w: Warehouse) -> DataFrame:
    return ex.trigger_assignments(w.users, w.product_events, w.experiments)


def variants(w: Warehouse) -> DataFrame:
    return ex.draw_variant(candidates(w)).select("assignment_id", "experiment_id", "user_id", "draw", "variant", "allocation_probability")


def base(w: Warehouse) -> DataFrame:
    return ex.assignment_base(w.experiment_assignments, w.experiments, w.users, w.installations, cutoff(w))


def events_in_windows(w: Warehouse) -> DataFrame:
    return ex.event_outcomes(base(w), w.product_events)


def revenue_in_windows(w: Warehouse) -> DataFrame:
    out = ex.revenue_outcomes(base(w), w.event_payments)
    return out.withColumns({c: F.col(c).cast("double") for c in ex.MONEY_OUTCOMES})


def outcomes(w: Warehouse) -> DataFrame:
    return ex.assignment_outcomes(base(w), w.product_events, w.event_payments)


def summary(w: Warehouse) -> DataFrame:
    return ex.variant_summary(outcomes(w))


class Study:
    """Outcomes materialised once for the several inference steps of one query."""

    def __init__(self, w: Warehouse):
        needed = ["assignment_id", "experiment_id", "variant", "allocation_probability", "observation_cutoff_at",
                  "analysis_window_mature", *inf.BINARY_METRICS.values(), *inf.CONTINUOUS_METRICS.values()]
        self.outcomes = pin(outcomes(w).select(*needed))
        self.plan = inf.metric_plan(self.outcomes, w.experiments, metric_registry(w.spark))

    @property
    def counts(self) -> DataFrame:
        return inf.binary_outcome_counts(self.outcomes, self.plan).join(inf.passing_srm(self.outcomes), "experiment_id")

    @property
    def binary(self) -> DataFrame:
        return inf.two_proportion_test(self.counts)

    @property
    def values(self) -> DataFrame:
        return inf.mature_values(self.outcomes, self.plan).join(inf.passing_srm(self.outcomes), "experiment_id")

    @property
    def means(self) -> DataFrame:
        return pin(inf.mean_diff_inference(pin(self.values)))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round doubles of a finished report, so that engines agree on the last bits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def decisions(w: Warehouse) -> DataFrame:
    s = Study(w)
    return inf.experiment_decisions(inf.metric_evidence(s.plan, s.binary, s.means))


def holm(w: Warehouse) -> DataFrame:
    s = Study(w)
    return rounded(inf.holm_adjust(inf.completed_p_values(s.binary, s.means)))


def evidence(w: Warehouse) -> DataFrame:
    s = Study(w)
    binary, means = pin(s.binary), s.means
    return rounded(inf.decision_evidence(s.plan, binary, inf.newcombe_interval(s.counts), means, inf.holm_adjust(inf.completed_p_values(binary, means)),
                                         inf.binary_mde(binary), inf.mean_mde(s.values)))


def support(w: Warehouse) -> DataFrame:
    """Metrics the running experiments ask for, with what the registry says about them."""
    requested = inf.metric_plan(w.experiment_assignments, w.experiments, metric_registry(w.spark)).groupBy("metric_key").agg(
        F.sum("assigned_user_count").alias("assigned_user_count"))
    return metric_support(requested, metric_registry(w.spark))


QUERIES = {
    "experiment_candidates": candidates,
    "variant_assignment": variants,
    "experiment_assignment_base": base,
    "experiment_event_outcomes": events_in_windows,
    "experiment_revenue_outcomes": revenue_in_windows,
    "experiment_assignment_outcomes": outcomes,
    "experiment_variant_summary": summary,
    "experiment_maturity": lambda w: ex.experiment_maturity(base(w)),
    "variant_differences": lambda w: rounded(inf.variant_differences(summary(w))),
    "metric_support": support,
    "metric_plan": lambda w: inf.metric_plan(w.experiment_assignments, w.experiments, metric_registry(w.spark)),
    "binary_outcome_counts": lambda w: (lambda s: inf.binary_outcome_counts(s.outcomes, s.plan))(Study(w)),
    "blocked_metrics": lambda w: (lambda s: inf.blocked_metrics(s.outcomes, s.plan))(Study(w)),
    "experiment_guards": lambda w: inf.experiment_guards(base(w)),
    "srm_check": lambda w: rounded(inf.srm_check(base(w).where("analysis_window_mature"))),
    "two_proportion_test": lambda w: rounded(Study(w).binary),
    "newcombe_interval": lambda w: rounded(inf.newcombe_interval(Study(w).counts)),
    "bootstrap_mean_diff": lambda w: rounded(inf.bootstrap_mean_diff(Study(w).values)),
    "permutation_test": lambda w: rounded(inf.permutation_test(pin(Study(w).values))),
    "mean_diff_inference": lambda w: rounded(Study(w).means),
    "outcome_diagnostics": lambda w: inf.outcome_diagnostics(Study(w).values),
    "mean_reconciliation": lambda w: (lambda o: inf.mean_reconciliation(
        inf.mature_values(o, inf.metric_plan(o, w.experiments, metric_registry(w.spark))), ex.variant_summary(o)))(pin(outcomes(w))),
    "holm_adjust": holm,
    "binary_mde": lambda w: rounded(inf.binary_mde(Study(w).binary)),
    "mean_mde": lambda w: rounded(inf.mean_mde(Study(w).values)),
    "experiment_decisions": lambda w: decisions(w).drop("evidence"),
    "decision_evidence": evidence,
    "experiment_evidence": lambda w: rounded(inf.flatten_evidence(decisions(w))),
}
