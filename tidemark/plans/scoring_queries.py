"""Point-in-time features, models and score evaluation bound to the warehouse tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.pin import pin
from tidemark.operators import isotonic, marts, models, scoring
from tidemark.plans.experiment_queries import rounded
from tidemark.plans.mart_queries import cutoff, trial_cohorts
from tidemark.sources import Warehouse

SPLIT_DATES = (date(2024, 1, 10), date(2024, 1, 15), date(2024, 1, 18))


def base(w: Warehouse) -> DataFrame:
    return marts.trial_prediction_base(w.trials, w.installations, w.users, cutoff(w))


def eligible(w: Warehouse) -> DataFrame:
    return scoring.trial_eligible(base(w))


def activity(w: Warehouse) -> DataFrame:
    return scoring.trial_activity(eligible(w), w.product_events)


def features(w: Warehouse) -> DataFrame:
    e = eligible(w)
    return scoring.trial_features(e, scoring.trial_activity(e, w.product_events))


def split(w: Warehouse) -> DataFrame:
    return scoring.temporal_split(features(w), *SPLIT_DATES)


def train(w: Warehouse) -> DataFrame:
    return split(w).where(F.col("split") == "train")


def scored(w: Warehouse, factor: int = 7919) -> DataFrame:
    """Every trial with a reproducible score and its label, for the evaluation operators."""
    i = w.installations.select("installation_id", "platform", "acquisition_channel")
    p = ((F.col("subscription_id") * factor) % 1000 + 0.5) / 1000.0
    return w.trials.join(i, "installation_id").select(
        "subscription_id", "trial_started_at", "billing_period", "platform", "acquisition_channel",
        F.col("subscription_started_at").isNotNull().cast("int").alias("label"), p.alias("p"))


def long_scores(w: Warehouse) -> DataFrame:
    p = lambda f: ((F.col("subscription_id") * f) % 1000 + 0.5) / 1000.0
    entries = F.array(*[F.struct(F.lit(m).alias("model"), p(f).alias("p")) for m, f in (("behavioural", 7919), ("boosted", 104729), ("static", 1299709))])
    return scored(w).select("subscription_id", "label", F.inline(entries))


def calibrated(w: Warehouse) -> DataFrame:
    logit = F.ln(F.col("p") / (1.0 - F.col("p")))
    versions = F.array(*[F.struct(F.lit(m).alias("method"), v.alias("q")) for m, v in (
        ("none", F.col("p")), ("sigmoid", 1.0 / (1.0 + F.exp(-(0.5 * logit - 0.7)))), ("isotonic", 0.2 + 0.3 * F.col("p")))])
    return scored(w).select("subscription_id", "label", F.inline(versions)).withColumnRenamed("q", "p")


def pairs(w: Warehouse) -> DataFrame:
    return scored(w).withColumn("p_reference", ((F.col("subscription_id") * 104729) % 1000 + 0.5) / 1000.0)


def calibration(w: Warehouse) -> DataFrame:
    s = pin(split(w))
    oof = models.out_of_fold_scores(scoring.temporal_folds(s.where(F.col("split") == "train")))
    target = models.logistic_scores(s).where(F.col("model") == "behavioural_logistic")
    return models.calibrate(oof, target)


QUERIES = {
    "trial_eligible": eligible,
    "trial_activity": activity,
    "trial_features": features,
    "label_reconciliation": lambda w: scoring.label_reconciliation(base(w), trial_cohorts(w)),
    "leakage_checks": lambda w: scoring.leakage_checks(features(w)),
    "feature_schema_checks": lambda w: scoring.schema_checks(features(w)),
    "temporal_split": lambda w: split(w).select("subscription_id", "trial_started_at", "split"),
    "split_summary": lambda w: scoring.split_summary(split(w)),
    "feature_scaling_stats": lambda w: rounded(scoring.feature_scaling_stats(pin(train(w)))),
    "category_levels": lambda w: scoring.category_levels(split(w)),
    "prevalence_baseline": lambda w: rounded(models.prevalence_baseline(split(w))),
    "logistic_scores": lambda w: models.logistic_scores(split(w)),
    "fit_invariants": lambda w: rounded(models.fit_invariants(split(w)), 4),
    "gbt_scores": lambda w: models.gbt_scores(split(w)),
    "probability_metrics": lambda w: rounded(scoring.probability_metrics(scored(w))),
    "model_ranking": lambda w: rounded(scoring.model_ranking(long_scores(w), "static")),
    "temporal_folds": lambda w: scoring.temporal_folds(scored(w)).select("subscription_id", "trial_started_at", "position", "fold"),
    "temporal_oof_scores": lambda w: models.out_of_fold_scores(scoring.temporal_folds(train(w))),
    "calibration_candidates": calibration,
    "isotonic_blocks": lambda w: isotonic.isotonic_blocks(scored(w)),
    "isotonic_scores": lambda w: rounded(isotonic.isotonic_scores(scored(w, 104729).select("subscription_id", "label", "p"), isotonic.isotonic_blocks(scored(w)))),
    "calibration_choice": lambda w: rounded(scoring.calibration_choice(calibrated(w))),
    "reliability_bins": lambda w: rounded(scoring.reliability_bins(scored(w))),
    "targeting_utility": lambda w: rounded(scoring.targeting_utility(scored(w))),
    "segment_robustness": lambda w: rounded(scoring.segment_robustness(scored(w))),
    "holdout_scores": lambda w: models.logistic_scores(split(w), ("train", "validation"), ("test", "excluded")),
    "paired_bootstrap": lambda w: rounded(scoring.paired_bootstrap(pairs(w))),
}
