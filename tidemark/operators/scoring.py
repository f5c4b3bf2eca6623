"""Point-in-time trial features, their checks and splits, and evaluation of probability scores."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.fixed import fixed_rows
from tidemark.functions import count_when, days, elapsed_seconds, hours, ordered_prefix, rate
from tidemark.operators.resampling import resampled_sums

LEAD_HOURS = 48
LABEL_WAIT_HOURS = 72
CATEGORICAL = ["platform", "acquisition_channel", "country_code", "billing_period"]
STATIC_NUMERIC = ["install_to_signup_hours", "signup_to_trial_hours",
                  "onboarding_started_before_prediction", "onboarding_completed_before_prediction"]
ACTIVITY_COUNTS = ["pretrial_session_count", "pretrial_feature_event_count", "pretrial_paywall_view_count",
                   "trial_session_count", "trial_feature_event_count", "trial_active_day_count", "trial_distinct_feature_count"]
BEHAVIOUR_NUMERIC = [*ACTIVITY_COUNTS, "hours_since_last_trial_activity"]
NUMERIC = [*STATIC_NUMERIC, *BEHAVIOUR_NUMERIC]
LABEL = "converted_to_paid"


# --- features known at prediction time ------------------------------------------------------------------

def trial_eligible(base: DataFrame) -> DataFrame:
    """Trials whose label is final at the cutoff, with the moment a prediction would be made."""
    end = F.col("trial_ends_at")
    ready = end + hours(LABEL_WAIT_HOURS)
    return base.where(F.col("is_mature_trial") & (ready <= F.col("observation_cutoff_at"))).withColumns(
        {"prediction_at": end - hours(LEAD_HOURS), "label_ready_at": ready})


def trial_activity(eligible: DataFrame, events: DataFrame) -> DataFrame:
    """Activity up to the prediction moment, one row per eligible trial.

    The interval join is an inner equi-join on the user; matches collapse per (trial, day, feature) with a
    map-side combine before the two distinct counts, so a very active user never reaches one task raw.
    """
    wanted = events.where(F.col("event_name").isin("session_started", "feature_used", "paywall_viewed")).select(
        "user_id", "event_name", "feature_name", "occurred_at")
    slim = eligible.select("subscription_id", "user_id", "signed_up_at", "trial_started_at", "prediction_at")
    at, name = F.col("occurred_at"), F.col("event_name")
    hits = slim.join(wanted, "user_id").where((at >= F.col("signed_up_at")) & (at <= F.col("prediction_at")))
    before = at < F.col("trial_started_at")
    session, feature = name == "session_started", name == "feature_used"
    active = ~before & (session | feature)
    daily = hits.groupBy("subscription_id", F.to_date(at).alias("day"), "feature_name").agg(
        count_when(before & session).alias("pretrial_session_count"),
        count_when(before & feature).alias("pretrial_feature_event_count"),
        count_when(before & (name == "paywall_viewed")).alias("pretrial_paywall_view_count"),
        count_when(~before & session).alias("trial_session_count"),
        count_when(~before & feature).alias("trial_feature_event_count"),
        F.max(F.when(active, at)).alias("last_at"))
    per_trial = daily.groupBy("subscription_id").agg(
        *[F.sum(c).alias(c) for c in ACTIVITY_COUNTS[:5]],
        F.count_distinct(F.when(F.col("last_at").isNotNull(), F.col("day"))).alias("trial_active_day_count"),
        F.count_distinct(F.when(F.col("trial_feature_event_count") > 0, F.col("feature_name"))).alias("trial_distinct_feature_count"),
        F.max("last_at").alias("max_observed_trial_activity_at"))
    return eligible.select("subscription_id").join(per_trial, "subscription_id", "left").fillna(0, subset=ACTIVITY_COUNTS)


def trial_features(eligible: DataFrame, activity: DataFrame) -> DataFrame:
    """Audit columns, 16 predictors and the label."""
    at = F.col("prediction_at")
    known = lambda c: F.coalesce(F.col(c) <= at, F.lit(False)).cast("int")
    between = lambda a, b: elapsed_seconds(F.col(a), F.col(b)) / 3600.0
    return eligible.join(activity, "subscription_id").select(
        "subscription_id", "user_id", "installation_id", "trial_started_at", "trial_ends_at", "prediction_at", "label_ready_at",
        "observation_cutoff_at", F.col("price_gbp").cast("double").alias("price_gbp"), "max_observed_trial_activity_at", *CATEGORICAL,
        between("installed_at", "signed_up_at").alias("install_to_signup_hours"),
        between("signed_up_at", "trial_started_at").alias("signup_to_trial_hours"),
        known("onboarding_started_at").alias("onboarding_started_before_prediction"),
        known("onboarding_completed_at").alias("onboarding_completed_before_prediction"),
        *ACTIVITY_COUNTS,
        between("max_observed_trial_activity_at", "prediction_at").alias("hours_since_last_trial_activity"),
        F.col(LABEL).cast("int").alias(LABEL))


def label_reconciliation(base: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Row-level totals beside cohort totals (both one row)."""
    mature = F.col("is_mature_trial")
    rows = base.agg(F.count(F.lit(1)).alias("row_trials"), count_when(mature).alias("row_mature"),
                    count_when(mature & F.col(LABEL)).alias("row_converted"))
    sums = cohorts.agg(F.struct(F.sum("trial_count").alias("cohort_trials"), F.sum("mature_trial_count").alias("cohort_mature"),
                                F.sum("mature_trial_paid_conversion_count").alias("cohort_converted")))
    both = rows.withColumn("c", sums.scalar()).select("row_trials", "row_mature", "row_converted", "c.*")
    return both.withColumn("reconciled", (F.col("row_trials") == F.col("cohort_trials")) & (F.col("row_mature") == F.col("cohort_mature"))
                           & (F.col("row_converted") == F.col("cohort_converted")))


def leakage_checks(features: DataFrame) -> DataFrame:
    """Violations per point-in-time invariant, all counted in one aggregate."""
    c = F.col
    recency, last = c("hours_since_last_trial_activity"), c("max_observed_trial_activity_at")
    checks = {
        "trial_is_seven_elapsed_days": ~(c("trial_ends_at") == c("trial_started_at") + days(7)),
        "prediction_48h_before_end": ~(c("prediction_at") == c("trial_ends_at") - hours(LEAD_HOURS)),
        "label_72h_after_end": ~(c("label_ready_at") == c("trial_ends_at") + hours(LABEL_WAIT_HOURS)),
        "label_observed_at_cutoff": c("label_ready_at") > c("observation_cutoff_at"),
        "no_activity_after_prediction": last > c("prediction_at"),
        "label_is_binary": c(LABEL).isNull() | ~c(LABEL).isin(0, 1),
        "counts_non_negative": F.greatest(*[(F.coalesce(c(n), F.lit(-1)) < 0).cast("int") for n in ACTIVITY_COUNTS]) == 1,
        "distinct_features_within_events": c("trial_distinct_feature_count") > c("trial_feature_event_count"),
        "onboarding_completed_needs_start": (c("onboarding_completed_before_prediction") == 1) & (c("onboarding_started_before_prediction") != 1),
        "elapsed_hours_non_negative": F.least(*[F.coalesce(c(h), F.lit(-1.0)) for h in STATIC_NUMERIC[:2]]) < 0,
        "recency_null_iff_no_activity": last.isNull() != recency.isNull(),
        "recency_within_five_days": (recency < 0) | (recency > 120.000001),
    }
    return features.agg(F.array(
        *[F.struct(F.lit(k).alias("check_name"), count_when(v).alias("violation_count")) for k, v in checks.items()],
        F.struct(F.lit("subscription_id_unique").alias("check_name"),
                 (F.count(F.lit(1)) - F.count_distinct("subscription_id")).alias("violation_count")),
    ).alias("r")).select(F.inline("r")).withColumn("passed", F.col("violation_count") == 0)


# What only becomes known after the prediction, or names the outcome.
FORBIDDEN = ("subscription_started_at", "expired_at", "status", "cancelled_at", "first_payment_at", "paid_conversion_at", "is_mature_trial", "subscription_status")
CARRIED = ["subscription_id", "user_id", "installation_id", "trial_started_at", "trial_ends_at", "prediction_at", "label_ready_at", "observation_cutoff_at",
                  "max_observed_trial_activity_at", "price_gbp"]


def schema_checks(features: DataFrame, forbidden: Sequence[str] = FORBIDDEN) -> DataFrame:
    """The feature set's columns against the contract: one row per column that is expected, forbidden or found, with its verdict.

    Nothing is read: a model must not be fitted while a row has ``passed`` false.
    """
    expected = dict.fromkeys([*CARRIED, *CATEGORICAL, *NUMERIC, LABEL])
    kinds = dict(features.dtypes)
    rows = []
    for c in dict.fromkeys([*expected, *features.columns, *forbidden]):
        there = c in kinds
        numeric = not there or c not in [*NUMERIC, LABEL] or kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")
        verdict = "forbidden" if there and c in forbidden else "missing" if c in expected and not there else "unexpected" if there and c not in expected else "not_numeric" if not numeric else "ok"
        rows.append((c, there, c in expected, c in forbidden, verdict))
    named = fixed_rows(features.sparkSession, rows, ["column_name", "present", "expected", "forbidden", "verdict"])
    return named.withColumn("passed", F.col("verdict") == "ok")


# --- splits -----------------------------------------------------------------------------------------------

def temporal_split(features: DataFrame, validation_from: date, test_from: date, excluded_from: date) -> DataFrame:
    """Out-of-time partition by trial start date."""
    day = F.to_date("trial_started_at")
    return features.withColumn("split", F.when(day < F.lit(validation_from), "train").when(day < F.lit(test_from), "validation")
                               .when(day < F.lit(excluded_from), "test").otherwise("excluded"))


def split_summary(split: DataFrame) -> DataFrame:
    """Counts and date range per split, and whether it starts after everything before it ended."""
    day = F.to_date("trial_started_at")
    order = F.array_position(F.array(*[F.lit(s) for s in ("train", "validation", "test", "excluded")]), F.col("split"))
    per = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(LABEL).alias("converted_count"), rate(F.sum(LABEL), F.count(F.lit(1))).alias("conversion_rate"),
        F.min(day).alias("earliest_trial_date"), F.max(day).alias("latest_trial_date"),
        (F.count_distinct(LABEL) == 2).alias("has_both_classes")).withColumn("position", order)
    # The window sees the four splits, not their rows.
    earlier = F.max("latest_trial_date").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return per.select(
        "split", "row_count", "converted_count", "conversion_rate", "earliest_trial_date", "latest_trial_date", "has_both_classes",
        F.coalesce(earlier < F.col("earliest_trial_date"), F.lit(True)).alias("starts_after_earlier_splits"))


def temporal_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """Expanding-window fold per row, ordered by (trial start, key): 0 is history only, fold k trains on all before it."""
    start = F.col("trial_started_at")
    minute = F.timestamp_diff("MINUTE", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), start)
    ranked = ordered_prefix(rows, [start, F.col("subscription_id")], [minute, start, F.floor(F.col("subscription_id") / 65_536)], {"position": F.lit(1)})
    sized = ranked.withColumn("__n", rows.agg(F.count(F.lit(1))).scalar())
    size = F.floor(F.col("__n") / (folds + 1))
    head = F.col("__n") - size * folds
    index = F.col("position") - 1
    return sized.withColumn("fold", F.when(index < head, 0).otherwise(1 + F.floor((index - head) / size)).cast("int")).drop("__n")


# --- preprocessing ----------------------------------------------------------------------------------------

def feature_scaling_stats(train: DataFrame, columns: Sequence[str] = tuple(NUMERIC)) -> DataFrame:
    """Exact median, and mean and population deviation after median imputation, per numeric feature.

    Values are counted per (feature, value) first; the median is then read off running counts, so no task
    ever holds a whole column.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    counted = train.select(F.inline(entries)).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    known = counted.where(F.col("value").isNotNull())
    running = ordered_prefix(known, [F.col("value")], [F.floor("value")], {"upto": F.col("n")}, ["feature"])
    sizes = counted.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.sum(F.col("value") * F.col("n")).alias("total"))
    last = F.col("present") - 1
    at = lambda i: F.max(F.when((F.col("upto") - F.col("n") <= i) & (i < F.col("upto")), F.col("value")))
    middle = running.join(sizes.select("feature", "present"), "feature").groupBy("feature").agg(
        ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2.0).alias("median"))
    rows = F.col("present") + F.col("missing")
    filled = sizes.join(middle, "feature").withColumn("mean", (F.col("total") + F.col("missing") * F.col("median")) / rows)
    spread = counted.join(filled.select("feature", "median", "mean"), "feature").groupBy("feature").agg(
        F.sum(F.pow(F.coalesce("value", "median") - F.col("mean"), F.lit(2)) * F.col("n")).alias("ss"))
    return filled.join(spread, "feature").select(
        "feature", "present", "missing", "median", "mean", F.sqrt(F.col("ss") / rows).alias("stddev_pop"))


def category_levels(split: DataFrame) -> DataFrame:
    """One-hot levels seen in training and the rows elsewhere; levels unseen in training encode to zeros."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in CATEGORICAL])
    train = F.col("split") == "train"
    return split.select("split", F.inline(entries)).groupBy("feature", "level").agg(
        count_when(train).alias("train_rows"), count_when(~train).alias("other_rows")).withColumn("encoded", F.col("train_rows") > 0)


# --- probability evaluation -------------------------------------------------------------------------------

def probability_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Brier, log loss, ROC-AUC, average precision and score range per group from (label, p).

    Rows collapse to distinct scores with their positives and negatives; everything, including the tie-aware
    rank statistics, follows from running counts over those.  AUC and precision are NULL on a single class.
    """
    y, p = F.col("label"), F.col("p")
    scores = scored.groupBy(*by, "p").agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - y).cast("long").alias("neg"))
    # Running counts from the highest score down: positives and negatives at or above each score.
    cum = ordered_prefix(scores, [p.desc()], [F.floor(p * -4096)], {"tp": F.col("pos"), "fp": F.col("neg")}, list(by))
    n, positives, negatives = F.sum(F.col("pos") + F.col("neg")), F.sum("pos").cast("double"), F.sum("neg").cast("double")
    clipped = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0 - 1e-15))
    both = (positives > 0) & (negatives > 0)
    # Pairs in which a negative outranks a positive; ties count half.
    inverted = F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2.0))
    precision = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return cum.groupBy(*by).agg(
        n.alias("row_count"), (F.sum("pos") / n).alias("observed_rate"), (F.sum(p * (F.col("pos") + F.col("neg"))) / n).alias("probability_mean"),
        F.min(p).alias("probability_min"), F.max(p).alias("probability_max"),
        (F.sum(F.col("pos") * F.pow(1.0 - p, F.lit(2)) + F.col("neg") * F.pow(p, F.lit(2))) / n).alias("brier_score"),
        (-F.sum(F.col("pos") * F.ln(clipped) + F.col("neg") * F.ln(1.0 - clipped)) / n).alias("log_loss"),
        F.when(both, 1.0 - F.try_divide(inverted, positives * negatives)).alias("roc_auc"),
        F.when(both, F.try_divide(precision, positives)).alias("average_precision"))


_COMPARED = ("brier_score", "log_loss", "roc_auc", "average_precision")


def _compared(metrics: DataFrame, name: str, reference: str) -> DataFrame:
    """One row per candidate with its place and the reference metrics.

    The handful of candidates is packed into one array, so every candidate is compared with the very same
    evaluated numbers instead of a second evaluation of them.
    """
    entry = F.struct("brier_score", "log_loss", name, *[c for c in metrics.columns if c not in ("brier_score", "log_loss", name)])
    packed = metrics.agg(F.array_sort(F.collect_list(entry)).alias("all"))
    ref = F.filter("all", lambda m: m[name] == F.lit(reference))[0]
    rows = packed.withColumn("ref", ref).select("all", "ref", F.posexplode("all").alias("pos", "m"))
    better = lambda m, r: (m["brier_score"] < r["brier_score"]) & (m["log_loss"] < r["log_loss"])
    return rows.select((F.col("pos") + 1).alias("rank"), "m.*", "ref", better(F.col("m"), F.col("ref")).alias("improves_both"),
                       F.coalesce(F.try_element_at(F.filter("all", lambda m: better(m, F.col("ref"))), F.lit(1))[name], F.lit(reference)).alias("winner"))


def model_ranking(scored: DataFrame, reference: str) -> DataFrame:
    """Models by Brier, log loss and name, with deltas to the reference; an increment must improve both losses."""
    out = _compared(probability_metrics(scored, ["model"]), "model", reference)
    return out.select("model", "rank", "row_count", *_COMPARED,
                      *[(F.col(m) - F.col(f"ref.{m}")).alias(f"{m}_delta") for m in _COMPARED], "improves_both")


def calibration_choice(scored: DataFrame, uncalibrated: str = "none") -> DataFrame:
    """Metrics and mean bias per calibration method; a method is chosen only if it improves both losses."""
    out = _compared(probability_metrics(scored, ["method"]), "method", uncalibrated)
    return out.select("method", "row_count", "observed_rate", "probability_mean",
                      (F.col("probability_mean") - F.col("observed_rate")).alias("mean_probability_bias"),
                      *_COMPARED, "improves_both", (F.col("method") == F.col("winner")).alias("chosen"))


def score_rank(scored: DataFrame, key: str = "subscription_id", key_width: int = 65_536, key_prefix: int = 8) -> DataFrame:
    """Exact rank of every row by (p, key), lowest score first.

    Distinct scores get running counts; rows sharing a score are ranked by key inside key ranges (of numbers, or
    of the first characters of text).  A score
    held by a third of all rows is therefore spread over its key ranges.
    """
    p = F.col("p")
    counts = scored.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    below = ordered_prefix(counts, [p], [F.floor(p * 4096)], {"upto": F.col("n")}).select("p", (F.col("upto") - F.col("n")).alias("below"))
    text = dict(scored.dtypes)[key] == "string"
    # Both kinds of range follow the order of the key itself.
    ranges = F.substring(key, 1, key_prefix) if text else F.floor(F.col(key) / key_width)
    ties = ordered_prefix(scored, [F.col(key)], [ranges], {"tie": F.lit(1)}, ["p"])
    return ties.join(below, "p").withColumn("rank", F.col("below") + F.col("tie")).drop("below", "tie")


def reliability_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-frequency bins by score; the first ``n mod bins`` bins hold one row more."""
    n = scored.agg(F.count(F.lit(1))).scalar()
    ranked = score_rank(scored).withColumn("__n", n)
    size, extra = F.floor(F.col("__n") / bins), F.col("__n") % bins
    wide = extra * (size + 1)
    r = F.col("rank")
    number = F.when(r <= wide, F.ceil(r / (size + 1))).otherwise(extra + F.ceil(F.try_divide(r - wide, size)))
    mean_p, observed = F.avg("p"), rate(F.sum("label"), F.count(F.lit(1)))
    return ranked.groupBy(number.cast("int").alias("bin_number")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("p").alias("probability_min"), F.max("p").alias("probability_max"),
        mean_p.alias("mean_predicted_conversion"), observed.alias("observed_conversion_rate"), (mean_p - observed).alias("calibration_gap"))


def targeting_utility(scored: DataFrame, capacities: Sequence[float] = (0.1, 0.2, 0.3)) -> DataFrame:
    """Non-conversions found when only the riskiest ``ceil(n * capacity)`` rows can be treated."""
    n = scored.agg(F.count(F.lit(1))).scalar()
    lost = F.col("label") == 0
    cut = lambda c: F.ceil(F.col("__n") * F.lit(c))
    one = score_rank(scored).withColumn("__n", n).agg(
        F.max("__n").alias("n"), count_when(lost).alias("total"),
        *[agg for i, c in enumerate(capacities) for agg in (
            count_when(F.col("rank") <= cut(c)).alias(f"t{i}"), count_when(lost & (F.col("rank") <= cut(c))).alias(f"h{i}"))])
    rows = F.array(*[F.struct(F.lit(float(c)).alias("capacity"), F.col(f"t{i}").alias("targeted_count"), F.col("total").alias("total_non_conversions"),
                              F.col(f"h{i}").alias("targeted_non_conversions"), F.col("n")) for i, c in enumerate(capacities)])
    overall = rate(F.col("total_non_conversions"), F.col("n"))
    hit = rate(F.col("targeted_non_conversions"), F.col("targeted_count"))
    return one.select(F.inline(rows)).select(
        "capacity", "targeted_count", "total_non_conversions", "targeted_non_conversions",
        rate(F.col("targeted_non_conversions"), F.col("total_non_conversions")).alias("non_conversion_capture_rate"),
        hit.alias("targeted_non_conversion_rate"), overall.alias("overall_non_conversion_rate"), F.try_divide(hit, overall).alias("lift_vs_population"))


def segment_robustness(scored: DataFrame) -> DataFrame:
    """The metrics per month, platform, billing period and channel."""
    dims = {"month": F.date_format("trial_started_at", "yyyy-MM"), **{d: F.col(d) for d in ("platform", "billing_period", "acquisition_channel")}}
    entries = F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("group")) for d, v in dims.items()])
    return probability_metrics(scored.select("label", "p", F.inline(entries)), ["dimension", "group"])


def paired_bootstrap(pairs: DataFrame, replicates: int = 2_000, alpha: float = 0.05) -> DataFrame:
    """Interval of the candidate-minus-reference Brier and log-loss difference on the same rows.

    Each replicate draws as many rows as there are, with replacement, both losses of a row together.  Rows with the same label and scores
    are drawn by their number.  Rows without a label or score are left out.
    """
    y = F.col("label")

    def losses(c: str) -> tuple[Column, Column]:
        p = F.col(c)
        q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0 - 1e-15))
        return F.pow(p - y, F.lit(2)), -F.when(y == 1, F.ln(q)).otherwise(F.ln(1.0 - q))

    (b1, l1), (b0, l0) = losses("p"), losses("p_reference")
    known = pairs.where(y.isNotNull() & F.col("p").isNotNull() & F.col("p_reference").isNotNull())
    counts = known.groupBy("label", "p", "p_reference").agg(F.count(F.lit(1)).alias("n")).withColumns({"brier": b1 - b0, "logloss": l1 - l0})
    # The value's name: its numbers in fixed notation, the same in any engine.
    text = lambda c: F.floor(F.col(c) * 1e15)
    counts = counts.withColumns({"__p": text("p"), "__r": text("p_reference")})
    whole = counts.agg(F.struct(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("brier")) / F.sum("n")).alias("brier_delta"),
                                (F.sum(F.col("n") * F.col("logloss")) / F.sum("n")).alias("log_loss_delta"))).scalar()
    one = F.lit("all")
    drawn = counts.groupBy(one.alias("part")).agg(F.sum("n").alias("drawn"))
    sums = resampled_sums(counts.withColumn("part", one), ["part"], ["label", "__p", "__r"], ["brier", "logloss"], drawn, replicates, "paired", with_replacement=True)
    per = sums.select((F.col("brier") / F.col("drawn")).alias("b"), (F.col("logloss") / F.col("drawn")).alias("l"))
    q = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    out = per.agg(F.count(F.lit(1)).alias("replicates"), F.percentile("b", q).alias("b"), F.percentile("l", q).alias("l")).withColumn("pt", whole)
    return out.select("replicates", "pt.brier_delta", F.col("b")[0].alias("brier_ci_low"), F.col("b")[1].alias("brier_ci_high"),
                      "pt.log_loss_delta", F.col("l")[0].alias("log_loss_ci_low"), F.col("l")[1].alias("log_loss_ci_high"))
