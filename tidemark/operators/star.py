"""Star-schema build from staged datasets, and the checks that compare the layers afterwards."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import date_key, ordered_prefix
from tidemark.functions.fixed import fixed_rows
from tidemark.functions.lazy import LazyFrames
from tidemark.functions.pin import pin
from tidemark.operators.marts import date_dimension, day_bounds
from tidemark.operators.quality import stacked
from tidemark.sources.stored import LEAVES, StoredTables, differing_leaves

LINEAGE = ["ingestion_batch_id", "validation_run_id", "source_row_number", "row_hash"]
# A batch id has 27 bits (dates as YYYYMMDD need 25), a record number 36.
ROW_BITS = 36


def surrogate_key() -> Column:
    """Batch and source row packed into one number: unique, stable under re-runs, free of any shuffle, and refused where it would not fit."""
    batch, row = F.col("ingestion_batch_id"), F.col("source_row_number")
    fits = batch.between(0, (1 << (63 - ROW_BITS)) - 1) & row.between(0, (1 << ROW_BITS) - 1)
    return F.when(fits, F.shiftleft(batch, ROW_BITS) + row).when(batch.isNotNull() & row.isNotNull(), F.raise_error(F.lit("batch id or record number too large for a surrogate key")))


def dense_keys(df: DataFrame, order: str = "source_row_number", width: int = 1 << 20) -> DataFrame:
    """Identity numbers 1..n in source row order, ranked inside row-number ranges instead of one task."""
    return ordered_prefix(df, [F.col(order)], [F.floor(F.col(order) / width)], {"surrogate_key": F.lit(1)})


def _with_build(df: DataFrame, build: int, *columns: Column | str) -> DataFrame:
    return df.select(*columns, *LINEAGE, F.lit(build).cast("long").alias("analytics_build_run_id"))


# Fixed catalogue: every time or date column of the warehouse that must be covered by the calendar and carry a date key.
DATED = [
    ("dim_installation", "installed_at", "installed_date_key"), ("dim_user", "signed_up_at", "signed_up_date_key"),
    ("dim_app_release", "release_at", "release_date_key"), ("fact_product_event", "occurred_at", "occurred_date_key"),
    ("fact_subscription", "trial_started_at", "trial_started_date_key"),
    ("fact_subscription", "subscription_started_at", "subscription_started_date_key"), ("fact_subscription", "expired_at", "expired_date_key"),
    ("fact_subscription_transaction", "attempted_at", "attempted_date_key"),
    ("fact_experiment_assignment", "assignment_at", "assignment_date_key"), ("fact_experiment_assignment", "exposed_at", "exposed_date_key"),
    ("fact_marketing_spend", "period_start", "period_start_date_key"), ("fact_marketing_spend", "period_end", "period_end_date_key"),
]
DATASET_OF = {
    "dim_installation": "installations", "dim_user": "users", "dim_app_release": "app_releases", "fact_product_event": "product_events",
    "fact_subscription": "subscriptions", "fact_subscription_transaction": "subscription_transactions",
    "fact_experiment_assignment": "experiment_assignments", "fact_marketing_spend": "marketing_spend",
}


def dim_date(staging: Mapping[str, DataFrame]) -> DataFrame:
    """Calendar over every dated column, so no fact loses its day."""
    columns: dict[str, list[str]] = {}
    for table, at, _ in DATED:
        columns.setdefault(DATASET_OF[table], []).append(at)
    return date_dimension(day_bounds(*[(staging[n], c) for n, c in columns.items()]))


def dim_installation(s: DataFrame, build: int) -> DataFrame:
    return _with_build(s, build, surrogate_key().alias("installation_key"), "installation_id", "anonymous_id", "installed_at",
                       date_key(F.col("installed_at")).alias("installed_date_key"), "platform", "acquisition_channel", "country_code")


def dim_user(s: DataFrame, installation: DataFrame, build: int) -> DataFrame:
    keys = installation.select("ingestion_batch_id", "installation_id", "installation_key")
    return _with_build(s.join(keys, ["ingestion_batch_id", "installation_id"]), build, surrogate_key().alias("user_key"), "user_id", "installation_key",
                       "signed_up_at", date_key(F.col("signed_up_at")).alias("signed_up_date_key"), "onboarding_started_at", "onboarding_completed_at")


def dim_experiment(s: DataFrame, build: int) -> DataFrame:
    """Experiment attributes repeated on assignments, collapsed to one row each."""
    attributes = ["experiment_id", "experiment_start_at", "experiment_end_at", "primary_metric", "analysis_window_days"]
    return s.select("ingestion_batch_id", *attributes).distinct().withColumn("analytics_build_run_id", F.lit(build).cast("long"))


def dim_app_release(s: DataFrame, build: int) -> DataFrame:
    return _with_build(s, build, surrogate_key().alias("app_release_key"), "app_release_id", "release_key", "platform", "version", "release_type",
                       "release_at", date_key(F.col("release_at")).alias("release_date_key"), "rollout_strategy", "rollout_days", "rollout_complete_at")


def _resolved(s: DataFrame, installation: DataFrame, user: DataFrame, how_user: str = "inner", subscription: DataFrame | None = None) -> DataFrame:
    """Installation, user and subscription keys for a fact.

    The distinct ids that occur together are resolved by themselves, as rows of a few numbers, and their keys meet the fact once: its whole
    rows are shuffled for one join instead of one per dimension.  The fact is the only side of that join that can be skewed.
    """
    b = "ingestion_batch_id"
    ids = [b, "installation_id", "user_id", *(["subscription_id"] if subscription is not None else [])]
    found = (s.select(*ids).distinct().join(installation.select(b, "installation_id", "installation_key"), [b, "installation_id"])
             .join(user.select(b, "user_id", "user_key"), [b, "user_id"], how_user))
    keys = ["installation_key", "user_key"]
    if subscription is not None:
        found, keys = found.join(subscription.select(b, "subscription_id", "subscription_key"), [b, "subscription_id"]), [*keys, "subscription_key"]
    found = found.select(*[F.col(c).alias(f"__{c}") for c in ids], *keys)
    # An outer join keeps ids without a user, so a missing user is an id like any other here.
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) if c == "user_id" and how_user == "left" else F.col(c) == F.col(f"__{c}") for c in ids])
    return s.join(found, same).drop(*[f"__{c}" for c in ids])


def fact_product_event(s: DataFrame, installation: DataFrame, user: DataFrame, build: int) -> DataFrame:
    """Events of known installations; an event naming a user is kept only when that user resolved."""
    joined = _resolved(s, installation, user, "left").where(F.col("user_id").isNull() | F.col("user_key").isNotNull())
    return _with_build(joined, build, surrogate_key().alias("product_event_key"), "event_id", "event_name", "occurred_at",
                       date_key(F.col("occurred_at")).alias("occurred_date_key"), "installation_key", "user_key", "session_id", "feature_name")


def fact_subscription(s: DataFrame, installation: DataFrame, user: DataFrame, build: int) -> DataFrame:
    return _with_build(_resolved(s, installation, user), build, surrogate_key().alias("subscription_key"), "subscription_id", "user_key", "installation_key",
                       "billing_period", "price_gbp", "status", "trial_started_at", date_key(F.col("trial_started_at")).alias("trial_started_date_key"),
                       "trial_ends_at", "subscription_started_at", date_key(F.col("subscription_started_at")).alias("subscription_started_date_key"),
                       "expired_at", date_key(F.col("expired_at")).alias("expired_date_key"))


def fact_subscription_transaction(s: DataFrame, subscription: DataFrame, installation: DataFrame, user: DataFrame, build: int) -> DataFrame:
    joined = _resolved(s, installation, user, subscription=subscription)
    return _with_build(joined, build, surrogate_key().alias("transaction_key"), "transaction_id", "subscription_key", "user_key", "installation_key",
                       "transaction_type", "attempted_at", date_key(F.col("attempted_at")).alias("attempted_date_key"), "amount_gbp", "payment_status",
                       "billing_cycle_number", "attempt_number")


def fact_experiment_assignment(s: DataFrame, installation: DataFrame, user: DataFrame, experiment: DataFrame, build: int) -> DataFrame:
    known = experiment.select("ingestion_batch_id", "experiment_id")
    joined = _resolved(s, installation, user).join(known, ["ingestion_batch_id", "experiment_id"])
    return _with_build(joined, build, surrogate_key().alias("experiment_assignment_key"), "assignment_id", "experiment_id", "user_key", "installation_key",
                       "variant", "allocation_probability", "assignment_at", date_key(F.col("assignment_at")).alias("assignment_date_key"),
                       "exposed_at", date_key(F.col("exposed_at")).alias("exposed_date_key"))


def fact_marketing_spend(s: DataFrame, build: int) -> DataFrame:
    return _with_build(s, build, surrogate_key().alias("marketing_spend_key"), "marketing_spend_id", "period_start",
                       date_key(F.col("period_start")).alias("period_start_date_key"), "period_end", date_key(F.col("period_end")).alias("period_end_date_key"),
                       "acquisition_channel", "spend", "impressions", "clicks")


def build_star(staging: Mapping[str, DataFrame], build: int, table: Callable[[str], DataFrame] | None = None) -> LazyFrames:
    """All dimensions and facts of one build, each described when it is first read.

    ``table`` gives the tables that others resolve against, where they are stored; without it they are derived where they are needed.
    """
    star: LazyFrames
    t = table or (lambda name: star[name])
    star = LazyFrames({
        "dim_installation": lambda: dim_installation(staging["installations"], build),
        "dim_user": lambda: dim_user(staging["users"], t("dim_installation"), build),
        "dim_experiment": lambda: dim_experiment(staging["experiment_assignments"], build),
        "dim_app_release": lambda: dim_app_release(staging["app_releases"], build),
        "fact_product_event": lambda: fact_product_event(staging["product_events"], t("dim_installation"), t("dim_user"), build),
        "fact_subscription": lambda: fact_subscription(staging["subscriptions"], t("dim_installation"), t("dim_user"), build),
        "fact_subscription_transaction": lambda: fact_subscription_transaction(
            staging["subscription_transactions"], t("fact_subscription"), t("dim_installation"), t("dim_user"), build),
        "fact_experiment_assignment": lambda: fact_experiment_assignment(
            staging["experiment_assignments"], t("dim_installation"), t("dim_user"), t("dim_experiment"), build),
        "fact_marketing_spend": lambda: fact_marketing_spend(staging["marketing_spend"], build),
    })
    return star


# --- counts and reconciliation ----------------------------------------------------------------------------

def dataset_counts(tables: Mapping[str, DataFrame], alias: str) -> DataFrame:
    """Rows per batch and dataset."""
    return stacked([df.groupBy("ingestion_batch_id").agg(F.count(F.lit(1)).alias(alias)).select(
        "ingestion_batch_id", F.lit(n).alias("dataset_name"), alias) for n, df in tables.items()])


def raw_reconciliation(files: DataFrame, counts: DataFrame) -> DataFrame:
    """File metadata against what the raw tables hold."""
    actual = F.coalesce("actual_row_count", F.lit(0))
    a_delta = F.col("accepted_row_count") - actual
    e_delta = F.col("expected_row_count") - (F.col("accepted_row_count") + F.col("rejected_row_count"))
    return files.join(counts, ["ingestion_batch_id", "dataset_name"], "left").select(
        "ingestion_batch_id", "dataset_name", "expected_row_count", "accepted_row_count", "rejected_row_count", actual.alias("actual_row_count"),
        a_delta.alias("accepted_vs_actual_delta"), e_delta.alias("expected_vs_processed_delta"),
        ((F.col("status") == "loaded") & (a_delta == 0) & (e_delta == 0)).alias("reconciled"))


def layer_reconciliation(upper: DataFrame, lower: DataFrame, upper_count: str, lower_count: str) -> DataFrame:
    """Row-count difference between two layers per batch and dataset."""
    low = F.coalesce(lower_count, F.lit(0))
    delta = F.col(upper_count) - low
    return upper.join(lower, ["ingestion_batch_id", "dataset_name"], "left").select(
        "ingestion_batch_id", "dataset_name", upper_count, low.alias(lower_count), delta.alias("row_count_delta"), (delta == 0).alias("reconciled"))


def _bits(*columns: str) -> list[Column]:
    """128 bits of the columns together, as two numbers; null where all are null."""
    some = reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in columns])
    return [F.when(some, F.xxhash64(F.lit(seed), *columns)) for seed in (1, 2)]


def lineage_reconciliation(staging: Mapping[str, DataFrame], analytics: Mapping[str, DataFrame], keys: dict[str, str], by: Sequence[str] = ("ingestion_batch_id",)) -> DataFrame:
    """Staged rows missing in the analytics layer, or there with another row number, hash or run; counted per ``by``, columns that a key determines.

    The analytics side is reduced to one row per key first, so repeated keys never multiply.  Row hashes are compared by 128 bits: two numbers
    collapse in place, where digests would be sorted.
    """
    first, second = _bits("row_hash")
    stamps = {"source_row_number": F.col("source_row_number"), "validation_run_id": F.col("validation_run_id"), "hash_1": first, "hash_2": second}
    out = []
    for n, s in staging.items():
        key = list(dict.fromkeys([*by, "ingestion_batch_id", keys[n]]))
        a = analytics[n].groupBy(*key).agg(F.lit(True).alias("found"), *[f(v).alias(f"{p}_{c}") for c, v in stamps.items() for p, f in (("lo", F.min), ("hi", F.max))])
        differs = reduce(lambda x, y: x | y, [~F.col(f"{p}_{c}").eqNullSafe(F.col(c)) for c in stamps for p in ("lo", "hi")])
        found = F.col("found").isNotNull()
        out.append(s.select(*key, *[v.alias(c) for c, v in stamps.items()]).join(a, key, "left").groupBy(*by).agg(
            F.count(F.lit(1)).alias("staging_row_count"), F.count_if(found).alias("matched_analytics_rows"),
            F.count_if(~found).alias("missing_analytics_rows"), F.count_if(found & differs).alias("lineage_mismatches"),
        ).withColumn("dataset_name", F.lit(n)))
    return stacked(out)


def lineage_by_digest(staging: StoredTables, analytics: StoredTables, keys: dict[str, str]) -> DataFrame:
    """``lineage_reconciliation`` of stored layers: rows are read only of leaves where the layers' digests differ or a key repeats.

    ``analytics`` names its tables as ``DATASET_OF`` does.  Which leaves differ is known on the driver, at most ``LEAVES`` numbers a dataset, so
    that the files' statistics skip the others.
    """
    table_of = {n: t for t, n in DATASET_OF.items()}
    s, a = staging.all_digests(), analytics.all_digests(DATASET_OF)
    where = ["dataset_name", "ingestion_batch_id", "leaf"]
    repeated = s.unionByName(a).where("repeats > 0").select(*where)
    apart = pin(differing_leaves(s, a).unionByName(repeated).distinct())
    nothing = F.lit(0).cast("long")
    out = [s.join(apart, where, "left_anti").select(
        "ingestion_batch_id", F.col("n").alias("staging_row_count"), F.col("n").alias("matched_analytics_rows"), nothing.alias("missing_analytics_rows"),
        nothing.alias("lineage_mismatches"), "dataset_name")]
    leaves = {r.dataset_name: r.leaves for r in apart.groupBy("dataset_name").agg(F.array_sort(F.collect_set("leaf")).alias("leaves")).collect()}
    for n, some in sorted(leaves.items()):
        inside = F.col("leaf").isin(some) if len(some) < LEAVES else F.lit(True)
        # A leaf that differs in one batch may be alike in another, which is counted already: counts per leaf are dropped there, not rows.
        mine = apart.where(F.col("dataset_name") == n).select("ingestion_batch_id", "leaf")
        counted = lineage_reconciliation({n: staging[n].where(inside)}, {n: analytics[table_of[n]].where(inside)}, keys, ("ingestion_batch_id", "leaf"))
        out.append(counted.join(mine, ["ingestion_batch_id", "leaf"], "left_semi").drop("leaf"))
    counts = ("staging_row_count", "matched_analytics_rows", "missing_analytics_rows", "lineage_mismatches")
    return stacked(out).groupBy("ingestion_batch_id", "dataset_name").agg(*[F.sum(c).alias(c) for c in counts])


def build_authorisation(batches: DataFrame, validations: DataFrame, promotions: DataFrame, reconciliation: DataFrame, datasets: int) -> DataFrame:
    """Batches whose whole chain succeeded: ingest, validation, complete promotion, and every dataset reconciled."""
    ok = lambda df, alias: df.select("ingestion_batch_id", (F.col("status") == "succeeded").alias(alias))
    chain = ok(batches, "ingested").join(ok(validations, "validated"), "ingestion_batch_id", "left")
    p = promotions.select("ingestion_batch_id", ((F.col("status") == "succeeded") & (F.col("expected_row_count") == F.col("promoted_row_count"))).alias("promoted"),
                          "promoted_row_count")
    r = reconciliation.groupBy("ingestion_batch_id").agg(
        ((F.count(F.lit(1)) == datasets) & (F.count_if("reconciled") == datasets)).alias("all_reconciled"), F.sum("staging_row_count").alias("staging_row_count"))
    joined = chain.join(p, "ingestion_batch_id", "left").join(r, "ingestion_batch_id", "left")
    flags = {f: F.coalesce(F.col(f), F.lit(False)) for f in ("ingested", "validated", "promoted", "all_reconciled")}
    same = F.coalesce(F.col("staging_row_count") == F.col("promoted_row_count"), F.lit(False))
    return joined.select("ingestion_batch_id", *[c.alias(f) for f, c in flags.items()], reduce(lambda a, b: a & b, flags.values(), same).alias("authorised"))


def build_reconciliation(reconciliation: DataFrame, assignments: DataFrame, experiment: DataFrame) -> DataFrame:
    """Analytics rows must equal staged rows plus the derived experiment rows."""
    b = "ingestion_batch_id"
    sums = reconciliation.groupBy(b).agg(
        F.count(F.lit(1)).alias("dataset_count"), F.count_if("reconciled").alias("reconciled_count"),
        F.sum("staging_row_count").alias("staging_row_count"), F.sum("analytics_row_count").alias("fact_row_count"))
    staged = assignments.groupBy(b).agg(F.count_distinct("experiment_id").alias("staged_experiments"))
    made = experiment.groupBy(b).agg(F.count(F.lit(1)).alias("built_experiments"))
    # The three per-batch totals are stacked and folded; nothing is joined.
    folded = sums.unionByName(staged, allowMissingColumns=True).unionByName(made, allowMissingColumns=True)
    measures = [c for c in folded.columns if c != b]
    total = F.col("fact_row_count") + F.col("built_experiments")
    return folded.groupBy(b).agg(*[F.max(c).alias(c) for c in measures]).select(
        "*", total.alias("analytics_row_count"), (F.col("staged_experiments") == F.col("built_experiments")).alias("experiments_reconciled"),
        (total == F.col("staging_row_count") + F.col("staged_experiments")).alias("rows_reconciled"))


# --- checks after the build -------------------------------------------------------------------------------

def analytics_checks(reconciliation: DataFrame, lineage: DataFrame) -> DataFrame:
    """Sixteen verdicts: row counts and row lineage per dataset."""
    verdict = lambda kind, df, n: df.select(
        F.concat(F.lit(f"{kind}_"), "dataset_name").alias("check_name"), F.lit(kind).alias("category"), "dataset_name",
        n.alias("violation_count"), F.when(n == 0, "passed").otherwise("failed").alias("status"))
    return verdict("reconciliation", reconciliation, F.abs("row_count_delta")).unionByName(
        verdict("lineage", lineage, F.col("missing_analytics_rows") + F.col("lineage_mismatches")))


def _differs(name: str) -> Column:
    return ~F.col(name).eqNullSafe(F.col(f"built_{name}"))


def relationship_checks(staging: Mapping[str, DataFrame], star: Mapping[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Facts joined back to their dimensions must name the same business ids as the staged rows."""
    b = "ingestion_batch_id"
    ids = {"installation": ("dim_installation", "installation_key", "installation_id"), "user": ("dim_user", "user_key", "user_id"),
           "subscription": ("fact_subscription", "subscription_key", "subscription_id")}
    checks = [
        ("relationship_users_installation", "users", "dim_user", ["installation"]),
        ("relationship_product_events", "product_events", "fact_product_event", ["installation", "user"]),
        ("relationship_subscriptions", "subscriptions", "fact_subscription", ["installation", "user"]),
        ("relationship_subscription_transactions", "subscription_transactions", "fact_subscription_transaction", ["installation", "user", "subscription"]),
        ("relationship_experiment_assignments", "experiment_assignments", "fact_experiment_assignment", ["installation", "user"]),
    ]
    out = []
    for check, dataset, fact, dims in checks:
        key, sks, bids = keys[dataset], [ids[d][1] for d in dims], [ids[d][2] for d in dims]
        # Rows are matched by their place in the source, which stays unique even where a business key repeats; 128 bits stand for key and hash.
        place = [c.alias(f"__p{i}") for i, c in enumerate(_bits(key, "row_hash"))]
        known = F.col(b).isNotNull() & F.col(key).isNotNull() & F.col("row_hash").isNotNull()
        at = [b, "__p0", "__p1"]
        f = star[fact].where(known).select(b, *place, *sks)
        # Surrogate keys that occur together are named once, and the fact's rows meet the names in one join.
        names = f.select(*sks).distinct()
        for d in dims:
            table, sk, bid = ids[d]
            names = names.join(star[table].groupBy(sk).agg(F.max(bid).alias(f"built_{bid}")), sk, "left")
        names = names.select(*[F.col(c).alias(f"__{c}") for c in sks], *[f"built_{c}" for c in bids])
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in sks])
        built = f.join(names, same).groupBy(*at).agg(*[F.max(f"built_{c}").alias(f"built_{c}") for c in bids])
        wrong = reduce(lambda x, y: x | y, [_differs(c) for c in bids])
        out.append(staging[dataset].where(known).select(b, *place, *bids).join(built, at).agg(F.count_if(wrong).alias("violation_count")).select(
            F.lit(check).alias("check_name"), F.lit(dataset).alias("dataset_name"), "violation_count"))
    return stacked(out).withColumn("passed", F.col("violation_count") == 0)


def date_key_checks(star: Mapping[str, DataFrame], calendar: DataFrame) -> DataFrame:
    """Every date key must exist in the calendar and name the UTC day of its time.

    Each fact is read once for all its dates and collapses to distinct (day, key) pairs; the calendar is joined
    once, to the pairs of all tables together.
    """
    dates: dict[str, list[tuple[str, str]]] = {}
    for table, at, key in DATED:
        dates.setdefault(table, []).append((at, key))
    pairs = []
    for table, columns in dates.items():
        entries = F.expr("array(" + ", ".join(f"named_struct('date_key_column', '{k}', 'day', CAST({at} AS DATE), 'date_key', {k})" for at, k in columns) + ")")
        pairs.append(star[table].select(F.lit(table).alias("table_name"), F.inline(entries)).where(F.col("day").isNotNull())
                     .groupBy("table_name", "date_key_column", "day", "date_key").agg(F.count(F.lit(1)).alias("n")))
    wrong = F.coalesce(F.sum(F.when(~F.col("full_date").eqNullSafe(F.col("day")), F.col("n"))), F.lit(0))
    counted = stacked(pairs).join(calendar.select("date_key", "full_date"), "date_key", "left").groupBy("table_name", "date_key_column").agg(wrong.alias("found"))
    names = fixed_rows(calendar.sparkSession, [(t, k) for t, _, k in DATED], ["table_name", "date_key_column"])
    return names.join(counted, ["table_name", "date_key_column"], "left").select(
        "table_name", "date_key_column", F.coalesce("found", F.lit(0)).alias("violation_count"))


def build_control_check(reconciliation: DataFrame, experiment: DataFrame, table_count: int, expected_tables: int = 10) -> DataFrame:
    """The build's own arithmetic: table count and row total."""
    n = experiment.agg(F.count(F.lit(1))).scalar()
    sums = reconciliation.agg(F.sum("staging_row_count").alias("staging_row_count"), F.sum("analytics_row_count").alias("fact_row_count")).withColumn("experiments", n)
    good = (F.lit(table_count) == expected_tables) & (F.col("fact_row_count") == F.col("staging_row_count"))
    return sums.withColumn("violation_count", F.when(good, 0).otherwise(1).cast("long"))
