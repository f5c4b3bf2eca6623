"""Data-quality checks: each yields a violation count and passes at zero.

Row predicates of one table share one scan; key checks count per key before they shuffle or join, so a key
that fills a third of a table arrives as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.fixed import fixed_rows
from tidemark.sources.contracts import Contract

RESULT = ["dataset_name", "category", "check_name", "violation_count"]


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _named(df: DataFrame, dataset: str, category: str, check: str) -> DataFrame:
    return df.select(F.lit(dataset).alias("dataset_name"), F.lit(category).alias("category"), F.lit(check).alias("check_name"),
                     F.coalesce(F.col("violation_count"), F.lit(0)).cast("long").alias("violation_count"))


def row_checks(df: DataFrame, dataset: str, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """Several row predicates of one table counted in one scan; NULL is not a violation."""
    entries = F.array(*[F.struct(F.lit(cat).alias("category"), F.lit(name).alias("check_name"), F.count_if(cond).alias("violation_count"))
                        for name, (cat, cond) in checks.items()])
    return df.agg(entries.alias("e")).select(F.lit(dataset).alias("dataset_name"), F.inline("e"))


# --- row rules --------------------------------------------------------------------------------------------

def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _rule(terms: list[str]) -> Column:
    """One predicate from many short terms; NULL terms do not count."""
    return F.expr(" OR ".join(f"coalesce({t}, false)" for t in terms) or "false")


def null_violation(contract: Contract) -> Column:
    """A required field is missing, or a text is blank."""
    missing = [f"{f.name} IS NULL" for f in contract.fields if not f.nullable]
    return _rule(missing + [f"trim({f.name}) = ''" for f in contract.fields if f.kind == "string"])


def domain_violation(contract: Contract) -> Column:
    """Surrounding blanks, a value outside its domain, or out of range."""
    out: list[str] = []
    for f in contract.fields:
        if f.kind == "string":
            out.append(f"{f.name} <> trim({f.name})")
        if f.allowed is not None:
            out.append(f"{f.name} NOT IN ({', '.join(repr(v) for v in f.allowed)})")
        if f.low is not None:
            out.append(f"{f.name} < {f.low}")
        if f.high is not None:
            out.append(f"{f.name} > {f.high}")
    return _rule(out)


def row_violation(contract: Contract) -> Column:
    return null_violation(contract) | domain_violation(contract)


def nullability(tables: Mapping[str, DataFrame], rules: dict[str, Contract]) -> DataFrame:
    return stacked([row_checks(df, n, {f"{n}_nullability": ("nullability", null_violation(rules[n]))}) for n, df in tables.items()])


def domains(tables: Mapping[str, DataFrame], rules: dict[str, Contract]) -> DataFrame:
    return stacked([row_checks(df, n, {f"{n}_domain": ("domain", domain_violation(rules[n]))}) for n, df in tables.items()])


# --- keys -------------------------------------------------------------------------------------------------

def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``count(*) - count(distinct key)``: rows are combined per key before the distinct keys are counted."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    distinct = F.count(F.lit(1)) if len(keys) > 1 else F.count(keys[0])
    return per_key.agg((F.coalesce(F.sum("n"), F.lit(0)) - distinct).alias("violation_count"))


# (dataset, keys, check): fixed catalogue of keys beside the primary ones.
KEYS = [
    ("installations", ["anonymous_id"], "installations_anonymous_id_unique"),
    ("users", ["installation_id"], "users_installation_id_unique"),
    ("subscriptions", ["user_id"], "subscriptions_user_id_unique"),
    ("marketing_spend", ["period_start", "acquisition_channel"], "marketing_spend_period_channel_unique"),
    ("app_releases", ["release_key", "platform"], "app_releases_release_key_platform_unique"),
]


def uniqueness(tables: Mapping[str, DataFrame], rules: dict[str, Contract]) -> DataFrame:
    """Rows beyond the first of their key, for all keys of a dataset in one pass: each row is unfolded to its keys, which are counted together.

    A single-column key that is null counts as a violation, as ``count(*) - count(distinct key)`` has it.
    """
    keys: dict[str, list[tuple[str, list[str]]]] = {n: [(f"{n}_{rules[n].key}_unique", [rules[n].key])] for n in tables}
    for n, columns, check in KEYS:
        if n in keys:
            keys[n].append((check, columns))
    out = []
    for n, checks in keys.items():
        entries = F.array(*[F.struct(F.lit(check).alias("check_name"), F.to_json(F.struct(*columns)).alias("key"),
                                     (F.col(columns[0]).isNull() if len(columns) == 1 else F.lit(False)).alias("void")) for check, columns in checks])
        per_key = tables[n].select(F.inline(entries)).groupBy("check_name", "key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("void").alias("void"))
        found = per_key.groupBy("check_name").agg(F.sum(F.col("n") - F.when(F.col("void"), 0).otherwise(1)).alias("found"))
        out.append(_complete(found, [(n, check) for check, _ in checks], "uniqueness"))
    return stacked(out)


def _complete(found: DataFrame, names: Sequence[tuple[str, str]], category: str) -> DataFrame:
    """A row for every named check, found (check_name, found) or not."""
    all_names = fixed_rows(found.sparkSession, list(names), ["dataset_name", "check_name"])
    return all_names.join(found, "check_name", "left").select(
        "dataset_name", F.lit(category).alias("category"), "check_name", F.coalesce("found", F.lit(0)).cast("long").alias("violation_count"))


def unmatched(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows without a parent on all keys.  Rows collapse to (keys, count) first, so the anti join sees each key once per task."""
    per_key = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.join(parent.select(*keys), list(keys), "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violation_count"))


# (child, parent, keys, check): fixed catalogue of references.
REFERENCES = [
    ("users", "installations", ["installation_id"], "users_reference_installations"),
    ("users", "installations", ["installation_id", "anonymous_id"], "users_anonymous_id_matches_installation"),
    ("product_events", "installations", ["installation_id"], "product_events_reference_installations"),
    ("product_events", "installations", ["installation_id", "anonymous_id"], "product_events_anonymous_id_matches_installation"),
    ("product_events", "users", ["user_id"], "product_events_reference_users_when_present"),
    ("product_events", "users", ["user_id", "installation_id"], "product_events_user_installation_match"),
    ("subscriptions", "users", ["user_id"], "subscriptions_reference_users"),
    ("subscriptions", "users", ["user_id", "installation_id"], "subscriptions_user_installation_match"),
    ("subscription_transactions", "subscriptions", ["subscription_id"], "transactions_reference_subscriptions"),
    ("subscription_transactions", "subscriptions", ["subscription_id", "user_id"], "transactions_user_matches_subscription"),
    ("subscription_transactions", "subscriptions", ["subscription_id", "installation_id"], "transactions_installation_matches_subscription"),
    ("experiment_assignments", "users", ["user_id"], "experiment_assignments_reference_users"),
    ("experiment_assignments", "users", ["user_id", "installation_id"], "experiment_assignments_user_installation_match"),
]


# (child, parent, key, child's time, parent's time, check): fixed catalogue of moments that must not come before their parent's.
FLOORS = [
    ("users", "installations", "installation_id", "signed_up_at", "installed_at", "users_signup_not_before_installation"),
    ("product_events", "installations", "installation_id", "occurred_at", "installed_at", "product_events_not_before_installation"),
    ("product_events", "users", "user_id", "occurred_at", "signed_up_at", "registered_product_events_not_before_signup"),
    ("subscriptions", "users", "user_id", "trial_started_at", "signed_up_at", "subscription_trial_not_before_signup"),
    ("experiment_assignments", "users", "user_id", "assignment_at", "signed_up_at", "experiment_assignment_not_before_signup"),
]


def related(tables: Mapping[str, DataFrame], references: Sequence[tuple], floors: Sequence[tuple]) -> DataFrame:
    """All conditions between two tables as filtered counts over one join per (child, parent).

    The parent collapses to distinct (key, other columns, time) with its multiplicity before the join; a child row that a parent's
    (key, other) matches several times counts once, a time before several parents' counts once per parent.  The child is the only side that
    can be skewed, and a left join lets adaptive execution split it.  A null key or other column matches nothing; events without a user are
    not held against users.
    """
    pairs: dict[tuple[str, str], tuple[list, list]] = {}
    for child, parent, keys, check in references:
        pairs.setdefault((child, parent), ([], []))[0].append((keys, check))
    for child, parent, key, at, floor, check in floors:
        pairs.setdefault((child, parent), ([], []))[1].append((key, at, floor, check))
    out = []
    for (child, parent), (refs, times) in pairs.items():
        key = (refs[0][0] if refs else [times[0][0]])[0]
        others = list(dict.fromkeys(k for keys, _ in refs for k in keys[1:]))
        spans = list(dict.fromkeys(floor for _, _, floor, _ in times))
        kept = tables[parent].groupBy(key, *others, *spans).agg(F.count(F.lit(1)).alias("__m"))
        # One row of the parent stands for its (key, other) in the count of matches.
        order = [F.struct(*others, *spans)] if others or spans else [F.col(key)]
        lead = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
        kept = kept.select(F.col(key), F.col("__m"), *[F.col(c).alias(f"__{c}") for c in [*others, *spans]], lead([key]).alias("__first"), *[lead([key, o]).alias(f"__first_{o}") for o in others])
        rows = tables[child].select(*dict.fromkeys([key, *others, *[at for _, at, _, _ in times]]))
        if (child, parent) == ("product_events", "users"):
            rows = rows.where(F.col(key).isNotNull())
        joined = rows.join(kept, key, "left")
        found = F.col("__m").isNotNull()
        counts = {}
        for keys, check in refs:
            # Rows that match nothing: all rows (each stands once, under its key's first parent or none) less those matched.
            total = F.count_if(~found | F.col("__first"))
            hit = F.count_if(found & F.col("__first")) if len(keys) == 1 else F.count_if(F.col(f"__first_{keys[1]}") & (F.col(keys[1]) == F.col(f"__{keys[1]}")))
            counts[check] = ("referential_integrity", total - hit)
        for _, at, floor, check in times:
            counts[check] = ("chronology", F.coalesce(F.sum(F.when(F.col(at) < F.col(f"__{floor}"), F.col("__m"))), F.lit(0)))
        entries = F.array(*[F.struct(F.lit(cat).alias("category"), F.lit(check).alias("check_name"), n.cast("long").alias("violation_count")) for check, (cat, n) in counts.items()])
        out.append(joined.agg(entries.alias("e")).select(F.lit(child).alias("dataset_name"), F.inline("e")))
    return stacked(out)


def referential(tables: Mapping[str, DataFrame]) -> DataFrame:
    return related(tables, REFERENCES, [])


# --- time order -------------------------------------------------------------------------------------------

# Rows whose own times contradict each other: (dataset, check) -> condition, a fixed catalogue.
ORDERS = {
    ("users", "users_onboarding_start_not_before_signup"): "onboarding_started_at < signed_up_at",
    ("users", "users_onboarding_completion_valid"): "onboarding_completed_at IS NOT NULL AND (onboarding_started_at IS NULL OR onboarding_completed_at < onboarding_started_at)",
    ("experiment_assignments", "experiment_assignment_inside_window"): "NOT (experiment_start_at <= assignment_at AND assignment_at < experiment_end_at)",
    ("experiment_assignments", "experiment_exposure_inside_window"): "exposed_at IS NOT NULL AND NOT (assignment_at <= exposed_at AND exposed_at < experiment_end_at)",
    ("marketing_spend", "marketing_spend_period_order"): "period_end < period_start",
    ("app_releases", "app_release_rollout_not_before_release"): "rollout_complete_at < release_at",
}


def own_times(tables: Mapping[str, DataFrame]) -> DataFrame:
    per: dict[str, dict[str, tuple[str, Column]]] = {}
    for (n, check), condition in ORDERS.items():
        per.setdefault(n, {})[check] = ("chronology", F.expr(condition))
    return stacked([row_checks(tables[n], n, checks) for n, checks in per.items()])


def chronology(tables: Mapping[str, DataFrame]) -> DataFrame:
    return related(tables, [], FLOORS).unionByName(own_times(tables))


def row_rules(tables: Mapping[str, DataFrame], rules: dict[str, Contract]) -> DataFrame:
    """Nullability, domain and time order within rows: every predicate of a dataset in one scan."""
    out = []
    for n, df in tables.items():
        checks = {f"{n}_nullability": ("nullability", null_violation(rules[n])), f"{n}_domain": ("domain", domain_violation(rules[n]))}
        out.append(row_checks(df, n, checks | {check: ("chronology", F.expr(c)) for (of, check), c in ORDERS.items() if of == n}))
    return stacked(out)


def compiled(tables: Mapping[str, DataFrame], rules: dict[str, Contract]) -> list[DataFrame]:
    """The catalogue of row, key, reference and time checks: one scan per dataset for its rows, one for its keys, one join per (child, parent)."""
    return [row_rules(tables, rules), uniqueness(tables, rules), related(tables, REFERENCES, FLOORS)]


# --- events against entities ------------------------------------------------------------------------------

def event_entity_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Lifecycle events against the entities they announce: six differences from one count per table."""
    name = F.col("event_name")
    kinds = ["app_install", "signup", "trial_started", "subscription_started", "subscription_renewed", "payment_failed"]
    events = tables["product_events"].agg(*[F.count_if(name == k).alias(k) for k in kinds])
    ok, failed = F.col("payment_status") == "succeeded", F.col("payment_status") == "failed"
    charges = tables["subscription_transactions"].agg(F.struct(
        F.count_if(ok & (F.col("transaction_type") == "initial_charge")).alias("first"),
        F.count_if(ok & (F.col("transaction_type") == "renewal")).alias("renewed"), F.count_if(failed).alias("failed"))).scalar()
    total = lambda n: tables[n].agg(F.count(F.lit(1))).scalar()
    both = events.withColumns({"n_inst": total("installations"), "n_user": total("users"), "n_sub": total("subscriptions"), "ch": charges})
    pairs = [
        ("app_install_event_count_matches_installations", "app_install", "n_inst"), ("signup_event_count_matches_users", "signup", "n_user"),
        ("trial_started_event_count_matches_subscriptions", "trial_started", "n_sub"),
        ("subscription_started_event_count_matches_charges", "subscription_started", "ch.first"),
        ("subscription_renewed_event_count_matches_charges", "subscription_renewed", "ch.renewed"),
        ("payment_failed_event_count_matches_transactions", "payment_failed", "ch.failed"),
    ]
    entries = F.array(*[F.struct(F.lit("product_events").alias("dataset_name"), F.lit("reconciliation").alias("category"), F.lit(check).alias("check_name"),
                                 F.abs(F.col(a) - F.col(b)).alias("violation_count")) for check, a, b in pairs])
    return both.select(F.inline(entries))


def event_timestamp_match(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Entities without an event of the expected name at the expected time, in one anti join for all four kinds."""
    expected = [
        ("installations", "installation_app_install_timestamp_match", "app_install", "installation_id", "installed_at"),
        ("users", "user_signup_event_timestamp_match", "signup", "user_id", "signed_up_at"),
        ("users", "user_onboarding_started_event_timestamp_match", "onboarding_started", "user_id", "onboarding_started_at"),
        ("users", "user_onboarding_completed_event_timestamp_match", "onboarding_completed", "user_id", "onboarding_completed_at"),
    ]
    name = F.col("event_name")
    wanted = stacked([tables[n].where(F.col(at).isNotNull()).select(
        F.lit(n).alias("dataset_name"), F.lit(check).alias("check_name"), F.lit(event).alias("event_name"), F.col(key).alias("who"), F.col(at).alias("at"))
        for n, check, event, key, at in expected])
    seen = tables["product_events"].where(name.isin(*[e[2] for e in expected])).select(
        "event_name", F.when(name == "app_install", F.col("installation_id")).otherwise(F.col("user_id")).alias("who"), F.col("occurred_at").alias("at"))
    counted = wanted.join(seen, ["event_name", "who", "at"], "left_anti").groupBy("dataset_name", "check_name").agg(F.count(F.lit(1)).alias("violation_count"))
    names = fixed_rows(wanted.sparkSession, [(n, check) for n, check, *_ in expected], ["dataset_name", "check_name"])
    return names.join(counted, ["dataset_name", "check_name"], "left").select(
        "dataset_name", F.lit("reconciliation").alias("category"), "check_name", F.coalesce("violation_count", F.lit(0)).alias("violation_count"))


def snapshot_bounds(tables: Mapping[str, DataFrame], snapshot_at: Column, times: dict[str, Sequence[str]], expected: DataFrame) -> DataFrame:
    """Times not before the snapshot moment, and rows more or fewer than the delivery announced (dataset_name, expected_row_count).

    An empty table or one that was not announced breaks its scale by at least one.
    """
    out = []
    for n, columns in times.items():
        late = _any([F.coalesce(F.col(c) >= F.col("__snapshot"), F.lit(False)) for c in columns])
        rows = F.count(F.lit(1))
        announced = F.coalesce(expected.where(F.col("dataset_name") == n).agg(F.max("expected_row_count")).scalar(), F.lit(0))
        one = tables[n].withColumn("__snapshot", snapshot_at).agg(F.count_if(late).alias("late"), rows.alias("rows")).withColumn("announced", announced).select(F.array(
            F.struct(F.lit(f"{n}_before_snapshot").alias("check_name"), F.col("late").alias("violation_count")),
            F.struct(F.lit(f"{n}_scale").alias("check_name"), F.greatest(F.abs(F.col("rows") - F.col("announced")), F.when(F.col("rows") == 0, 1).otherwise(0)).cast("long").alias("violation_count")),
        ).alias("e"))
        out.append(one.select(F.lit(n).alias("dataset_name"), F.lit("snapshot").alias("category"), F.inline("e")))
    return stacked(out)


def check_results(parts: Sequence[DataFrame]) -> DataFrame:
    """The results table: verdict and JSON details per check."""
    return stacked([p.select(*RESULT) for p in parts]).withColumns({
        "passed": F.col("violation_count") == 0,
        "details": F.to_json(F.struct("check_name", "violation_count"))})
