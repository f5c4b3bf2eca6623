"""The eight datasets as raw tables with lineage columns, the rows of them that pass their row rules, and the star: stored once each."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import days
from tidemark.functions.canonical import row_hash
from tidemark.functions.lazy import LazyFrames
from tidemark.operators.quality import row_violation
from tidemark.operators.star import DATASET_OF, LINEAGE, build_star
from tidemark.sources.contracts import BILLING, EVENTS, PAYMENT_STATUSES, PLATFORMS, RELEASE_TYPES, ROLLOUTS, STATUSES, TRANSACTION_TYPES, VARIANTS, Contract, Field
from tidemark.sources.stored import StoredTables, store_root
from tidemark.sources.tables import Warehouse

BATCH = 1
BUILD = 1
VALIDATION_RUN = 1
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _ids(*names: str, nullable: bool = False) -> tuple[Field, ...]:
    return tuple(Field(n, "integer", nullable) for n in names)


def _times(*names: str, nullable: bool = False) -> tuple[Field, ...]:
    return tuple(Field(n, "timestamp", nullable) for n in names)


def _words(name: str, *allowed: str, nullable: bool = False) -> Field:
    return Field(name, "string", nullable, allowed or None)


# Row rules of the datasets as they appear in these tables; same shape as the CSV contract.
RULES: dict[str, Contract] = {c.dataset: c for c in (
    Contract("installations", "installation_id", (*_ids("installation_id"), _words("anonymous_id"), *_times("installed_at"),
             _words("platform", *PLATFORMS), _words("acquisition_channel", *SEGMENTS), _words("country_code", *(f"NATION_{i}" for i in range(25))))),
    Contract("users", "user_id", (*_ids("user_id", "installation_id"), _words("anonymous_id"), *_times("signed_up_at"),
             *_times("onboarding_started_at", "onboarding_completed_at", nullable=True))),
    Contract("product_events", "event_id", (*_ids("event_id"), _words("event_name", *EVENTS), *_times("occurred_at"), *_ids("installation_id"),
             _words("anonymous_id"), *_ids("user_id", nullable=True), _words("session_id", nullable=True),
             _words("feature_name", *(f"feature_{i}" for i in range(5)), nullable=True))),
    Contract("subscriptions", "subscription_id", (*_ids("subscription_id", "user_id", "installation_id"), _words("billing_period", *BILLING),
             Field("price_gbp", "decimal", low=0), _words("status", *STATUSES), *_times("trial_started_at", "trial_ends_at"),
             *_times("subscription_started_at", "expired_at", nullable=True))),
    Contract("subscription_transactions", "transaction_id", (_words("transaction_id"), *_ids("subscription_id", "user_id", "installation_id"),
             _words("transaction_type", *TRANSACTION_TYPES), *_times("attempted_at"), Field("amount_gbp", "decimal", low=0),
             _words("payment_status", *PAYMENT_STATUSES), Field("billing_cycle_number", "integer", low=1), Field("attempt_number", "integer", low=1, high=2))),
    Contract("experiment_assignments", "assignment_id", (_words("assignment_id"), _words("experiment_id"), *_ids("user_id", "installation_id"),
             _words("variant", *VARIANTS), Field("allocation_probability", "decimal", low=0, high=1), *_times("assignment_at"),
             *_times("exposed_at", nullable=True), *_times("experiment_start_at", "experiment_end_at"), _words("primary_metric"),
             Field("analysis_window_days", "integer", low=1))),
    Contract("marketing_spend", "marketing_spend_id", (_words("marketing_spend_id"), Field("period_start", "date"), Field("period_end", "date"),
             _words("acquisition_channel", *SEGMENTS), Field("spend", "decimal", low=0), Field("impressions", "integer", True, low=0), Field("clicks", "integer", True, low=0))),
    Contract("app_releases", "app_release_id", (*_ids("app_release_id"), _words("release_key"), _words("release_name"), Field("release_sequence", "integer", low=1),
             _words("platform", *PLATFORMS), _words("version"), *_times("release_at"), _words("release_type", *RELEASE_TYPES),
             _words("rollout_strategy", *ROLLOUTS), Field("rollout_days", "integer", low=0), *_times("rollout_complete_at"))),
)}


#: A dataset's key within its batch.
BUSINESS_KEYS = {n: ["ingestion_batch_id", c.key] for n, c in RULES.items()}


class Layers:
    """Raw, staged and star tables, each written when first read; a layer is built from the stored one below it."""

    def __init__(self, w: Warehouse):
        self.w = w

    def _raw(self, dataset: str, df: DataFrame, row_number) -> DataFrame:
        columns = RULES[dataset].columns
        rows = df.select(*columns, row_number.cast("long").alias("source_row_number"))
        # The digest's 32 bytes, not their 64 hex digits: every layer stores them and every join of whole rows moves them.
        return rows.select("*", F.unhex(row_hash(rows, dataset, columns)).alias("row_hash"), F.lit(BATCH).cast("long").alias("ingestion_batch_id"))

    @cached_property
    def root(self) -> str:
        return store_root(self.w.spark, self.w.path)

    def _store(self, layer: str, frames: LazyFrames, keys: dict[str, list[str]], stamp: list[str], shared: bool = False) -> StoredTables:
        return StoredTables(self.w.spark, f"{self.root}/{layer}", frames, keys, stamp, shared)

    @cached_property
    def delivered(self) -> LazyFrames:
        """The rows as they are delivered, before any layer is stored."""
        w, c = self.w, F.col

        def events() -> DataFrame:
            return w.product_events.withColumn("anonymous_id", F.concat(F.lit("anon_"), c("installation_id").cast("string")))

        def subscriptions() -> DataFrame:
            o, at, status = w.table("orders"), c("o_orderdate"), c("o_orderstatus")
            return o.select(
                c("o_orderkey").alias("subscription_id"), c("o_custkey").alias("user_id"), c("o_custkey").alias("installation_id"),
                F.when(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "annual").otherwise("monthly").alias("billing_period"),
                c("o_totalprice").cast("decimal(18,2)").alias("price_gbp"),
                F.when(status == "F", "expired").when(status == "O", "active").otherwise("trialing").alias("status"),
                (at - days(7)).alias("trial_started_at"), at.alias("trial_ends_at"), F.when(status != "P", at).alias("subscription_started_at"),
                F.when(status == "F", at + days(((c("o_orderkey") * 13) % 500).cast("int"))).alias("expired_at"))

        def transactions() -> DataFrame:
            return w.transactions.select(
                "*", F.concat_ws("_", c("subscription_id").cast("string"), c("billing_cycle_number").cast("string")).alias("transaction_id"),
                c("user_id").alias("installation_id"), F.lit(1).alias("attempt_number"))

        def assignments() -> DataFrame:
            x = w.experiments.select("experiment_id", c("start_at").alias("experiment_start_at"), c("end_at").alias("experiment_end_at"),
                                     "primary_metric", "analysis_window_days")
            return w.experiment_assignments.withColumn("allocation_probability", c("allocation_probability").cast("decimal(9,6)")).join(x, "experiment_id")

        def spend() -> DataFrame:
            return w.marketing_spend.withColumn("marketing_spend_id", F.concat_ws("_", c("period_start").cast("string"), "acquisition_channel"))

        def releases() -> DataFrame:
            day = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + days((c("p_partkey") % 30).cast("int"))
            size, even = c("p_size"), c("p_partkey") % 2 == 0
            return w.table("part").select(
                c("p_partkey").alias("app_release_id"), c("p_brand").alias("release_key"), c("p_name").alias("release_name"), size.alias("release_sequence"),
                F.when(even, "ios").otherwise("android").alias("platform"), F.concat(F.lit("1."), size.cast("string")).alias("version"), day.alias("release_at"),
                F.when(c("p_type") == "ECONOMY", "major").when(c("p_type") == "SMALL", "minor").otherwise("patch").alias("release_type"),
                F.when(even, "full").otherwise("phased").alias("rollout_strategy"), (size % 10).alias("rollout_days"),
                (day + days((size % 10 - 1).cast("int"))).alias("rollout_complete_at"))

        # Record numbers: unique per delivered record, derived from its key.
        source = {
            "installations": (lambda: w.installations, "installation_id + 2"), "users": (lambda: w.users, "user_id + 2"),
            "product_events": (events, "event_id + 2"), "subscriptions": (subscriptions, "subscription_id + 2"),
            "subscription_transactions": (transactions, "subscription_id * 8 + billing_cycle_number + 2"),
            "experiment_assignments": (assignments, "user_id * 4 + ascii(right(experiment_id, 1)) - 96"),
            "marketing_spend": (spend, "datediff(period_start, DATE'2023-01-01') * 128 + ascii(acquisition_channel)"),
            "app_releases": (releases, "app_release_id + 2"),
        }
        return LazyFrames({n: (lambda n=n, f=f, e=e: self._raw(n, f(), F.expr(e))) for n, (f, e) in source.items()})

    @cached_property
    def raw(self) -> StoredTables:
        """The delivered rows, each stored with the verdict of its dataset's row rules."""
        frames = LazyFrames({n: (lambda n=n: self.delivered[n].withColumn("accepted", ~row_violation(RULES[n]))) for n in RULES})
        return self._store("raw", frames, BUSINESS_KEYS, [c for c in LINEAGE if c != "validation_run_id"])

    @cached_property
    def staging(self) -> StoredTables:
        """Raw rows whose stored verdict is that they break no row rule, stamped with the validation run.

        They are read from the raw table's files: a row and its hash are not written a second time for one constant column.
        """
        frames = LazyFrames({n: (lambda n=n: self.raw[n].where("accepted").drop("accepted").withColumn("validation_run_id", F.lit(VALIDATION_RUN).cast("long")))
                             for n in RULES})
        return self._store("staging", frames, BUSINESS_KEYS, LINEAGE, shared=True)

    @cached_property
    def star(self) -> StoredTables:
        """The star's tables; facts and dimensions with rows of one dataset carry that dataset's leaves."""
        return self._store("star", self._star, {t: BUSINESS_KEYS[n] for t, n in DATASET_OF.items()}, LINEAGE)

    @property
    def _star(self) -> LazyFrames:
        # Dimensions that facts resolve against are read back from their files.
        return build_star(self.staging, BUILD, self.star_table)

    def star_table(self, name: str) -> DataFrame:
        return self.star[name]


def layers(w: Warehouse) -> Layers:
    """The layers of one warehouse, described once per query."""
    if not hasattr(w, "_layers"):
        w._layers = Layers(w)
    return w._layers
