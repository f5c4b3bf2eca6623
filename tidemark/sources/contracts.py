"""Source contracts: ordered columns per dataset with kind, nullability, domain and range."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    """One contract column.  ``kind`` is string, timestamp, date, integer, decimal or boolean."""

    name: str
    kind: str = "string"
    nullable: bool = False
    allowed: tuple[str, ...] | None = None
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class Contract:
    dataset: str
    key: str
    fields: tuple[Field, ...]
    expected_rows: int | None = None

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]


# The domains of the source contract.
PLATFORMS = ("ios", "android")
CHANNELS = ("organic", "paid_social", "paid_search", "referral", "content")
COUNTRIES = ("GB", "US", "CA", "AU", "DE", "FR", "IN", "SG", "OTHER")
EVENTS = ("app_install", "signup", "onboarding_started", "onboarding_completed", "session_started", "feature_used",
          "paywall_viewed", "trial_started", "subscription_started", "subscription_renewed", "cancellation_requested",
          "subscription_expired", "payment_failed")
FEATURES = ("ai_assistant", "smart_tasks", "document_summarizer", "focus_session", "ai_notes")
BILLING = ("monthly", "annual")
STATUSES = ("trialing", "active", "past_due", "expired", "cancel_at_period_end")
END_REASONS = ("trial_no_conversion", "payment_failure", "voluntary_cancellation")
TRANSACTION_TYPES = ("initial_charge", "renewal")
PAYMENT_STATUSES = ("succeeded", "failed")
VARIANTS = ("control", "treatment")
SPEND_TYPES = ("zero_direct", "paid_media", "indirect")
CAMPAIGNS = ("organic_unpaid", "always_on_social", "always_on_search", "referral_incentives", "content_program",
             "seasonal_push", "tactical_push")
RELEASE_TYPES = ("major", "minor", "patch")
ROLLOUTS = ("full", "phased")
FEATURE_AREAS = ("onboarding", "core_platform", "smart_tasks", "document_summarizer", "ai_notes", "ai_assistant", "focus_session")


def _required(kind: str, *names: str) -> tuple[Field, ...]:
    return tuple(Field(n, kind) for n in names)


def _optional(kind: str, *names: str) -> tuple[Field, ...]:
    return tuple(Field(n, kind, nullable=True) for n in names)


def _one_of(name: str, allowed: tuple[str, ...], nullable: bool = False) -> Field:
    return Field(name, "string", nullable, allowed)


CONTRACTS: dict[str, Contract] = {c.dataset: c for c in (
    Contract("installations", "installation_id", (
        *_required("string", "installation_id", "anonymous_id"), *_required("timestamp", "installed_at"),
        _one_of("platform", PLATFORMS), _one_of("acquisition_channel", CHANNELS), _one_of("country_code", COUNTRIES)), 100_000),
    Contract("users", "user_id", (
        *_required("string", "user_id", "installation_id", "anonymous_id"), *_required("timestamp", "signed_up_at"),
        *_optional("timestamp", "onboarding_started_at", "onboarding_completed_at")), 62_176),
    Contract("product_events", "event_id", (
        *_required("string", "event_id"), _one_of("event_name", EVENTS), *_required("timestamp", "occurred_at"),
        *_required("string", "installation_id", "anonymous_id"), *_optional("string", "user_id", "session_id"),
        _one_of("feature_name", FEATURES, nullable=True)), 3_502_815),
    Contract("subscriptions", "subscription_id", (
        *_required("string", "subscription_id", "user_id", "installation_id"), _one_of("billing_period", BILLING),
        Field("price_gbp", "decimal", low=0), _one_of("currency", ("GBP",)), _one_of("status", STATUSES),
        *_required("timestamp", "trial_started_at", "trial_ends_at"),
        *_optional("timestamp", "subscription_started_at", "current_period_start_at", "current_period_end_at",
                   "cancellation_requested_at", "expired_at"),
        *_required("boolean", "auto_renew"), _one_of("end_reason", END_REASONS, nullable=True)), 8_663),
    Contract("subscription_transactions", "transaction_id", (
        *_required("string", "transaction_id", "subscription_id", "user_id", "installation_id"),
        _one_of("transaction_type", TRANSACTION_TYPES), *_required("timestamp", "attempted_at"), _one_of("billing_period", BILLING),
        Field("amount_gbp", "decimal", low=0), _one_of("currency", ("GBP",)), _one_of("payment_status", PAYMENT_STATUSES),
        Field("billing_cycle_number", "integer", low=1), Field("attempt_number", "integer", low=1, high=2)), 9_350),
    Contract("experiment_assignments", "assignment_id", (
        *_required("string", "assignment_id", "experiment_id", "experiment_name", "user_id", "installation_id"),
        _one_of("randomization_unit", ("user",)), _one_of("variant", VARIANTS),
        Field("allocation_probability", "decimal", low=0, high=1), *_required("timestamp", "assignment_at"),
        *_optional("timestamp", "exposed_at"), *_required("timestamp", "experiment_start_at", "experiment_end_at"),
        *_required("string", "eligibility_rule", "assignment_trigger", "exposure_trigger", "hypothesis", "primary_metric",
                   "secondary_metric", "commercial_metric", "guardrail_metric"),
        Field("analysis_window_days", "integer", low=1)), 20_006),
    Contract("marketing_spend", "marketing_spend_id", (
        *_required("string", "marketing_spend_id"), *_required("date", "period_start", "period_end"),
        _one_of("acquisition_channel", CHANNELS), _one_of("spend_type", SPEND_TYPES), _one_of("campaign_type", CAMPAIGNS),
        Field("spend", "decimal", low=0), _one_of("currency", ("GBP",)),
        Field("impressions", "integer", True, low=0), Field("clicks", "integer", True, low=0)), 655),
    Contract("app_releases", "app_release_id", (
        *_required("string", "app_release_id", "release_key", "release_name"), Field("release_sequence", "integer", low=1),
        _one_of("platform", PLATFORMS), *_required("string", "version"), *_required("timestamp", "release_at"),
        _one_of("release_type", RELEASE_TYPES), _one_of("feature_area", FEATURE_AREAS), _one_of("rollout_strategy", ROLLOUTS),
        Field("rollout_days", "integer", low=0), *_required("timestamp", "rollout_complete_at"),
        _one_of("release_channel", ("production",)), *_required("string", "release_notes")), 16),
)}
