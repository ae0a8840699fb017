"""Explicit schemas. Nothing is inferred when a table is read."""

from __future__ import annotations

# DDL strings; Spark parses them when they are handed to a reader.
CUSTOMERS = "customer_id string, created_at timestamp, timezone string"
TRANSACTIONS = (
    "transaction_id string, customer_id string, recipient_id string, amount decimal(18,2), "
    "currency string, timestamp timestamp, channel string, device_id string, status string"
)
LABELED_EVENTS = (
    TRANSACTIONS + ", available_at timestamp, label_available_at timestamp, label int"
)
PROFILE_REVISIONS = (
    "customer_id string, currency string, version int, as_of timestamp, timezone string, "
    "long_window_days int, short_window_days int, admission_workflow_verified boolean, "
    "admission_policy_version string, learning_decision_id string"
)
PROFILE_OBSERVATIONS = (
    "transaction_id string, customer_id string, currency string, admitted_version int, ordinal int"
)
EVALUATIONS = (
    "evaluation_id string, transaction_id string, customer_id string, currency string, "
    "actor_id string, created_at timestamp, response_json string"
)
CASES = "case_id string, transaction_id string, assessment_id string, created_at timestamp"
TRANSITIONS = (
    "case_id string, sequence int, previous string, target string, actor_id string, "
    "timestamp timestamp"
)
FEEDBACK = (
    "feedback_id string, case_id string, actor_id string, verdict string, timestamp timestamp, "
    "comment string, sequence int"
)
LEARNING_DECISIONS = (
    "decision_id string, customer_id string, currency string, actor_id string, kind string, "
    "action string, reason string, policy_version string, profile_version_before int, "
    "profile_version_after int, created_at timestamp, response_json string"
)
LEARNING_EVIDENCE = (
    "decision_id string, case_id string, feedback_id string, transaction_id string, "
    "reviewer_id string"
)
DOMAIN_EVENTS = (
    "event_id string, event_type string, aggregate_id string, occurred_at timestamp, "
    "correlation_id string, payload map<string,string>, schema_version int, attempts int, "
    "published_at timestamp"
)
DELIVERY = (
    "event_id string, token string, lease_until timestamp, available_at timestamp, "
    "completed_at timestamp, dead_at timestamp, last_error string"
)
RECEIPTS = "consumer_id string, event_id string, recorded_at timestamp"
IDEMPOTENCY = (
    "principal_id string, key string, request_sha256 string, transaction_id string, "
    "response_json string, status_code int, created_at timestamp"
)
MODEL_VERSIONS = (
    "version string, feature_version string, trained_at timestamp, artifact_sha256 string, "
    "status string, metrics map<string,double>"
)
# The paths of a stored evaluation document that queries read.
EVALUATION_DOCUMENT = (
    "evaluation_id string, transaction_id string, customer_id string, currency string, "
    "actor_id string, risk struct<status:string, score:double, level:string, "
    "suggested_action:string, profile_version:int, policy:struct<strategy:string>>"
)

BENCHMARK_FEATURES = tuple(f"V{i}" for i in range(1, 29)) + ("Amount",)
BENCHMARK_CSV = ", ".join(f"{name} double" for name in ("Time", *BENCHMARK_FEATURES, "Class"))

# The ordered feature contract `behavior-v1`.
FEATURE_NAMES = (
    "amount",
    "profile_missing",
    "baseline_insufficient",
    "long_history_count",
    "short_history_count",
    "amount_vs_customer_median",
    "amount_vs_customer_mean",
    "robust_amount_deviation",
    "mad_zero",
    "mad_floor_applied",
    "amount_vs_p95",
    "short_term_vs_long_term_amount_ratio",
    "short_baseline_insufficient",
    "new_recipient",
    "unusual_hour",
    "hour_deviation",
    "typical_hours_missing",
    "transactions_last_5_min",
    "transactions_last_10_min",
    "transactions_last_hour",
    "recipient_transactions_last_hour",
    "activity_history_count",
    "activity_history_missing",
    "recipient_observed_age_days",
    "recipient_activity_missing",
    "device_changed",
    "device_change_missing",
    "device_not_seen_before",
    "days_since_last_transfer",
)

# Contract versions and enumerations.
FEATURE_VERSION = "behavior-v1"
RULE_VERSION = "rules-v1"
RISK_VERSION = "risk-v1-experimental"
SEQUENCE_VERSION = "sequence-v1-experimental"
DECISION_VERSION = "decision-v1-experimental"
LEARNING_POLICY_VERSION = "profile-learning-v1-experimental"
PROFILE_READ_VERSION = "profile-read-v1"
CHANNELS = ("MOBILE", "WEB", "ATM", "BRANCH")
STATUSES = ("RECEIVED", "EVALUATED")
VERDICTS = ("CONFIRMED_FRAUD", "LEGITIMATE", "NEEDS_INVESTIGATION")
CASE_STATES = ("OPEN", "UNDER_REVIEW", "CONFIRMED_FRAUD", "LEGITIMATE", "CLOSED")
CASE_MOVES = (
    ("OPEN", "UNDER_REVIEW"),
    ("UNDER_REVIEW", "CONFIRMED_FRAUD"),
    ("UNDER_REVIEW", "LEGITIMATE"),
    ("CONFIRMED_FRAUD", "CLOSED"),
    ("LEGITIMATE", "CLOSED"),
)
LEVEL_ACTIONS = (
    ("LOW", "ALLOW"),
    ("MEDIUM", "STEP_UP_VERIFICATION"),
    ("HIGH", "HOLD_AND_REVIEW"),
    ("CRITICAL", "URGENT_REVIEW"),
)
