"""Validation as data: every broken clause is listed, and rows split into good and quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.frames import DAY
from riskweave.schemas import CHANNELS, LEVEL_ACTIONS, STATUSES

# Formats of the input contract.
CURRENCY = r"^[A-Z]{3}\z"
CONTROL = r"[\x00-\x1f\x7f]"
INSTANT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d([.,]\d{1,6})?)?(Z|[+-]\d\d(:?\d\d)?)\z"
KEY = r"^[\x21-\x7e]{1,200}\z"
SHA256 = r"^[0-9a-f]{64}\z"
MAX_AMOUNT = "9999999999999999.99"


def listed(clauses: dict[str, Column]) -> Column:
    """The names of the clauses that are broken (or unknown)."""
    return F.array_compact(
        F.array(*(F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in clauses.items()))
    )


def money_broken(text: Column) -> Column:
    """Positive, at most 16 whole digits, nothing below a hundredth."""
    value = text.try_cast("decimal(38,18)")
    tiny = text.rlike(r"\.[0-9]{18}[0-9]*[1-9]")
    return (
        value.isNull()
        | (value <= 0)
        | (value > F.lit(MAX_AMOUNT).cast("decimal(38,18)"))
        | (value != F.round(value, 2))
        | tiny
    )


def device_broken(device: Column) -> Column:
    return (F.trim(device) == "") | (F.length(device) > 200) | device.rlike(CONTROL)


def instant_broken(text: Column) -> Column:
    """A timestamp must carry its offset; wall time alone is refused."""
    return ~text.rlike(INSTANT) | F.try_to_timestamp(text).isNull()


def transaction_clauses() -> dict[str, Column]:
    return {
        "amount": money_broken(F.col("amount")),
        "currency": ~F.col("currency").rlike(CURRENCY),
        "device_id": device_broken(F.col("device_id")),
        "channel": ~F.col("channel").isin(*CHANNELS),
        "status": ~F.col("status").isin(*STATUSES),
        "timestamp": instant_broken(F.col("timestamp")),
    }


def validate_transactions(raw: DataFrame) -> DataFrame:
    """Adds ``violations`` and ``valid`` to rows of text fields."""
    checked = raw.withColumn("violations", listed(transaction_clauses()))
    return checked.withColumn("valid", F.size("violations") == 0)


def accepted(checked: DataFrame) -> DataFrame:
    """The good rows, typed: cents and UTC microseconds."""
    return checked.filter("valid").select(
        "*",
        (F.col("amount").cast("decimal(18,2)") * 100).cast("bigint").alias("cents"),
        F.unix_micros(F.to_timestamp("timestamp")).alias("us"),
    )


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter("NOT valid")


def label_violations(rows: DataFrame) -> DataFrame:
    clauses = {
        "available_before_event": F.col("available_us") < F.col("us"),
        "label_before_available": F.col("label_available_us") < F.col("available_us"),
        "label": ~F.col("label").isin(0, 1),
    }
    return rows.withColumn("violations", listed(clauses))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def activity_violations(rows: DataFrame, captured: DataFrame, limit: int = 10_000, days: int = 180) -> DataFrame:
    """Candidates whose captured activity breaks its contract.

    ``captured`` has a row for each activity row of a candidate: ``candidate_id`` and the row's
    ``transaction_id, customer_id, currency, us``. Activity must be of the candidate's customer and
    currency, strictly before it and less than ``days`` days older, without the candidate itself,
    without repeated transactions and of at most ``limit`` rows. Null fields break the clause they
    belong to. A candidate without activity breaks none.
    """
    own = rows.select(
        F.col("transaction_id").alias("candidate_id"),
        F.col("customer_id").alias("_customer"),
        F.col("currency").alias("_currency"),
        F.col("us").alias("_us"),
    )
    # One row for each transaction of a candidate first, so that a hot candidate combines early.
    whole = F.coalesce((F.col("us") < F.col("_us")) & (F.col("us") > F.col("_us") - days * DAY), F.lit(False))
    scoped = F.col("customer_id").eqNullSafe(F.col("_customer")) & F.col("currency").eqNullSafe(F.col("_currency"))
    each = (
        captured.join(own, "candidate_id")
        .groupBy("candidate_id", "transaction_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_or(~scoped).alias("foreign"),
            F.bool_or(~whole).alias("outside"),
        )
    )
    found = each.groupBy("candidate_id").agg(
        F.sum("n").alias("rows"),
        F.bool_or(F.col("n") > 1).alias("repeated"),
        F.bool_or("foreign").alias("foreign"),
        F.bool_or("outside").alias("outside"),
        F.bool_or(F.col("transaction_id").eqNullSafe(F.col("candidate_id"))).alias("itself"),
    )
    clauses = {
        "activity_limit_exceeded": F.coalesce(F.col("rows") > limit, F.lit(False)),
        "duplicate_activity": F.coalesce("repeated", F.lit(False)),
        "activity_out_of_scope": F.coalesce("foreign", F.lit(False)),
        "activity_not_prior": F.coalesce("outside", F.lit(False)),
        "candidate_in_activity": F.coalesce("itself", F.lit(False)),
    }
    joined = rows.join(found, rows["transaction_id"] == found["candidate_id"], "left")
    return joined.select(*(rows[c] for c in rows.columns), listed(clauses).alias("violations"))


def context_violations(rows: DataFrame, observations: DataFrame) -> DataFrame:
    """Candidates whose captured context breaks its contract.

    Rows carry ``us, captured_us, profile_as_of_us, profile_version``; observations carry
    ``transaction_id, admitted_version``. A candidate must not be part of its own revision.
    """
    own = observations.select("transaction_id", "admitted_version")
    joined = rows.join(own, "transaction_id", "left")
    admitted = F.col("admitted_version") <= F.col("profile_version")
    clauses = {
        "captured_before_event": F.col("captured_us") < F.col("us"),
        "revision_after_event": F.coalesce(F.col("profile_as_of_us") > F.col("us"), F.lit(False)),
        "already_admitted": F.coalesce(admitted, F.lit(False)),
    }
    return joined.withColumn("violations", listed(clauses)).drop("admitted_version")


def score_broken(score: Column) -> Column:
    return score.isNull() | F.isnan(score) | ~score.between(0.0, 1.0)


def level_action_broken(level: Column, action: Column) -> Column:
    pairs = [F.struct(F.lit(a), F.lit(b)) for a, b in LEVEL_ACTIONS]
    return ~F.struct(level, action).isin(*pairs)


def envelope_violations(evaluations: DataFrame) -> DataFrame:
    """The stored document must agree with its columns and with its own status."""
    doc = F.col("response_json")

    def path(name: str) -> Column:
        return F.get_json_object(doc, f"$.{name}")

    def differs(name: str, column: str) -> Column:
        return ~path(name).eqNullSafe(F.col(column).cast("string"))

    status, score = path("risk.status"), path("risk.score")
    decided = score.isNotNull() | path("risk.level").isNotNull() | path(
        "risk.suggested_action"
    ).isNotNull()
    number = score.try_cast("double")
    clauses = {
        "evaluation_id": differs("evaluation_id", "evaluation_id"),
        "transaction_id": differs("transaction_id", "transaction_id"),
        "customer_id": differs("customer_id", "customer_id"),
        "currency": differs("currency", "currency"),
        "risk_transaction_id": differs("risk.transaction_id", "transaction_id"),
        "not_experimental": ~path("risk.production_eligible").eqNullSafe(F.lit("false"))
        | ~path("risk.operational_action_executed").eqNullSafe(F.lit("false")),
        "status": ~F.coalesce(status.isin("SCORED", "INSUFFICIENT_EVIDENCE"), F.lit(False)),
        "decision_without_evidence": F.coalesce(
            (status == "INSUFFICIENT_EVIDENCE") & decided, F.lit(False)
        ),
        "score": F.coalesce(status == "SCORED", F.lit(False)) & score_broken(number),
    }
    return evaluations.withColumn("violations", listed(clauses))


def digest_mismatch(artifacts: DataFrame, payload: str, digest: str) -> DataFrame:
    return artifacts.filter(~F.sha2(F.col(payload), 256).eqNullSafe(F.col(digest)))


def history_difference(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of an append-only table that changed or vanished since the older snapshot."""
    columns = [c for c in old.columns if c not in keys]

    def hashed(rows: DataFrame, name: str) -> DataFrame:
        text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return rows.select(*keys, F.sha2(text, 256).alias(name))

    joined = hashed(old, "_old").join(hashed(new, "_new"), list(keys), "left")
    change = F.when(F.col("_new").isNull(), "VANISHED").when(
        F.col("_new") != F.col("_old"), "CHANGED"
    )
    return joined.select(*keys, change.alias("change")).filter("change IS NOT NULL")


def model_version_violations(models: DataFrame) -> DataFrame:
    """Digest of 64 lowercase hex digits, named metrics, each in [0, 1]."""
    names = F.map_keys("metrics")
    clauses = {
        "artifact_sha256": ~F.col("artifact_sha256").rlike(SHA256),
        "metric_name": F.exists(names, lambda n: F.trim(n) == "")
        | (F.size(F.array_distinct(names)) != F.size(names)),
        "metric_value": F.exists(F.map_values("metrics"), score_broken),
    }
    return models.withColumn("violations", listed(clauses))


def benchmark_violations(rows: DataFrame, features: tuple[str, ...], amount: str) -> DataFrame:
    finite = [F.isnan(F.col(f)) | (F.abs(F.col(f)) == float("inf")) for f in features]
    clauses = {
        "not_finite": F.exists(F.array(*finite), lambda x: F.coalesce(x, F.lit(True))),
        "negative_amount": F.col(amount) < 0,
    }
    return rows.withColumn("violations", listed(clauses))
