"""Additive model contributions and their readable form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.text import general6, signed6
from riskweave.operators.validate import listed
from riskweave.schemas import FEATURE_NAMES

MARGIN_ATOL, MARGIN_RTOL, SCORE_ATOL = 1e-5, 1e-6, 1e-6
TOP = 5

# Flags that turn a feature's number into a placeholder.
_BASELINE = ("profile_missing", "baseline_insufficient")
AVAILABILITY = {
    "amount_vs_customer_median": _BASELINE,
    "amount_vs_customer_mean": _BASELINE,
    "robust_amount_deviation": _BASELINE,
    "mad_zero": _BASELINE,
    "mad_floor_applied": _BASELINE,
    "amount_vs_p95": _BASELINE,
    "short_term_vs_long_term_amount_ratio": (*_BASELINE, "short_baseline_insufficient"),
    "new_recipient": _BASELINE,
    "unusual_hour": (*_BASELINE, "typical_hours_missing"),
    "hour_deviation": (*_BASELINE, "typical_hours_missing"),
    "transactions_last_5_min": ("activity_history_missing",),
    "transactions_last_10_min": ("activity_history_missing",),
    "transactions_last_hour": ("activity_history_missing",),
    "recipient_transactions_last_hour": ("activity_history_missing", "recipient_activity_missing"),
    "recipient_observed_age_days": ("recipient_activity_missing",),
    "device_changed": ("activity_history_missing", "device_change_missing"),
    "device_not_seen_before": ("activity_history_missing",),
    "days_since_last_transfer": ("activity_history_missing",),
}

# The display label of every feature.
LABELS = {
    "amount": "Transaction amount in the captured currency",
    "profile_missing": "Profile absence indicator",
    "baseline_insufficient": "Insufficient baseline indicator",
    "long_history_count": "Admitted long-window observation count",
    "short_history_count": "Admitted short-window observation count",
    "amount_vs_customer_median": "Amount divided by admitted long-window median",
    "amount_vs_customer_mean": "Amount divided by admitted long-window mean",
    "robust_amount_deviation": "Absolute amount deviation divided by floored MAD",
    "mad_zero": "Zero MAD indicator",
    "mad_floor_applied": "MAD denominator floor indicator",
    "amount_vs_p95": "Amount divided by admitted long-window p95",
    "short_term_vs_long_term_amount_ratio": "Short-window median divided by long-window median",
    "short_baseline_insufficient": "Insufficient short baseline indicator",
    "new_recipient": "Recipient absent from admitted history indicator",
    "unusual_hour": "Hour outside frequency-qualified admitted hours indicator",
    "hour_deviation": "Distance to nearest typical admitted hour",
    "typical_hours_missing": "Unavailable typical hours indicator",
    "transactions_last_5_min": "Captured prior transfers strictly within five minutes",
    "transactions_last_10_min": "Captured prior transfers strictly within ten minutes",
    "transactions_last_hour": "Captured prior transfers strictly within one hour",
    "recipient_transactions_last_hour": "Captured prior recipient transfers within one hour",
    "activity_history_count": "Captured raw activity count",
    "activity_history_missing": "Unavailable captured activity indicator",
    "recipient_observed_age_days": "Recipient observed activity age in bounded history, in days",
    "recipient_activity_missing": "Unavailable recipient activity indicator",
    "device_changed": "Device differs from last unambiguous captured device indicator",
    "device_change_missing": "Unavailable device comparison indicator",
    "device_not_seen_before": "Device absent from captured activity indicator",
    "days_since_last_transfer": "Days since last captured transfer",
}


def sigmoid(margin: Column) -> Column:
    small = F.exp(-F.abs(margin))
    return F.when(margin >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def linear_contributions(
    features: DataFrame,
    coefficients: Sequence[float],
    intercept: float,
    means: Sequence[float] | None = None,
    names: Sequence[str] = FEATURE_NAMES,
) -> DataFrame:
    """Adds ``contributions`` (in feature order), ``base_value``, ``raw_margin`` and ``score``.

    A contribution is measured against the mean input; without means, against zero.
    """
    means = means or [0.0] * len(names)
    base = intercept + sum(c * m for c, m in zip(coefficients, means, strict=True))
    parts = [
        (F.col(n) - F.lit(float(m))) * F.lit(float(c)) if m else F.col(n) * F.lit(float(c))
        for n, c, m in zip(names, coefficients, means, strict=True)
    ]
    margin = F.lit(float(intercept))
    for name, c in zip(names, coefficients, strict=True):
        margin = margin + F.col(name) * F.lit(float(c))
    return features.withColumns(
        {
            "contributions": F.array(*parts),
            "base_value": F.lit(float(base)),
            "raw_margin": margin,
            "score": sigmoid(margin),
        }
    )


def with_consistency(explained: DataFrame) -> DataFrame:
    """Adds ``consistent``: contributions rebuild the margin, and the margin gives the score."""
    rebuilt = F.aggregate("contributions", F.col("base_value"), lambda a, v: a + v)
    checked = explained.withColumn("_rebuilt", rebuilt)
    margin, rebuilt = F.col("raw_margin"), F.col("_rebuilt")
    allowed = F.greatest(
        F.lit(MARGIN_ATOL), F.lit(MARGIN_RTOL) * F.greatest(F.abs(rebuilt), F.abs(margin))
    )
    good = (
        (F.abs(rebuilt - margin) <= allowed)
        & (F.abs(sigmoid(margin) - F.col("score")) <= SCORE_ATOL)
        & (F.size("contributions") == len(FEATURE_NAMES))
    )
    return checked.withColumn("consistent", F.coalesce(good, F.lit(False))).drop("_rebuilt")


def evaluation_differences(
    explained: DataFrame, evaluated: DataFrame, names: Sequence[str] = FEATURE_NAMES
) -> DataFrame:
    """Adds ``violations``: where an explanation is not one of the stored evaluation.

    ``explained`` has ``transaction_id``, the features, ``score`` and ``model_version``; ``evaluated``
    has ``transaction_id``, ``vector`` (in feature order), ``score`` and ``model_version``. An
    explanation of a row that was never evaluated says ``not_evaluated`` only. NULLs equal NULLs.
    """
    stored = evaluated.select(
        "transaction_id",
        F.struct(F.col("vector").cast("array<double>").alias("vector"), "score", "model_version").alias("_stored"),
    )
    vector = F.array(*(F.col(n).cast("double") for n in names))
    close = F.abs(F.col("score") - F.col("_stored.score")) <= SCORE_ATOL
    both_null = F.col("score").isNull() & F.col("_stored.score").isNull()
    known = F.col("_stored").isNotNull()
    clauses = {
        "not_evaluated": ~known,
        "vector": known & ~F.col("_stored.vector").eqNullSafe(vector),
        "model_version": known & ~F.col("_stored.model_version").eqNullSafe(F.col("model_version")),
        "score": known & ~F.coalesce(close | both_null, F.lit(False)),
    }
    joined = explained.join(stored, "transaction_id", "left")
    return joined.withColumn("violations", listed(clauses)).drop("_stored")


def top_contributions(explained: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` largest contributions per row; equal sizes keep the feature order."""
    entries = []
    for i, name in enumerate(FEATURE_NAMES):
        flags = AVAILABILITY.get(name, ())
        missing = F.array_compact(F.array(*(F.when(F.col(f) == 1, f) for f in flags)))
        part = F.get("contributions", F.lit(i))
        entries.append(
            F.struct(
                (-F.abs(part)).alias("size"),
                F.lit(i).alias("place"),
                F.lit(name).alias("feature"),
                F.lit(LABELS[name]).alias("label"),
                F.col(name).alias("value"),
                part.alias("contribution"),
                (missing if flags else F.array().cast("array<string>")).alias("missing"),
            )
        )
    # The parts of the sentences below.
    best = F.slice(F.sort_array(F.array(*entries)), 1, k)
    rows = explained.select("transaction_id", F.posexplode_outer(best).alias("rank", "c"))
    value, part = F.col("c.value"), F.col("c.contribution")
    fact = F.when(
        F.size("c.missing") > 0,
        F.concat(
            "c.label",
            F.lit(": unavailable; encoded value "),
            general6(value),
            F.lit(" is a placeholder."),
        ),
    ).otherwise(F.concat("c.label", F.lit(": encoded value "), general6(value), F.lit(".")))
    direction = (
        F.when(part > 0, "adds to").when(part < 0, "subtracts from").otherwise("does not change")
    )
    return rows.select(
        "transaction_id",
        (F.col("rank") + 1).alias("rank"),
        F.col("c.feature").alias("feature"),
        value.alias("value"),
        part.alias("contribution"),
        F.array_join("c.missing", ",").alias("missing"),
        F.concat(
            fact,
            F.lit(" Model attribution "),
            direction,
            F.lit(" the raw margin ("),
            signed6(part),
            F.lit(")."),
        ).alias("message"),
    )
