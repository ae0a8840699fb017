"""Risk score, abstention and banded decisions. Scores are evidence, not probabilities."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.text import fingerprint
from riskweave.operators.rules import RULE_CODES, RulePolicy
from riskweave.schemas import DECISION_VERSION, LEVEL_ACTIONS, RISK_VERSION, RULE_VERSION

STRATEGIES = ("rules_only", "ml_only", "hybrid")


@dataclass(frozen=True)
class DecisionPolicy:
    medium: float = 0.35
    high: float = 0.65
    critical: float = 0.85

    def __post_init__(self) -> None:
        if not 0 < self.medium < self.high < self.critical < 1:
            raise ValueError("bands must be strictly ordered inside (0, 1)")


# Default weights and bands, and the keys of the policy document that is digested.
@dataclass(frozen=True)
class RiskPolicy:
    strategy: str = "hybrid"
    model_weight: float = 0.5
    rule_weights: tuple[float, ...] = (0.4, 0.15, 0.25, 0.1, 0.1)
    rules: RulePolicy = field(default_factory=RulePolicy)
    decision: DecisionPolicy = field(default_factory=DecisionPolicy)

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError("unknown strategy")
        if not 0 <= self.model_weight <= 1:
            raise ValueError("the model weight must be in [0, 1]")
        if self.strategy == "hybrid" and self.model_weight in (0, 1):
            raise ValueError("hybrid needs both parts")
        weights = self.rule_weights
        if len(weights) != len(RULE_CODES) or any(not 0 < w <= 1 for w in weights):
            raise ValueError("one positive weight per rule")
        if abs(math.fsum(weights) - 1) > 1e-12:
            raise ValueError("rule weights must sum to one")

    @property
    def digest(self) -> str:
        bands = self.decision
        return fingerprint(
            {
                "strategy": self.strategy,
                "model_weight": float(self.model_weight),
                "rule_weights": [float(w) for w in self.rule_weights],
                "rules": {
                    "amount_median_ratio": float(self.rules.amount_median_ratio),
                    "prior_transfers_5_min": self.rules.prior_transfers_5_min,
                },
                "decision": {
                    "medium": float(bands.medium),
                    "high": float(bands.high),
                    "critical": float(bands.critical),
                    "version": DECISION_VERSION,
                },
                "version": RISK_VERSION,
                "rule_codes": list(RULE_CODES),
                "rule_version": RULE_VERSION,
                "missing_policy": "abstain_if_required_rule_unavailable",
            }
        )


def rule_score(rules: Column, weights: tuple[float, ...]) -> Column:
    """Weighted share of matched rules; NULL when any rule could not be evaluated.

    The possible sums are few, so each is computed once with exact summation and looked up by the
    set of matched rules.
    """
    whole = math.fsum(weights)
    sums = [
        math.fsum(w for i, w in enumerate(weights) if mask >> i & 1) / whole
        for mask in range(1 << len(weights))
    ]
    mask = F.lit(0)
    for i in range(len(weights)):
        hit = (F.get(rules, F.lit(i))["status"] == "MATCHED").cast("int")
        mask = mask + hit * (1 << i)
    known = ~F.exists(rules, lambda r: r["status"] == "NOT_EVALUATED")
    return F.when(known, F.get(F.array(*(F.lit(s) for s in sums)), mask))


def combine(policy: RiskPolicy, rules: Column, model: Column | None) -> Column:
    """The strategy's score; NULL whenever a required part is missing."""
    if policy.strategy == "rules_only":
        return rules
    if model is None:
        raise ValueError("this strategy needs a model score")
    if policy.strategy == "ml_only":
        return model
    weight = policy.model_weight
    return F.when(rules.isNotNull(), F.lit(weight) * model + F.lit(1 - weight) * rules)


def level(score: Column, policy: DecisionPolicy = DecisionPolicy()) -> Column:
    return (
        F.when(score >= policy.critical, "CRITICAL")
        .when(score >= policy.high, "HIGH")
        .when(score >= policy.medium, "MEDIUM")
        .when(score.isNotNull(), "LOW")
    )


def action(band: Column) -> Column:
    chain = F
    for name, act in LEVEL_ACTIONS:
        chain = chain.when(band == name, act)
    return chain


def risk(
    ruled: DataFrame, policy: RiskPolicy = RiskPolicy("rules_only"), model: Column | None = None
) -> DataFrame:
    """Adds score, band, action, status and the rules that could not be evaluated."""
    scored = ruled.withColumn("rule_score", rule_score(F.col("rules"), policy.rule_weights))
    scored = scored.withColumn("score", combine(policy, F.col("rule_score"), model))
    scored = scored.withColumn("level", level(F.col("score"), policy.decision))
    unavailable = F.transform(
        F.filter("rules", lambda r: r["status"] == "NOT_EVALUATED"), lambda r: r["code"]
    )
    return scored.withColumns(
        {
            "suggested_action": action(F.col("level")),
            "unavailable_rules": F.array_join(unavailable, ","),
            "status": F.when(F.col("score").isNotNull(), "SCORED").otherwise(
                "INSUFFICIENT_EVIDENCE"
            ),
            "strategy": F.lit(policy.strategy),
            "risk_version": F.lit(RISK_VERSION),
            "risk_policy_sha256": F.lit(policy.digest),
        }
    )
