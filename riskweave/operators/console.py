"""Worklists, roll-ups, reconciliation and evidence reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.frames import DAY
from riskweave.operators.cases import case_state, latest

MAX_PAGE = 100


def in_scope(rows: DataFrame, scope: DataFrame | None) -> DataFrame:
    """No scope table: everything. An empty one: nothing."""
    if scope is None:
        return rows
    return rows.join(scope.select("customer_id"), "customer_id", "left_semi")


def worklist(
    tx: DataFrame,
    evaluations: DataFrame,
    cases: DataFrame,
    transitions: DataFrame,
    *,
    limit: int,
    cursor: tuple[int, int] | None = None,
) -> DataFrame:
    """One page, newest first, with each transaction's latest evaluation and case.

    The page is taken first (a top-k, at most 101 rows) and broadcast, so the larger tables are
    only filtered by it. ``next_page`` marks the last row when more follow: its (us, id) is the
    cursor of the next page.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError("a page has 1 to 100 rows")
    if cursor is not None:
        us, ident = cursor
        # The first clause alone can be pushed into the scan.
        tx = tx.filter(F.col("us") <= us).filter(
            (F.col("us") < us) | (F.col("transaction_id") < ident)
        )
    newest = [F.col("us").desc(), F.col("transaction_id").desc()]
    whole = Window.orderBy(*newest)
    page = (
        tx.orderBy(*newest)
        .limit(limit + 1)
        .withColumn("rank", F.row_number().over(whole))
        .withColumn("_more", F.max("rank").over(Window.partitionBy(F.lit(1))) > limit)
        .filter(F.col("rank") <= limit)
        .withColumn("next_page", F.col("_more") & (F.col("rank") == limit))
        .drop("_more")
    )
    seen = latest(
        evaluations.join(F.broadcast(page.select("transaction_id")), "transaction_id"),
        "transaction_id",
        ("created_us", "evaluation_id"),
    ).select(
        "transaction_id",
        "evaluation_id",
        F.col("created_us").alias("evaluated_us"),
        "status",
        "strategy",
        "score",
        "level",
        "suggested_action",
    )
    linked = cases.join(
        F.broadcast(seen.select(F.col("evaluation_id").alias("assessment_id"))), "assessment_id"
    )
    moves = transitions.join(F.broadcast(linked.select("case_id")), "case_id", "left_semi")
    states = case_state(linked, moves).select(
        F.col("assessment_id").alias("evaluation_id"), "case_id", "state"
    )
    return page.join(seen, "transaction_id", "left").join(states, "evaluation_id", "left")


def worklist_filter(rows: DataFrame, text: str = "", risk: str = "ALL") -> DataFrame:
    """Case-insensitive substring over three ids, and ALL, NONE or one level."""
    needle = F.lit(text.strip().lower())
    ids = ("transaction_id", "customer_id", "recipient_id")
    hit = reduce(
        lambda a, b: a | b, (F.lower(F.col(c).cast("string")).contains(needle) for c in ids)
    )
    rows = rows.filter(hit) if text.strip() else rows
    if risk == "ALL":
        return rows
    return rows.filter(F.col("level").isNull() if risk == "NONE" else F.col("level") == risk)


def summary(
    tx: DataFrame,
    evaluations: DataFrame,
    cases: DataFrame,
    transitions: DataFrame,
    feedback: DataFrame,
    as_of_us: int,
) -> DataFrame:
    """One row of console totals. Each part is aggregated on its own, then the parts are added."""
    day = as_of_us // DAY * DAY
    us = F.col("us")
    today = (us >= day) & (us < day + DAY) & (us <= as_of_us)
    high = F.col("level").isin("HIGH", "CRITICAL")
    newest = latest(
        evaluations.select("transaction_id", "created_us", "evaluation_id", "level"),
        "transaction_id",
        ("created_us", "evaluation_id"),
    ).join(tx.select("transaction_id", "cents"), "transaction_id")
    verdicts = feedback.groupBy("case_id").agg(F.max_by("verdict", "sequence").alias("verdict"))
    judged = case_state(cases.select("case_id"), transitions).join(verdicts, "case_id", "left")
    zero = F.lit(0).cast("decimal(28,0)")
    parts = [
        tx.agg(
            F.count(F.lit(1)).alias("transactions"), F.count_if(today).alias("transactions_today")
        ),
        newest.agg(
            F.count(F.lit(1)).alias("evaluated"),
            F.count_if(high).alias("high_risk"),
            F.coalesce(F.sum(F.when(high, F.col("cents").cast("decimal(18,0)"))), zero).alias(
                "suspicious_cents"
            ),
        ),
        judged.agg(
            F.count_if(F.col("state").isin("OPEN", "UNDER_REVIEW")).alias("awaiting_review"),
            F.count_if(F.col("verdict") == "CONFIRMED_FRAUD").alias("confirmed_fraud"),
        ),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*(F.sum(c).alias(c) for c in rows.columns)).select(
        F.lit(as_of_us).alias("as_of_us"), "*"
    )


FACT_COLUMNS = (
    "customer_id",
    "recipient_id",
    "cents",
    "currency",
    "us",
    "channel",
    "device_id",
    "status",
)


def reconcile(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """ABSENT, MATCH or CONFLICT for every expected fact, over eight columns."""
    theirs = stored.select(
        "transaction_id", *(F.col(c).alias(f"_{c}") for c in FACT_COLUMNS), F.lit(1).alias("_here")
    )
    same = reduce(
        lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FACT_COLUMNS)
    )
    fact = (
        F.when(F.col("_here").isNull(), "ABSENT").when(same, "MATCH").otherwise("CONFLICT")
    )
    return expected.join(theirs, "transaction_id", "left").select(
        *expected.columns, fact.alias("fact")
    )


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def evidence_report(
    facts: DataFrame,
    evaluations: DataFrame,
    cases: DataFrame,
    transitions: DataFrame,
    feedback: DataFrame,
    decisions: DataFrame,
    evidence: DataFrame,
) -> DataFrame:
    """Everything recorded about every expected fact.

    One row per evaluation, with its case, state, and counts and last entries of feedback and
    learning; the entries themselves stay rows of their own tables, keyed by case. Only facts that
    match carry evaluations.
    """
    said = feedback.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("feedback_entries"),
        F.max_by("verdict", "sequence").alias("last_verdict"),
    )
    learned = (
        evidence.select("case_id", "decision_id")
        .join(decisions.select("decision_id", "action", "reason"), "decision_id")
        .groupBy("case_id")
        .agg(
            F.count(F.lit(1)).alias("learning_entries"),
            F.max(F.struct("decision_id", "action", "reason")).alias("_last"),
        )
        .select(
            "case_id",
            "learning_entries",
            F.col("_last.action").alias("last_action"),
            F.col("_last.reason").alias("last_reason"),
        )
    )
    reviewed = (
        case_state(cases.select("case_id", "assessment_id"), transitions)
        .join(said, "case_id", "left")
        .join(learned, "case_id", "left")
        .withColumnRenamed("assessment_id", "evaluation_id")
    )
    recorded = evaluations.select(
        "transaction_id", "evaluation_id", F.col("status").alias("risk_status"), "profile_version"
    ).join(reviewed, "evaluation_id", "left")
    matched = F.when(F.col("fact") == "MATCH", F.col("transaction_id"))
    return (
        facts.withColumn("_tx", matched)
        .join(recorded.withColumnRenamed("transaction_id", "_tx"), "_tx", "left")
        .drop("_tx")
        .fillna(0, subset=["feedback_entries", "learning_entries"])
    )
