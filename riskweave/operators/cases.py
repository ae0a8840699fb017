"""Case state, review histories and their checks.

A predecessor is found by an equi-join on (case, sequence - 1), not by a window over the case, so a
case with a very long history is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.validate import listed
from riskweave.schemas import CASE_MOVES

TERMINAL = ("LEGITIMATE", "CONFIRMED_FRAUD")
PAGE = 1_000


def latest(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The newest row per key. The maximum combines before the shuffle, whatever the skew."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    newest = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return newest.select(key, "_r.*").select(*rows.columns)


def case_state(cases: DataFrame, transitions: DataFrame) -> DataFrame:
    """Every case with its last target, or OPEN."""
    last = transitions.groupBy("case_id").agg(F.max_by("target", "sequence").alias("_state"))
    return (
        cases.join(last, "case_id", "left")
        .withColumn("state", F.coalesce("_state", F.lit("OPEN")))
        .drop("_state")
    )


def check_transitions(transitions: DataFrame, cases: DataFrame) -> DataFrame:
    """Adds ``violations`` to every transition."""
    before = transitions.select(
        "case_id",
        (F.col("sequence") + 1).alias("sequence"),
        F.col("target").alias("_target"),
        F.col("at_us").alias("_at"),
    )
    opened = cases.select("case_id", F.col("created_us").alias("_opened"))
    joined = transitions.join(before, ["case_id", "sequence"], "left").join(
        opened, "case_id", "left"
    )
    first = F.col("sequence") == 1
    state = F.when(first, "OPEN").otherwise(F.col("_target"))
    since = F.when(first, F.col("_opened")).otherwise(F.col("_at"))
    moves = [F.struct(F.lit(a), F.lit(b)) for a, b in CASE_MOVES]
    clauses = {
        "missing_case": F.col("_opened").isNull(),
        "sequence_gap": ~first & F.col("_target").isNull(),
        "wrong_previous": F.coalesce(F.col("previous") != state, F.lit(False)),
        "illegal_move": ~F.struct("previous", "target").isin(*moves),
        "time_backwards": F.coalesce(F.col("at_us") < since, F.lit(False)),
    }
    return joined.withColumn("violations", listed(clauses)).drop("_target", "_at", "_opened")


def check_feedback(feedback: DataFrame, transitions: DataFrame) -> DataFrame:
    """Adds ``violations``: order, and agreement with the transition the verdict belongs to."""
    before = feedback.select(
        "case_id", (F.col("sequence") + 1).alias("sequence"), F.col("at_us").alias("_at")
    )
    reached = transitions.groupBy("case_id", F.col("target").alias("verdict")).agg(
        F.max(F.struct("sequence", "actor", "at_us")).alias("_set")
    )
    review = transitions.groupBy("case_id").agg(
        F.min(F.when(F.col("target") == "UNDER_REVIEW", F.col("at_us"))).alias("_from"),
        F.min(F.when(F.col("target").isin(*TERMINAL), F.col("at_us"))).alias("_until"),
    )
    terminal = F.col("verdict").isin(*TERMINAL)
    earliest = (
        feedback.filter(terminal)
        .groupBy("case_id")
        .agg(F.min("sequence").alias("_first_terminal"))
    )
    joined = (
        feedback.join(before, ["case_id", "sequence"], "left")
        .join(reached, ["case_id", "verdict"], "left")
        .join(review, "case_id", "left")
        .join(earliest, "case_id", "left")
    )
    no = F.lit(False)
    matches = (F.col("_set.actor") == F.col("actor")) & (F.col("_set.at_us") == F.col("at_us"))
    open_review = (F.col("at_us") >= F.col("_from")) & (
        F.col("_until").isNull() | (F.col("at_us") <= F.col("_until"))
    )
    clauses = {
        "sequence_gap": (F.col("sequence") > 1) & F.col("_at").isNull(),
        "time_backwards": F.coalesce(F.col("at_us") < F.col("_at"), no),
        "terminal_mismatch": terminal & ~F.coalesce(matches, no),
        "terminal_repeated": terminal
        & F.coalesce(F.col("sequence") > F.col("_first_terminal"), no),
        "not_under_review": ~terminal & ~F.coalesce(open_review, no),
    }
    return joined.withColumn("violations", listed(clauses)).drop(
        "_at", "_set", "_from", "_until", "_first_terminal"
    )


def unconfirmed_terminals(transitions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Terminal transitions without the feedback that has to accompany them."""
    said = feedback.select("case_id", F.col("verdict").alias("target"), "actor", "at_us")
    return transitions.filter(F.col("target").isin(*TERMINAL)).join(
        said, ["case_id", "target", "actor", "at_us"], "left_anti"
    )


def review_documents(
    cases: DataFrame, transitions: DataFrame, feedback: DataFrame, page: int = PAGE
) -> DataFrame:
    """The review document of every case, as JSON, in pages of ``page`` entries.

    Histories are contiguous by sequence, so the page of an entry is known from its number and no
    case is gathered whole. Almost every case is page 0 alone; longer ones continue on further
    pages in order.
    """

    def paged(rows: DataFrame, name: str, *fields: str) -> DataFrame:
        number = F.floor((F.col("sequence") - 1) / page).cast("int").alias("page")
        entry = F.struct("sequence", *sorted(f for f in fields if f != "sequence"))
        return rows.groupBy("case_id", number).agg(
            F.sort_array(F.collect_list(entry)).alias(name)
        )

    history = paged(transitions, "history", "previous", "target", "actor", "at_us")
    said = paged(feedback, "feedback", "feedback_id", "actor", "verdict", "at_us", "sequence")
    totals = (
        transitions.select("case_id", F.lit(1).alias("n"))
        .unionByName(feedback.select("case_id", F.lit(1).alias("n")))
        .groupBy("case_id")
        .agg(F.sum("n").cast("bigint").alias("version"))
    )
    pages = history.join(said, ["case_id", "page"], "full")
    rows = (
        case_state(cases, transitions)
        .join(pages, "case_id", "left")
        .join(totals, "case_id", "left")
        .fillna(0, subset=["page", "version"])
    )
    empty = F.array()
    document = F.struct(
        F.lit(False).alias("admission_workflow_verified"),
        F.col("case_id"),
        F.col("created_us"),
        F.col("assessment_id").alias("evaluation_id"),
        F.lit(True).alias("experimental"),
        F.coalesce("feedback", empty).alias("feedback"),
        F.coalesce("history", empty).alias("history"),
        F.lit(False).alias("operational_action_executed"),
        F.col("state"),
        F.col("transaction_id"),
        F.col("version"),
    )
    return rows.select(
        "case_id",
        "page",
        "state",
        "version",
        F.size(F.coalesce("history", empty)).alias("history_entries"),
        F.size(F.coalesce("feedback", empty)).alias("feedback_entries"),
        F.to_json(document).alias("document"),
    )


def verdict_confusion(
    feedback: DataFrame, cases: DataFrame, evaluations: DataFrame, threshold: float = 0.5
) -> DataFrame:
    """Analyst verdicts against the stored score."""
    decided = feedback.filter(F.col("verdict").isin(*TERMINAL)).select("case_id", "verdict")
    scored = decided.join(cases.select("case_id", "assessment_id"), "case_id").join(
        evaluations.select(F.col("evaluation_id").alias("assessment_id"), "score"), "assessment_id"
    )
    predicted = F.when(F.col("score").isNull(), "NONE").otherwise(
        F.when(F.col("score") >= threshold, "POSITIVE").otherwise("NEGATIVE")
    )
    return scored.groupBy("verdict", predicted.alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
