"""Profile learning: which reviewed transactions may change a customer's baseline."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.frames import DAY, KEYS, add
from riskweave.operators.cases import TERMINAL, case_state
from riskweave.operators.features import MINIMUM_HISTORY
from riskweave.operators.history import (
    HISTORY_LIMIT,
    candidates,
    history_frame,
    positions,
    split_by_length,
)
from riskweave.operators.profiles import amount_statistics, running_before
from riskweave.operators.validate import listed
from riskweave.session import checkpoint_root

EXCEPTIONAL_RATIO = 10
BOOTSTRAP_MINIMUM, BOOTSTRAP_MAXIMUM, BOOTSTRAP_REVIEWERS = 5, 100, 2
LONG_SPAN = 180 * DAY

# Decision reasons and the event each action emits.
REJECT, HOLD, ACCEPT = "REJECT_FROM_PROFILE", "QUARANTINE", "ACCEPT"
EVENT_OF = {
    ACCEPT: "PROFILE_UPDATED",
    HOLD: "PROFILE_TRANSACTION_QUARANTINED",
    REJECT: "PROFILE_TRANSACTION_REJECTED",
}


# --- the gate -----------------------------------------------------------------------------------


def exceptional(cents: str, doubled_median: str, ratio: int = EXCEPTIONAL_RATIO) -> str:
    """cents / median >= ratio, in whole numbers."""
    return (
        f"CAST({cents} AS DECIMAL(20, 0)) * 2 >= CAST({doubled_median} AS DECIMAL(20, 0)) * {ratio}"
    )


def gate_reason(verdict: str, n: str, doubled_median: str, cents: str = "cents") -> str:
    """The gate for one row and a known baseline. Fraud is decided before history is looked at."""
    return (
        f"CASE WHEN {verdict} = 'CONFIRMED_FRAUD' THEN 'CONFIRMED_FRAUD' "
        f"WHEN NOT ({verdict} <=> 'LEGITIMATE') THEN 'UNVERIFIED' "
        f"WHEN coalesce({n}, 0) < {MINIMUM_HISTORY} THEN 'INSUFFICIENT_TRUSTED_HISTORY' "
        f"WHEN {exceptional(cents, doubled_median)} THEN 'EXCEPTIONAL_LEGITIMATE_AMOUNT' "
        "ELSE 'CONFIRMED_ORDINARY_ACTIVITY' END"
    )


def gate_action(reason: str) -> str:
    return (
        f"CASE {reason} WHEN 'CONFIRMED_FRAUD' THEN '{REJECT}' "
        f"WHEN 'CONFIRMED_ORDINARY_ACTIVITY' THEN '{ACCEPT}' ELSE '{HOLD}' END"
    )


def gate_static(rows: DataFrame) -> DataFrame:
    """Decides every row against the baseline columns it already carries.

    Where the history was refused there was no evaluation, so no verdict can have come from one.
    """
    refused = "history_limit_exceeded" in rows.columns
    verdict = "(CASE WHEN NOT history_limit_exceeded THEN verdict END)" if refused else "verdict"
    rows = add(rows, reason=gate_reason(verdict, "n_long", "median2_long"))
    return add(rows, action=gate_action("reason"))


class TrustedWindow:
    """Sorted amounts of the last 180 days of accepted rows."""

    def __init__(self) -> None:
        self.ordered: list[int] = []
        self.queue: deque[tuple[int, int]] = deque()

    def admit(self, us: int, cents: int) -> None:
        insort(self.ordered, cents)
        self.queue.append((us, cents))

    def expire(self, us: int) -> None:
        while self.queue and self.queue[0][0] <= us - LONG_SPAN:
            _, cents = self.queue.popleft()
            del self.ordered[bisect_left(self.ordered, cents)]

    def decide(self, us: int, cents: int, verdict: str | None) -> tuple[str, int, int | None]:
        """(reason, rows, doubled median) for the next row; the row is not admitted here."""
        self.expire(us)
        n = len(self.ordered)
        median2 = self.ordered[(n - 1) // 2] + self.ordered[n // 2] if n else None
        if verdict == "CONFIRMED_FRAUD":
            reason = "CONFIRMED_FRAUD"
        elif verdict != "LEGITIMATE":
            reason = "UNVERIFIED"
        elif n < MINIMUM_HISTORY:
            reason = "INSUFFICIENT_TRUSTED_HISTORY"
        elif cents * 2 >= EXCEPTIONAL_RATIO * median2:
            reason = "EXCEPTIONAL_LEGITIMATE_AMOUNT"
        else:
            reason = "CONFIRMED_ORDINARY_ACTIVITY"
        return reason, n, median2


FOLDED = ("transaction_id", *KEYS, "us", "reason", "n_trusted", "median2_trusted", "version_after")
DECIDED = {"reason": "string", "n_trusted": "bigint", "median2_trusted": "bigint", "version_after": "bigint"}
ADMITTING = ("TRUSTED_REVIEWED_BOOTSTRAP", "CONFIRMED_ORDINARY_ACTIVITY")


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by key, slice, time and id; only the trusted window of one slice is held.

    Rows with ``carried`` were trusted in earlier slices: they enter the window and give no row.
    """
    key, window, version = None, TrustedWindow(), 0
    for batch in batches:
        rows = batch.to_pydict()
        reasons, counts, medians, versions, own = [], [], [], [], []
        for i, (customer, currency, part, us, cents, verdict, seed, carried) in enumerate(
            zip(
                rows["customer_id"],
                rows["currency"],
                rows["slice"],
                rows["us"],
                rows["cents"],
                [v if e else None for v, e in zip(rows["verdict"], rows["evaluable"], strict=True)],
                rows["is_seed"],
                rows["carried"],
                strict=True,
            )
        ):
            if key != (customer, currency, part):
                key, window, version = (customer, currency, part), TrustedWindow(), 0
            if carried:
                window.admit(us, cents)
                continue
            reason, n, median2 = window.decide(us, cents, verdict)
            if seed:
                reason, version = "TRUSTED_REVIEWED_BOOTSTRAP", 1
            if reason in ADMITTING:
                window.admit(us, cents)
                version += not seed
            own.append(i)
            reasons.append(reason)
            counts.append(n)
            medians.append(median2)
            versions.append(version)
        kept = batch.take(pa.array(own, pa.int64()))
        for name, column in zip(DECIDED, (reasons, counts, medians, versions), strict=True):
            kind = pa.string() if name == "reason" else pa.int64()
            kept = kept.append_column(name, pa.array(column, kind))
        yield kept


def _folded(rows: DataFrame) -> DataFrame:
    """One sorted pass over keys or slices (``slice``) of keys.

    Rows are dealt by a hash of the columns: a repartition by columns that a join below has dealt by
    already is left out by Spark, which may then deal out a skewed key of that join anew.
    """
    kinds = {c: k for c, k in [*rows.dtypes, *DECIDED.items()]}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    parts = [*KEYS, "slice"]
    ordered = rows.repartition(F.xxhash64(*parts)).sortWithinPartitions(
        *parts, F.desc("carried"), "us", F.col("transaction_id").cast("string")
    )
    return ordered.mapInArrow(_fold_sorted, schema).drop("carried")


def _slices(rows: DataFrame, limit: int) -> DataFrame:
    """Rows with ``slice`` (``limit`` rows each, in order) and ``reach``, the last slice of the key
    that begins within 180 days of the end of theirs."""
    placed = positions(rows).withColumn("slice", F.floor(F.col("place") / limit)).drop("place", "older")
    bounds = placed.groupBy(*KEYS, "slice").agg(F.min("us").alias("begin"), F.max("us").alias("end"))
    both = bounds.selectExpr(*KEYS, "slice", "begin AS us", "1 AS begun").unionByName(
        bounds.selectExpr(*KEYS, "slice", f"end + {LONG_SPAN} AS us", "0 AS begun")
    )
    # Slices are numbered from 0 in order, so those begun by then are 0 to their count less one.
    reached = running_before(both, {"_begun": "begun"}, {}).filter("begun = 0")
    reach = reached.selectExpr(*KEYS, "slice", "greatest(_begun - 1, slice) AS reach")
    return placed.join(reach, [*KEYS, "slice"])


def _fold_long(rows: DataFrame, limit: int) -> DataFrame:
    """Keys of any length, without folding one key in one task.

    A key is cut into slices of ``limit`` rows. What a slice needs of the earlier ones is their
    trusted rows of the last 180 days. First these are guessed (every legitimate row), then all
    slices are folded at once; a slice is folded again only if a row that it was given has turned
    out otherwise. Slice 0 needs nothing, and a slice is right once those before it are, so a key
    takes at most as many passes as it has slices.
    """
    state = _slices(rows, limit).withColumn(
        "trusted", F.expr("is_seed OR (evaluable AND verdict <=> 'LEGITIMATE')")
    )
    for name, kind in DECIDED.items():
        state = state.withColumn(name, F.lit(None).cast(kind))
    state = state.checkpoint()
    columns, part = state.columns, [*KEYS, "slice"]
    targets = F.explode(F.sequence(F.col("slice") + 1, F.col("reach")))
    work: DataFrame | None = None  # all slices
    while True:
        given = state.filter("trusted AND reach > slice").withColumn("slice", targets)
        own = state
        if work is not None:
            own, given = own.join(work, part, "left_semi"), given.join(work, part, "left_semi")
        both = own.withColumn("carried", F.lit(False)).unionByName(given.withColumn("carried", F.lit(True)))
        decided = _folded(both.drop(*DECIDED)).checkpoint()
        now = f"(reason IN {ADMITTING})"
        turned = decided.filter(f"trusted <> {now} AND reach > slice")
        again = turned.select(*KEYS, targets.alias("slice")).distinct().checkpoint()
        settled = decided.withColumn("trusted", F.expr(now)).select(*columns)
        if work is not None:
            settled = settled.unionByName(state.join(work, part, "left_anti").select(*columns))
        if again.isEmpty():
            return _with_versions(settled.drop("version_after")).select(*FOLDED)
        state, work = settled.checkpoint(), again


def with_evaluable(rows: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Adds ``evaluable``: the row has at most ``limit`` prior rows in 180 days."""
    frame = candidates(history_frame(rows, limit))
    return add(frame, evaluable="NOT history_limit_exceeded").select(*rows.columns, "evaluable")


def gate_fold(rows: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Decides rows in order; an accepted row becomes part of the baseline of the next.

    Rows carry ``transaction_id, customer_id, currency, us, cents, verdict, is_seed`` and may carry
    ``evaluable``: whether the row could be evaluated at all. Without an evaluation no verdict can
    have come from one, so it counts as unverified. Where the column is missing it is whether the
    history limit held. Seeds are the bootstrap observations. Keys of at most ``limit`` rows are
    folded in one sorted pass over each partition, longer ones in slices; both give the same rows,
    whatever the limit. A transaction is one row of its key.
    """
    if "evaluable" not in rows.columns:
        rows = with_evaluable(rows, limit)
    names = ("transaction_id", *KEYS, "us", "cents", "verdict", "is_seed", "evaluable")
    rows = rows.select(*names)
    short, long = split_by_length(rows, limit)
    folded = _folded(short.selectExpr("*", "0L AS slice", "false AS carried")).select(*FOLDED)
    if long is not None:
        more = _fold_long(long.select(*names), limit)
        folded = folded.unionByName(more.select(*folded.columns))
    seed = "reason = 'TRUSTED_REVIEWED_BOOTSTRAP'"
    return add(folded, action=f"CASE WHEN {seed} THEN '{ACCEPT}' ELSE {gate_action('reason')} END")


def _with_versions(folded: DataFrame) -> DataFrame:
    """Adds ``version_after``: one for the bootstrap, one more for every later acceptance."""
    accepted = "CASE WHEN reason = 'CONFIRMED_ORDINARY_ACTIVITY' THEN 1 ELSE 0 END"
    seeded = "CASE WHEN reason = 'TRUSTED_REVIEWED_BOOTSTRAP' THEN 1 ELSE 0 END"
    counted = running_before(folded, {"_a": accepted, "_s": seeded}, {})
    tied = (
        f"OVER (PARTITION BY {', '.join(KEYS)}, us ORDER BY CAST(transaction_id AS STRING) "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    counted = add(
        counted,
        _seeds=f"_s + sum({seeded}) {tied}",
        _accepts=f"_a + sum({accepted}) {tied}",
    )
    version = "_accepts + CASE WHEN _seeds > 0 THEN 1 ELSE 0 END"
    return add(counted, version_after=version).drop("_a", "_s", "_seeds", "_accepts")


def first_legitimate(rows: DataFrame, count: int = BOOTSTRAP_MINIMUM) -> DataFrame:
    """Marks the first ``count`` legitimate rows of a key as ``is_seed``.

    The rank limit is applied before the shuffle too, so a long key sends only a few rows.
    """
    order = Window.partitionBy(*KEYS).orderBy("us", F.col("transaction_id").cast("string"))
    seeds = (
        rows.filter("verdict = 'LEGITIMATE'")
        .select("transaction_id", *KEYS, "us")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= count)
        .select("transaction_id", F.lit(True).alias("is_seed"))
    )
    return rows.join(seeds, "transaction_id", "left").fillna(False, subset=["is_seed"])


# --- reviewed evidence --------------------------------------------------------------------------


def terminal_evidence(
    cases: DataFrame,
    transitions: DataFrame,
    feedback: DataFrame,
    evaluations: DataFrame,
    tx: DataFrame,
    authorizer: str,
) -> DataFrame:
    """Cases with their single terminal verdict, and why a case cannot be used (``problems``)."""
    verdicts = (
        feedback.filter(F.col("verdict").isin(*TERMINAL))
        .groupBy("case_id")
        .agg(
            F.count(F.lit(1)).alias("terminals"),
            F.max(F.struct("feedback_id", "verdict", "actor")).alias("_f"),
        )
    )
    joined = (
        case_state(cases.select("case_id", "assessment_id", "transaction_id"), transitions)
        .join(verdicts, "case_id", "left")
        .join(
            evaluations.select(
                F.col("evaluation_id").alias("assessment_id"),
                F.col("profile_version").alias("captured_version"),
            ),
            "assessment_id",
        )
        .join(tx.select("transaction_id", *KEYS, "us", "cents"), "transaction_id")
    )
    clauses = {
        "not_closed": F.col("state") != "CLOSED",
        "terminal_count": ~F.coalesce(F.col("terminals") == 1, F.lit(False)),
        "self_authorized": F.coalesce(F.col("_f.actor") == authorizer, F.lit(False)),
    }
    return joined.select(
        "case_id",
        "transaction_id",
        *KEYS,
        "us",
        "cents",
        "captured_version",
        F.col("_f.feedback_id").alias("feedback_id"),
        F.col("_f.verdict").alias("verdict"),
        F.col("_f.actor").alias("reviewer"),
        listed(clauses).alias("problems"),
    )


def case_updates(rows: DataFrame) -> DataFrame:
    """The decision for a reviewed case, in order of precedence.

    Rows carry ``verdict, us, cents, captured_version``, the current profile (``version, verified,
    as_of_us``, NULL when there is none) and its baseline (``n_long, median2_long``).
    """
    gate = gate_reason("'LEGITIMATE'", "n_long", "median2_long")
    rows = add(
        rows,
        reason=(
            "CASE WHEN verdict = 'CONFIRMED_FRAUD' THEN 'CONFIRMED_FRAUD' "
            "WHEN version IS NULL THEN 'COLD_START_REQUIRES_BOOTSTRAP' "
            "WHEN NOT coalesce(verified, false) THEN 'UNVERIFIED_PROFILE_PROVENANCE' "
            "WHEN us < as_of_us THEN 'LATE_REVIEW_REQUIRES_REPLAY' "
            "WHEN NOT (captured_version <=> version) THEN 'STALE_EVALUATION_PROFILE_VERSION' "
            f"ELSE {gate} END"
        ),
    )
    rows = add(rows, action=gate_action("reason"))
    return rows.withColumns(
        {
            "version_after": F.when(F.col("action") == ACCEPT, F.col("version") + 1).otherwise(
                F.col("version")
            ),
            "event_type": event_type(F.col("action")),
        }
    )


def event_type(action: Column) -> Column:
    chain = F
    for name, event in EVENT_OF.items():
        chain = chain.when(action == name, event)
    return chain


# --- bootstrap ----------------------------------------------------------------------------------


def bootstrap_eligibility(evidence: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per customer and currency with every reason against a bootstrap.

    Evidence rows are the usable cases of a set; ``profiles`` lists keys that already have one.
    The evidence is worked out once for all its aggregates.
    """
    checkpoint_root(evidence.sparkSession)
    used = ("case_id", "reviewer", "us", "cents", "verdict", "captured_version")
    evidence = evidence.select(*KEYS, *used).checkpoint()
    reviewers = evidence.select(*KEYS, "reviewer").distinct()
    reviewers = reviewers.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("reviewers"))
    unique = evidence.select(*KEYS, "case_id").distinct()
    unique = unique.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("unique_cases"))
    sets = (
        evidence.groupBy(*KEYS)
        .agg(
            F.count(F.lit(1)).alias("cases"),
            F.min("us").alias("first_us"),
            F.max("us").alias("as_of_us"),
            F.max("cents").alias("largest"),
            F.bool_and(F.col("verdict") == "LEGITIMATE").alias("legitimate"),
            F.bool_and(F.col("captured_version").isNull()).alias("uncaptured"),
        )
        .join(reviewers, list(KEYS))
        .join(unique, list(KEYS))
        .join(amount_statistics(evidence).select(*KEYS, "median2"), list(KEYS))
        .join(
            profiles.select(*KEYS).distinct().withColumn("has_profile", F.lit(True)),
            list(KEYS),
            "left",
        )
    )
    clauses = {
        "case_count": ~F.col("cases").between(BOOTSTRAP_MINIMUM, BOOTSTRAP_MAXIMUM),
        "repeated_case": F.col("cases") != F.col("unique_cases"),
        "not_legitimate": ~F.col("legitimate"),
        "captured_profile": ~F.col("uncaptured"),
        "reviewers": F.col("reviewers") < BOOTSTRAP_REVIEWERS,
        "existing_profile": F.coalesce(F.col("has_profile"), F.lit(False)),
        "span": F.col("first_us") <= F.col("as_of_us") - LONG_SPAN,
        "exceptional_amount": F.expr(exceptional("largest", "median2")),
    }
    return sets.select(
        *KEYS, "cases", "reviewers", "as_of_us", "median2", listed(clauses).alias("problems")
    )


def bootstrap_observations(evidence: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Version-1 observations of the eligible sets, numbered by time; a set has at most 100."""
    chosen = eligibility.filter("size(problems) = 0").select(*KEYS, "as_of_us")
    order = Window.partitionBy(*KEYS).orderBy("us", F.col("transaction_id").cast("string"))
    return (
        evidence.join(chosen, list(KEYS))
        .select(*KEYS, "transaction_id", "cents", "us", "as_of_us")
        .withColumn("ordinal", F.row_number().over(order) - 1)
        .withColumn("admitted_version", F.lit(1))
    )


def bootstrap_trace(expected: DataFrame, admitted: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether enough expected transactions were admitted with independent evidence, per key."""
    supported = evidence.join(
        admitted.select("transaction_id").intersect(expected.select("transaction_id")),
        "transaction_id",
        "left_semi",
    )
    counts = supported.groupBy(*KEYS).agg(
        F.count_distinct("transaction_id").alias("supported"),
        F.count_distinct("reviewer").alias("reviewers"),
    )
    return counts.withColumn(
        "matches",
        (F.col("supported") >= BOOTSTRAP_MINIMUM) & (F.col("reviewers") >= BOOTSTRAP_REVIEWERS),
    )


# --- stored decisions ---------------------------------------------------------------------------


def decision_violations(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence counts and version arithmetic of stored decisions."""
    counts = (
        evidence.groupBy("decision_id", "reviewer")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("decision_id")
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("reviewers"))
    )
    joined = decisions.join(counts, "decision_id", "left").fillna(0, subset=["rows", "reviewers"])
    bootstrap = F.col("kind") == "BOOTSTRAP"
    before, after = F.col("version_before"), F.col("version_after")
    advanced = F.when(F.col("action") == ACCEPT, F.coalesce(before, F.lit(0)) + 1).otherwise(before)
    clauses = {
        "evidence_rows": F.when(
            bootstrap, ~F.col("rows").between(BOOTSTRAP_MINIMUM, BOOTSTRAP_MAXIMUM)
        ).otherwise(F.col("rows") != 1),
        "reviewers": bootstrap & (F.col("reviewers") < BOOTSTRAP_REVIEWERS),
        "version": ~after.eqNullSafe(advanced),
    }
    return joined.withColumn("violations", listed(clauses)).drop("rows", "reviewers")


def evidence_violations(
    evidence: DataFrame,
    decisions: DataFrame,
    cases: DataFrame,
    transitions: DataFrame,
    feedback: DataFrame,
) -> DataFrame:
    """Evidence rows that do not agree with the case, its feedback or the decision's action."""
    said = feedback.select(
        "feedback_id", "case_id", F.col("actor").alias("_actor"), F.col("verdict").alias("_verdict")
    )
    state = case_state(
        cases.select("case_id", F.col("transaction_id").alias("_tx")), transitions
    )
    made = decisions.select("decision_id", "kind", "action", F.col("actor").alias("_by"))
    joined = (
        evidence.join(made, "decision_id", "left")
        .join(state, "case_id", "left")
        .join(said, ["case_id", "feedback_id"], "left")
    )
    no = F.lit(False)
    fraud = F.col("_verdict") == "CONFIRMED_FRAUD"
    allowed = F.when(
        F.col("kind") == "BOOTSTRAP", ~fraud & (F.col("action") == ACCEPT)
    ).otherwise(
        F.when(fraud, F.col("action") == REJECT).otherwise(F.col("action").isin(ACCEPT, HOLD))
    )
    clauses = {
        "not_closed": ~F.coalesce(F.col("state") == "CLOSED", no),
        "transaction": ~F.coalesce(F.col("_tx") == F.col("transaction_id"), no),
        "reviewer": ~F.coalesce(F.col("_actor") == F.col("reviewer"), no),
        "self_authorized": F.coalesce(F.col("_by") == F.col("reviewer"), no),
        "verdict": ~F.coalesce(F.col("_verdict").isin(*TERMINAL), no),
        "action": ~F.coalesce(allowed, no),
    }
    return joined.withColumn("violations", listed(clauses))
