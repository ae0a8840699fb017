"""Queries over the profile-update gate, reviewed evidence and bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.frames import KEYS
from riskweave.operators import features, learning, profiles, validate
from riskweave.plans import oracle as o
from riskweave.plans.registry import query
from riskweave.session import checkpoint_root
from riskweave.sources import driver_tables as d


def _joined(column):
    return F.array_join(column, ",").alias(column)


GATE = """CASE WHEN verdict = 'CONFIRMED_FRAUD' THEN 'CONFIRMED_FRAUD'
      WHEN verdict IS DISTINCT FROM 'LEGITIMATE' THEN 'UNVERIFIED'
      WHEN n < 5 THEN 'INSUFFICIENT_TRUSTED_HISTORY'
      WHEN 2 * cents >= 10 * m2 THEN 'EXCEPTIONAL_LEGITIMATE_AMOUNT'
      ELSE 'CONFIRMED_ORDINARY_ACTIVITY' END"""
ACTION = """CASE reason WHEN 'CONFIRMED_FRAUD' THEN 'REJECT_FROM_PROFILE'
      WHEN 'CONFIRMED_ORDINARY_ACTIVITY' THEN 'ACCEPT' WHEN 'TRUSTED_REVIEWED_BOOTSTRAP' THEN 'ACCEPT'
      ELSE 'QUARANTINE' END AS action"""


@query(
    "q_gate_static",
    f"""WITH {o.BASELINE}, g AS (SELECT *, CASE WHEN pm THEN 0 ELSE nl END AS n, med2 AS m2 FROM b),
    r AS (SELECT transaction_id, {GATE} AS reason FROM g)
    SELECT transaction_id, reason, {ACTION} FROM r""",
)
def gate_static(spark, sf):
    frame = features.with_baseline(features.baseline_frame(d.admitted(spark, sf)))
    decided = learning.gate_static(features.candidates(frame))
    return decided.select("transaction_id", "reason", "action")


FOLD_SQL = f"""WITH RECURSIVE {o.REVIEWED}, sq AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id, currency ORDER BY us, CAST(transaction_id AS VARCHAR))
      AS rn,
    verdict IS NOT DISTINCT FROM 'LEGITIMATE' AND count(*) FILTER (WHERE verdict = 'LEGITIMATE')
      OVER (PARTITION BY customer_id, currency ORDER BY us, CAST(transaction_id AS VARCHAR)
        ROWS UNBOUNDED PRECEDING) <= 5 AS seed FROM reviewed),
fold AS (
  SELECT customer_id, currency, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(us BIGINT, c BIGINT)[]) AS acc,
    CAST(NULL AS BIGINT) AS transaction_id, '' AS reason, CAST(0 AS BIGINT) AS n,
    CAST(NULL AS BIGINT) AS m2, CAST(0 AS BIGINT) AS version
  FROM (SELECT DISTINCT customer_id, currency FROM sq)
  UNION ALL
  SELECT customer_id, currency, rn,
    CASE WHEN reason IN ('TRUSTED_REVIEWED_BOOTSTRAP', 'CONFIRMED_ORDINARY_ACTIVITY')
      THEN list_append(acc, {{'us': us, 'c': cents}}) ELSE acc END, transaction_id, reason, n, m2,
    CASE WHEN reason = 'TRUSTED_REVIEWED_BOOTSTRAP' THEN 1
      WHEN reason = 'CONFIRMED_ORDINARY_ACTIVITY' THEN version + 1 ELSE version END
  FROM (
    SELECT *, CASE WHEN seed THEN 'TRUSTED_REVIEWED_BOOTSTRAP' ELSE {GATE} END AS reason FROM (
      SELECT *, len(a) AS n, CASE WHEN len(a) > 0 THEN a[(len(a) + 1) // 2] + a[len(a) // 2 + 1] END
        AS m2 FROM (
        SELECT sq.*, fold.acc, fold.version, list_sort(list_transform(list_filter(fold.acc,
          lambda x: x.us > sq.us - {180 * o.DAY}), lambda x: x.c)) AS a
        FROM fold JOIN sq ON sq.customer_id = fold.customer_id AND sq.currency = fold.currency
          AND sq.rn = fold.rn + 1))))
SELECT transaction_id, reason, n AS n_trusted, m2 AS median2_trusted, {ACTION},
  version AS version_after FROM fold WHERE rn > 0"""
FOLD_COLUMNS = (
    "transaction_id",
    "reason",
    "n_trusted",
    "median2_trusted",
    "action",
    "version_after",
)


def _fold(spark, sf, limit):
    checkpoint_root(spark)
    rows = learning.first_legitimate(d.reviewed(spark, sf))
    return learning.gate_fold(rows, limit).select(*FOLD_COLUMNS)


@query("q_gate_fold", FOLD_SQL)
def gate_fold(spark, sf):
    return _fold(spark, sf, learning.HISTORY_LIMIT)


@query("q_gate_fold_evaluable", FOLD_SQL)
def gate_fold_evaluable(spark, sf):
    """Every row evaluable whatever its history: keys above 25 rows are folded in slices, and the
    rows are those of the fold in one pass."""
    checkpoint_root(spark)
    rows = learning.first_legitimate(d.reviewed(spark, sf)).withColumn("evaluable", F.lit(True))
    return learning.gate_fold(rows, 25).select(*FOLD_COLUMNS)


# A limit of 60 rows: rows beyond it could not be evaluated.
FOLD_LIMIT = 60
LIMITED_FOLD_SQL = FOLD_SQL.replace("FROM reviewed),", "FROM capped),").replace(
    "sq AS (",
    f"""capped AS (SELECT * EXCLUDE (verdict, k, na),
      CASE WHEN k <= 60 OR na <= 60 THEN verdict END AS verdict FROM (
      SELECT *, count(*) OVER (PARTITION BY customer_id, currency) AS k,
        count(*) OVER {o.frame(o.KEYS, 180 * o.DAY)} AS na FROM reviewed)), sq AS (""",
    1,
)


@query("q_gate_fold_long_keys", LIMITED_FOLD_SQL)
def gate_fold_long_keys(spark, sf):
    """The path for keys of any length, applied to every key above 60 rows.

    Beyond the history limit a transaction cannot have been evaluated, hence not reviewed.
    """
    checkpoint_root(spark)
    rows = learning.with_evaluable(d.reviewed(spark, sf), FOLD_LIMIT)
    folded = learning.gate_fold(learning.first_legitimate(rows), FOLD_LIMIT)
    return folded.select(*FOLD_COLUMNS)


TERMINAL = f"""{o.REVIEWS}, ter AS (
  SELECT st.case_id, st.transaction_id, st.customer_id, st.currency, tx.us, tx.cents,
    ev.profile_version AS captured_version, t.verdict, t.actor AS reviewer, t.feedback_id,
    concat_ws(',', CASE WHEN st.state <> 'CLOSED' THEN 'not_closed' END,
      CASE WHEN coalesce(t.n, 0) <> 1 THEN 'terminal_count' END,
      CASE WHEN t.actor = 'r3' THEN 'self_authorized' END) AS problems
  FROM st JOIN ev ON ev.evaluation_id = st.assessment_id
    JOIN tx ON tx.transaction_id = st.transaction_id
    LEFT JOIN (SELECT case_id, count(*) AS n, max(feedback_id) AS feedback_id,
        arg_max(verdict, feedback_id) AS verdict, arg_max(actor, feedback_id) AS actor
      FROM fb WHERE verdict IN ('LEGITIMATE', 'CONFIRMED_FRAUD') GROUP BY 1) t
      ON t.case_id = st.case_id)"""


def _terminal(spark, sf):
    return learning.terminal_evidence(
        d.cases(spark, sf),
        d.transitions(spark, sf),
        d.feedback(spark, sf),
        d.evaluations(spark, sf),
        d.transactions(spark, sf),
        "r3",
    )


@query(
    "q_terminal_evidence",
    f"""WITH {TERMINAL} SELECT case_id, transaction_id, captured_version, verdict, reviewer,
      feedback_id, problems FROM ter""",
)
def terminal_evidence(spark, sf):
    return _terminal(spark, sf).select(
        "case_id",
        "transaction_id",
        "captured_version",
        "verdict",
        "reviewer",
        "feedback_id",
        _joined("problems"),
    )


PINNED = 20


@query(
    "q_case_update",
    f"""WITH {o.REVISIONS}, adm20 AS (
      SELECT a.* REPLACE (CASE WHEN admitted_version <= {PINNED} THEN a.admitted_us END AS admitted_us)
      FROM admitted a LEFT JOIN (SELECT transaction_id, admitted_version FROM nobs) n
        USING (transaction_id)),
    {o.held("adm20", "p.admitted_us")}
    b AS (SELECT w.*, coalesce(len(al), 0) AS n,
        CASE WHEN len(al) > 0 THEN al[(len(al) + 1) // 2] + al[len(al) // 2 + 1] END AS m2,
        p.version, p.verified, p.as_of_us, CASE WHEN device_id = 'click' THEN 19 ELSE 20 END AS cv
      FROM b0 w LEFT JOIN (SELECT * FROM rev WHERE version = {PINNED}) p USING (customer_id, currency)
      WHERE verdict IN ('LEGITIMATE', 'CONFIRMED_FRAUD')),
    r AS (SELECT *, CASE WHEN verdict = 'CONFIRMED_FRAUD' THEN 'CONFIRMED_FRAUD'
        WHEN version IS NULL THEN 'COLD_START_REQUIRES_BOOTSTRAP'
        WHEN NOT verified THEN 'UNVERIFIED_PROFILE_PROVENANCE'
        WHEN us < as_of_us THEN 'LATE_REVIEW_REQUIRES_REPLAY'
        WHEN cv <> version THEN 'STALE_EVALUATION_PROFILE_VERSION' ELSE {GATE} END AS reason FROM b),
    a AS (SELECT *, {ACTION} FROM r)
    SELECT transaction_id, reason, action,
      CASE WHEN action = 'ACCEPT' THEN version + 1 ELSE version END AS version_after,
      CASE action WHEN 'ACCEPT' THEN 'PROFILE_UPDATED'
        WHEN 'QUARANTINE' THEN 'PROFILE_TRANSACTION_QUARANTINED'
        ELSE 'PROFILE_TRANSACTION_REJECTED' END AS event_type FROM a""",
)
def case_update(spark, sf):
    pinned = d.numbered_observations(spark, sf).filter(F.col("admitted_version") <= PINNED)
    tx = (
        d.admitted(spark, sf)
        .drop("admitted_us")
        .join(pinned.select("transaction_id", "admitted_us"), "transaction_id", "left")
    )
    baseline = features.candidates(features.with_baseline(features.baseline_frame(tx)))
    head = profiles.revision(d.revisions(spark, sf), PINNED).select(
        *KEYS, "version", "verified", "as_of_us"
    )
    rows = (
        baseline.filter("verdict IN ('LEGITIMATE', 'CONFIRMED_FRAUD')")
        .join(head, list(KEYS), "left")
        .withColumn("captured_version", F.when(F.col("device_id") == "click", 19).otherwise(20))
    )
    return learning.case_updates(rows).select(
        "transaction_id", "reason", "action", "version_after", "event_type"
    )


BOOT = f"""{TERMINAL}, ts AS (
  SELECT * REPLACE (CASE WHEN captured_version > 90 THEN captured_version END AS captured_version)
  FROM ter WHERE problems = '' AND verdict = 'LEGITIMATE'),
{o.statistics("ts")},
el0 AS (SELECT customer_id, currency, count(*) AS cases, count(DISTINCT reviewer) AS reviewers,
    min(us) AS first_us, max(us) AS as_of_us, max(cents) AS largest,
    bool_and(captured_version IS NULL) AS uncaptured FROM ts GROUP BY 1, 2),
el AS (SELECT el0.*, st2.median2, concat_ws(',',
    CASE WHEN cases NOT BETWEEN 5 AND 100 THEN 'case_count' END,
    CASE WHEN NOT uncaptured THEN 'captured_profile' END,
    CASE WHEN reviewers < 2 THEN 'reviewers' END,
    CASE WHEN customer_id IN (SELECT customer_id FROM cust WHERE segment = 'BUILDING')
      AND currency = 'KZT' THEN 'existing_profile' END,
    CASE WHEN first_us <= as_of_us - {180 * o.DAY} THEN 'span' END,
    CASE WHEN 2 * largest >= 10 * st2.median2 THEN 'exceptional_amount' END) AS problems
  FROM el0 JOIN stx st2 USING (customer_id, currency))"""
BOOT = BOOT.replace(o.statistics("ts"), o.CUSTOMERS + ", " + o.statistics("ts", "stx"))


def _bootstrap(spark, sf):
    evidence = (
        _terminal(spark, sf)
        .filter("size(problems) = 0 AND verdict = 'LEGITIMATE'")
        .withColumn(
            "captured_version", F.when(F.col("captured_version") > 90, F.col("captured_version"))
        )
    )
    taken = d.customers(spark, sf).filter("segment = 'BUILDING'").withColumn(
        "currency", F.lit("KZT")
    )
    return evidence, learning.bootstrap_eligibility(evidence, taken)


@query(
    "q_bootstrap_eligibility",
    f"""WITH {BOOT} SELECT customer_id, currency, cases, reviewers, as_of_us, median2, problems
    FROM el""",
)
def bootstrap_eligibility(spark, sf):
    _, eligibility = _bootstrap(spark, sf)
    return eligibility.withColumn("problems", _joined("problems"))


@query(
    "q_bootstrap_profile",
    f"""WITH {BOOT} SELECT customer_id, currency, transaction_id, cents, us, as_of_us,
      1 AS admitted_version, CAST(row_number() OVER (PARTITION BY customer_id, currency
        ORDER BY us, CAST(transaction_id AS VARCHAR)) - 1 AS INTEGER) AS ordinal
    FROM ts JOIN el USING (customer_id, currency) WHERE el.problems = ''""",
)
def bootstrap_profile(spark, sf):
    return learning.bootstrap_observations(*_bootstrap(spark, sf))


@query(
    "q_bootstrap_trace",
    f"""WITH {TERMINAL}, sup AS (SELECT * FROM ter WHERE problems = '' AND verdict = 'LEGITIMATE'
      AND transaction_id IN (SELECT transaction_id FROM reviewed
        WHERE verdict = 'LEGITIMATE' AND recipient_id < 40))
    SELECT customer_id, currency, count(DISTINCT transaction_id) AS supported,
      count(DISTINCT reviewer) AS reviewers,
      count(DISTINCT transaction_id) >= 5 AND count(DISTINCT reviewer) >= 2 AS matches
    FROM sup GROUP BY 1, 2""",
)
def bootstrap_trace(spark, sf):
    evidence = _terminal(spark, sf).filter("size(problems) = 0 AND verdict = 'LEGITIMATE'")
    expected = d.transactions(spark, sf).filter("recipient_id < 40")
    return learning.bootstrap_trace(expected, d.observations(spark, sf), evidence)


# Stored decisions: one per usable case; a few are wrong on purpose.
STORED = f"""{TERMINAL}, de AS (
  SELECT case_id AS decision_id, customer_id, currency, 'CASE_UPDATE' AS kind, 'boss' AS actor,
    CASE WHEN captured_version = 31 THEN 'ACCEPT' WHEN verdict = 'LEGITIMATE' THEN 'ACCEPT'
      ELSE 'REJECT_FROM_PROFILE' END AS action, captured_version AS version_before,
    captured_version + CASE WHEN verdict = 'LEGITIMATE' THEN 1 ELSE 0 END AS version_after, case_id
  FROM ter WHERE verdict IS NOT NULL AND captured_version IS NOT NULL),
ee AS (SELECT de.decision_id, ter.case_id, ter.feedback_id,
    ter.transaction_id + CASE WHEN ter.captured_version = 33 THEN 1 ELSE 0 END AS transaction_id,
    CASE WHEN ter.captured_version = 35 THEN 'nobody' ELSE ter.reviewer END AS reviewer
  FROM de JOIN ter USING (case_id) WHERE ter.captured_version <> 37)"""


def _stored(spark, sf):
    usable = _terminal(spark, sf).filter("verdict IS NOT NULL AND captured_version IS NOT NULL")
    captured, legitimate = F.col("captured_version"), F.col("verdict") == "LEGITIMATE"
    decisions = usable.select(
        F.col("case_id").alias("decision_id"),
        *KEYS,
        F.lit("CASE_UPDATE").alias("kind"),
        F.lit("boss").alias("actor"),
        F.when((captured == 31) | legitimate, "ACCEPT")
        .otherwise("REJECT_FROM_PROFILE")
        .alias("action"),
        captured.alias("version_before"),
        (captured + F.when(legitimate, 1).otherwise(0)).alias("version_after"),
    )
    evidence = usable.filter(captured != 37).select(
        F.col("case_id").alias("decision_id"),
        "case_id",
        "feedback_id",
        (F.col("transaction_id") + F.when(captured == 33, 1).otherwise(0)).alias("transaction_id"),
        F.when(captured == 35, "nobody").otherwise(F.col("reviewer")).alias("reviewer"),
    )
    return decisions, evidence


@query(
    "q_learning_decision_check",
    f"""WITH {STORED} SELECT de.decision_id, concat_ws(',',
      CASE WHEN coalesce(e.n, 0) <> 1 THEN 'evidence_rows' END,
      CASE WHEN version_after IS DISTINCT FROM CASE WHEN action = 'ACCEPT' THEN version_before + 1
        ELSE version_before END THEN 'version' END) AS violations
    FROM de LEFT JOIN (SELECT decision_id, count(*) AS n FROM ee GROUP BY 1) e USING (decision_id)""",
)
def decision_check(spark, sf):
    return learning.decision_violations(*_stored(spark, sf)).select(
        "decision_id", _joined("violations")
    )


@query(
    "q_learning_evidence_check",
    f"""WITH {STORED} SELECT ee.case_id, concat_ws(',',
      CASE WHEN st.state IS DISTINCT FROM 'CLOSED' THEN 'not_closed' END,
      CASE WHEN st.transaction_id IS DISTINCT FROM ee.transaction_id THEN 'transaction' END,
      CASE WHEN fb.actor IS DISTINCT FROM ee.reviewer THEN 'reviewer' END,
      CASE WHEN NOT CASE WHEN fb.verdict = 'CONFIRMED_FRAUD' THEN action = 'REJECT_FROM_PROFILE'
        ELSE action IN ('ACCEPT', 'QUARANTINE') END THEN 'action' END) AS violations
    FROM ee JOIN de USING (decision_id) LEFT JOIN st ON st.case_id = ee.case_id
      LEFT JOIN fb ON fb.feedback_id = ee.feedback_id AND fb.case_id = ee.case_id""",
)
def evidence_check(spark, sf):
    decisions, evidence = _stored(spark, sf)
    checked = learning.evidence_violations(
        evidence, decisions, d.cases(spark, sf), d.transitions(spark, sf), d.feedback(spark, sf)
    )
    return checked.select("case_id", _joined("violations"))


@query(
    "q_evidence_reuse",
    f"""WITH {STORED} SELECT case_id, count(*) AS n FROM (SELECT case_id FROM ee UNION ALL
      SELECT case_id FROM ee WHERE reviewer = 'r1') GROUP BY 1 HAVING count(*) > 1""",
)
def evidence_reuse(spark, sf):
    _, evidence = _stored(spark, sf)
    twice = evidence.unionByName(evidence.filter("reviewer = 'r1'"))
    return validate.duplicates(twice, "case_id")
