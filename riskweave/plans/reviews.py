"""Queries over evaluations, cases, the console and event delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import cases, console, delivery, validate
from riskweave.plans import oracle as o
from riskweave.plans.registry import query
from riskweave.schemas import EVALUATION_DOCUMENT
from riskweave.sources import driver_tables as d
from riskweave.sources import sinks

# "Now" of the console and the delivery queue: 2024-01-25T12:00Z.
NOW = 1_706_184_000_000_000
DAY_START = NOW // o.DAY * o.DAY


def _joined(rows, column="violations"):
    return F.array_join(column, ",").alias(column)


@query(
    "q_latest_evaluation",
    f"""WITH {o.REVIEWS} SELECT transaction_id, evaluation_id, created_us, status, score, level
    FROM latest""",
)
def latest_evaluation(spark, sf):
    rows = d.evaluations(spark, sf)
    return cases.latest(rows, "transaction_id", ("created_us", "evaluation_id")).select(
        "transaction_id", "evaluation_id", "created_us", "status", "score", "level"
    )


@query(
    "q_json_risk_fields",
    f"""WITH {o.REVIEWS} SELECT evaluation_id, status, strategy, profile_version, suggested_action,
      CASE WHEN recipient_id = 22 THEN 'HIGH' ELSE level END AS level,
      CASE WHEN recipient_id = 23 THEN 1.5 ELSE score END AS score FROM ev""",
)
def json_risk_fields(spark, sf):
    rows = d.evaluation_documents(spark, sf).select(
        "evaluation_id", F.from_json("response_json", EVALUATION_DOCUMENT).alias("doc")
    )
    risk = F.col("doc.risk")
    return rows.select(
        "evaluation_id",
        risk["status"].alias("status"),
        risk["policy"]["strategy"].alias("strategy"),
        risk["profile_version"].cast("bigint").alias("profile_version"),
        risk["suggested_action"].alias("suggested_action"),
        risk["level"].alias("level"),
        risk["score"].alias("score"),
    )


@query(
    "q_envelope_check",
    f"""WITH {o.REVIEWS} SELECT evaluation_id, concat_ws(',',
      CASE WHEN recipient_id = 21 THEN 'evaluation_id' END,
      CASE WHEN status = 'INSUFFICIENT_EVIDENCE' AND recipient_id IN (22, 23)
        THEN 'decision_without_evidence' END,
      CASE WHEN status = 'SCORED' AND recipient_id = 23 THEN 'score' END) AS violations
    FROM ev""",
)
def envelope_check(spark, sf):
    checked = validate.envelope_violations(d.evaluation_documents(spark, sf))
    return checked.select("evaluation_id", _joined(checked))


@query(
    "q_case_state",
    f"WITH {o.REVIEWS} SELECT case_id, transaction_id, state FROM st",
)
def case_state(spark, sf):
    return cases.case_state(d.cases(spark, sf), d.transitions(spark, sf)).select(
        "case_id", "transaction_id", "state"
    )


@query(
    "q_case_transition_check",
    f"""WITH {o.REVIEWS}, j AS (
      SELECT t.*, p.target AS pt, p.at_us AS pa, cs.created_us,
        CASE WHEN t.sequence = 1 THEN 'OPEN' ELSE p.target END AS now_state,
        CASE WHEN t.sequence = 1 THEN cs.created_us ELSE p.at_us END AS since
      FROM tr t LEFT JOIN tr p ON p.case_id = t.case_id AND p.sequence = t.sequence - 1
        LEFT JOIN cs ON cs.case_id = t.case_id)
    SELECT case_id, sequence, concat_ws(',', CASE WHEN created_us IS NULL THEN 'missing_case' END,
      CASE WHEN sequence > 1 AND pt IS NULL THEN 'sequence_gap' END,
      CASE WHEN previous <> now_state THEN 'wrong_previous' END,
      CASE WHEN NOT ((previous = 'OPEN' AND target = 'UNDER_REVIEW')
        OR (previous = 'UNDER_REVIEW' AND target IN ('LEGITIMATE', 'CONFIRMED_FRAUD'))
        OR (previous IN ('LEGITIMATE', 'CONFIRMED_FRAUD') AND target = 'CLOSED'))
        THEN 'illegal_move' END,
      CASE WHEN at_us < since THEN 'time_backwards' END) AS violations FROM j""",
)
def transition_check(spark, sf):
    checked = cases.check_transitions(d.transitions(spark, sf), d.cases(spark, sf))
    return checked.select("case_id", "sequence", _joined(checked))


@query(
    "q_feedback_check",
    f"""WITH {o.REVIEWS}, j AS (
      SELECT f.*, p.at_us AS pa, s.at_us AS sa, s.actor AS sactor, r.u, r.t, e.ft,
        f.verdict IN ('LEGITIMATE', 'CONFIRMED_FRAUD') AS terminal
      FROM fb f LEFT JOIN fb p ON p.case_id = f.case_id AND p.sequence = f.sequence - 1
        LEFT JOIN tr s ON s.case_id = f.case_id AND s.target = f.verdict
        LEFT JOIN (SELECT case_id, min(at_us) FILTER (WHERE target = 'UNDER_REVIEW') AS u,
            min(at_us) FILTER (WHERE target IN ('LEGITIMATE', 'CONFIRMED_FRAUD')) AS t
          FROM tr GROUP BY 1) r ON r.case_id = f.case_id
        LEFT JOIN (SELECT case_id, min(sequence) AS ft FROM fb
          WHERE verdict IN ('LEGITIMATE', 'CONFIRMED_FRAUD') GROUP BY 1) e
          ON e.case_id = f.case_id)
    SELECT feedback_id, concat_ws(',', CASE WHEN sequence > 1 AND pa IS NULL THEN 'sequence_gap' END,
      CASE WHEN at_us < pa THEN 'time_backwards' END,
      CASE WHEN terminal AND NOT coalesce(sactor = actor AND sa = at_us, false)
        THEN 'terminal_mismatch' END,
      CASE WHEN terminal AND sequence > ft THEN 'terminal_repeated' END,
      CASE WHEN NOT terminal AND NOT coalesce(at_us >= u AND (t IS NULL OR at_us <= t), false)
        THEN 'not_under_review' END) AS violations FROM j""",
)
def feedback_check(spark, sf):
    checked = cases.check_feedback(d.feedback(spark, sf), d.transitions(spark, sf))
    return checked.select("feedback_id", _joined(checked))


@query(
    "q_unconfirmed_terminals",
    f"""WITH {o.REVIEWS} SELECT case_id, target FROM tr
    WHERE target IN ('LEGITIMATE', 'CONFIRMED_FRAUD') AND NOT EXISTS (
      SELECT 1 FROM fb WHERE fb.case_id = tr.case_id AND fb.verdict = tr.target
        AND fb.actor = tr.actor AND fb.at_us = tr.at_us)""",
)
def unconfirmed_terminals(spark, sf):
    return cases.unconfirmed_terminals(d.transitions(spark, sf), d.feedback(spark, sf)).select(
        "case_id", "target"
    )


@query(
    "q_review_document",
    f"""WITH {o.REVIEWS} SELECT st.case_id, 0 AS page, st.state,
      coalesce(h.n, 0) + coalesce(v.entries, 0) AS version, coalesce(h.n, 0)::INTEGER AS history_entries,
      coalesce(v.entries, 0)::INTEGER AS feedback_entries, st.state AS document_state,
      coalesce(h.targets, '') AS targets, v.last_verdict
    FROM st LEFT JOIN (SELECT case_id, count(*) AS n,
        string_agg(target, ',' ORDER BY sequence) AS targets FROM tr GROUP BY 1) h USING (case_id)
      LEFT JOIN lastv v USING (case_id)""",
)
def review_document(spark, sf):
    pages = cases.review_documents(
        d.cases(spark, sf), d.transitions(spark, sf), d.feedback(spark, sf)
    )
    schema = "state string, history array<struct<target:string>>, feedback array<struct<verdict:string>>"
    doc = pages.withColumn("doc", F.from_json("document", schema))
    return doc.select(
        "case_id",
        "page",
        "state",
        "version",
        "history_entries",
        "feedback_entries",
        F.col("doc.state").alias("document_state"),
        F.array_join("doc.history.target", ",").alias("targets"),
        F.try_element_at("doc.feedback.verdict", F.lit(-1)).alias("last_verdict"),
    )


@query(
    "q_duplicate_cases",
    f"""WITH {o.REVIEWS} SELECT assessment_id, count(*) AS n
    FROM (SELECT assessment_id FROM cs UNION ALL
      SELECT assessment_id FROM cs WHERE transaction_id % 7 = 0)
    GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_cases(spark, sf):
    """Some cases are opened twice."""
    cases = d.cases(spark, sf).select("assessment_id", "transaction_id")
    again = cases.filter("transaction_id % 7 = 0")
    return validate.duplicates(cases.union(again), "assessment_id")


@query(
    "q_verdict_confusion",
    f"""WITH {o.REVIEWS} SELECT fb.verdict, CASE WHEN score IS NULL THEN 'NONE'
      WHEN score >= 0.5 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS predicted, count(*) AS n
    FROM fb JOIN cs USING (case_id) JOIN ev ON ev.evaluation_id = cs.assessment_id
    WHERE fb.verdict IN ('LEGITIMATE', 'CONFIRMED_FRAUD') GROUP BY 1, 2""",
)
def verdict_confusion(spark, sf):
    return cases.verdict_confusion(
        d.feedback(spark, sf), d.cases(spark, sf), d.evaluations(spark, sf)
    )


@query(
    "q_scope_filter",
    f"""WITH {o.TX}, {o.CUSTOMERS} SELECT transaction_id, customer_id FROM tx
    WHERE customer_id IN (SELECT customer_id FROM cust WHERE segment = 'BUILDING')""",
)
def scope_filter(spark, sf):
    scope = d.customers(spark, sf).filter("segment = 'BUILDING'")
    return console.in_scope(d.transactions(spark, sf), scope).select(
        "transaction_id", "customer_id"
    )


def _worklist_sql(where: str) -> str:
    return f"""WITH {o.REVIEWS}, pg AS (
      SELECT *, row_number() OVER (ORDER BY us DESC, transaction_id DESC) AS rank,
        count(*) OVER () AS n FROM tx WHERE {where})
    SELECT pg.rank::INTEGER AS rank, pg.transaction_id, pg.us, pg.cents, latest.evaluation_id,
      latest.created_us AS evaluated_us, latest.status AS risk_status, latest.score, latest.level,
      latest.suggested_action, st.case_id, st.state, pg.n > 50 AND pg.rank = 50 AS next_page
    FROM pg LEFT JOIN latest USING (transaction_id)
      LEFT JOIN st ON st.assessment_id = latest.evaluation_id
    WHERE pg.rank <= 50"""


def _worklist(spark, sf, cursor=None):
    page = console.worklist(
        d.transactions(spark, sf).drop("status"),
        d.evaluations(spark, sf),
        d.cases(spark, sf),
        d.transitions(spark, sf),
        limit=50,
        cursor=cursor,
    )
    return page.select(
        "rank",
        "transaction_id",
        "us",
        "cents",
        "evaluation_id",
        "evaluated_us",
        F.col("status").alias("risk_status"),
        "score",
        "level",
        "suggested_action",
        "case_id",
        "state",
        "next_page",
    )


@query("q_worklist", _worklist_sql("true"))
def worklist(spark, sf):
    return _worklist(spark, sf)


CURSOR = (NOW, 5000)


@query(
    "q_worklist_page2",
    _worklist_sql(f"us < {CURSOR[0]} OR (us = {CURSOR[0]} AND transaction_id < {CURSOR[1]})"),
)
def worklist_page2(spark, sf):
    return _worklist(spark, sf, CURSOR)


@query(
    "q_worklist_filter",
    f"""WITH {o.REVIEWS} SELECT evaluation_id, level FROM ev WHERE level = 'HIGH'
    AND (CAST(transaction_id AS VARCHAR) LIKE '%42%' OR CAST(customer_id AS VARCHAR) LIKE '%42%'
      OR CAST(recipient_id AS VARCHAR) LIKE '%42%')""",
)
def worklist_filter(spark, sf):
    return console.worklist_filter(d.evaluations(spark, sf), " 42", "HIGH").select(
        "evaluation_id", "level"
    )


@query(
    "q_console_summary",
    f"""WITH {o.REVIEWS} SELECT {NOW} AS as_of_us, (SELECT count(*) FROM tx) AS transactions,
      (SELECT count(*) FROM tx WHERE us >= {DAY_START} AND us < {DAY_START + o.DAY} AND us <= {NOW})
        AS transactions_today,
      (SELECT count(*) FROM latest) AS evaluated,
      (SELECT count(*) FROM latest WHERE level IN ('HIGH', 'CRITICAL')) AS high_risk,
      CAST((SELECT coalesce(sum(cents), 0) FROM latest WHERE level IN ('HIGH', 'CRITICAL'))
        AS BIGINT) AS suspicious_cents,
      (SELECT count(*) FROM st WHERE state IN ('OPEN', 'UNDER_REVIEW')) AS awaiting_review,
      (SELECT count(*) FROM st JOIN lastv USING (case_id) WHERE last_verdict = 'CONFIRMED_FRAUD')
        AS confirmed_fraud""",
)
def console_summary(spark, sf):
    row = console.summary(
        d.transactions(spark, sf),
        d.evaluations(spark, sf),
        d.cases(spark, sf),
        d.transitions(spark, sf),
        d.feedback(spark, sf),
        NOW,
    )
    return row.withColumn("suspicious_cents", F.col("suspicious_cents").cast("bigint"))


def _stored(spark, sf):
    tx = d.transactions(spark, sf).filter("device_id <> 'view'")
    return tx.withColumn("cents", F.col("cents") + F.when(F.col("device_id") == "click", 1).otherwise(0))


FACT_SQL = """CASE device_id WHEN 'view' THEN 'ABSENT' WHEN 'click' THEN 'CONFLICT' ELSE 'MATCH' END"""


@query("q_fact_reconcile", f"WITH {o.TX} SELECT transaction_id, {FACT_SQL} AS fact FROM tx")
def fact_reconcile(spark, sf):
    return console.reconcile(d.transactions(spark, sf), _stored(spark, sf)).select(
        "transaction_id", "fact"
    )


@query("q_fact_counts", f"WITH {o.TX} SELECT {FACT_SQL} AS fact, count(*) AS n FROM tx GROUP BY 1")
def fact_counts(spark, sf):
    return console.counts_by(
        console.reconcile(d.transactions(spark, sf), _stored(spark, sf)), "fact"
    )


@query(
    "q_evidence_report",
    f"""WITH {o.REVIEWS}, f AS (SELECT transaction_id, {FACT_SQL} AS fact FROM tx),
    le AS (SELECT case_id, count(*) AS n,
        CASE verdict WHEN 'LEGITIMATE' THEN 'ACCEPT' ELSE 'REJECT_FROM_PROFILE' END AS action
      FROM st WHERE state = 'CLOSED' GROUP BY case_id, verdict)
    SELECT f.transaction_id, f.fact, ev.evaluation_id, ev.status AS risk_status,
      ev.profile_version, st.case_id, st.state, coalesce(lastv.entries, 0) AS feedback_entries,
      lastv.last_verdict, coalesce(le.n, 0) AS learning_entries, le.action AS last_action
    FROM f LEFT JOIN ev ON ev.transaction_id = f.transaction_id AND f.fact = 'MATCH'
      LEFT JOIN st ON st.assessment_id = ev.evaluation_id
      LEFT JOIN lastv ON lastv.case_id = st.case_id LEFT JOIN le ON le.case_id = st.case_id""",
)
def evidence_report(spark, sf):
    facts = console.reconcile(d.transactions(spark, sf), _stored(spark, sf)).select(
        "transaction_id", "fact"
    )
    moves = d.transitions(spark, sf)
    closed = cases.case_state(d.cases(spark, sf), moves).filter("state = 'CLOSED'")
    decisions = closed.select(
        F.col("case_id").alias("decision_id"),
        F.when(F.col("verdict") == "LEGITIMATE", "ACCEPT")
        .otherwise("REJECT_FROM_PROFILE")
        .alias("action"),
        F.lit("REVIEWED").alias("reason"),
    )
    evidence = closed.select("case_id", F.col("case_id").alias("decision_id"))
    report = console.evidence_report(
        facts,
        d.evaluations(spark, sf),
        d.cases(spark, sf),
        moves,
        d.feedback(spark, sf),
        decisions,
        evidence,
    )
    return report.drop("last_reason")


# --- event delivery -----------------------------------------------------------------------------


@query(
    "q_pending_events",
    f"""WITH {o.OUTBOX} SELECT event_id, occurred_us, attempts FROM outbox
    WHERE published_us IS NULL ORDER BY occurred_us, event_id LIMIT 1000""",
)
def pending_events(spark, sf):
    return delivery.pending(d.outbox(spark, sf), 1000).select(
        "event_id", "occurred_us", "attempts"
    )


@query(
    "q_delivery_due",
    f"""WITH {o.OUTBOX} SELECT event_id, available_us, attempts FROM dl JOIN outbox USING (event_id)
    WHERE completed_us IS NULL AND dead_us IS NULL AND published_us IS NULL
      AND available_us <= {NOW} AND (lease_us IS NULL OR lease_us <= {NOW})
    ORDER BY available_us, event_id LIMIT 100""",
)
def delivery_due(spark, sf):
    return delivery.due(d.deliveries(spark, sf), d.outbox(spark, sf), NOW).select(
        "event_id", "available_us", "attempts"
    )


@query(
    "q_backoff",
    f"""WITH {o.TX} SELECT transaction_id, least(3600, CAST(5 * pow(2,
      least(greatest(recipient_id - 1, 0), 40)) AS BIGINT)) AS seconds FROM tx""",
)
def backoff(spark, sf):
    return d.transactions(spark, sf).select(
        "transaction_id", delivery.backoff(F.col("recipient_id")).alias("seconds")
    )


def _claims(spark, sf):
    return (
        d.deliveries(spark, sf)
        .join(d.outbox(spark, sf).select("event_id", "attempts", "event_type"), "event_id")
        .withColumn("lease_us", F.coalesce("lease_us", F.lit(NOW + 1)))
        .withColumn("succeeded", F.col("dead_us").isNull())
    )


CLAIMS = f"""{o.OUTBOX}, cl AS (
  SELECT event_id, attempts, coalesce(lease_us, {NOW + 1}) AS lease, dead_us IS NULL AS ok
  FROM dl JOIN outbox USING (event_id)),
oc AS (SELECT event_id, attempts, CASE WHEN attempts >= 5 THEN 'DEAD_EXHAUSTED'
    WHEN lease <= {NOW} THEN 'STALE' WHEN ok THEN 'PUBLISHED'
    WHEN attempts + 1 >= 5 THEN 'DEAD_FAILED' ELSE 'RETRY' END AS outcome FROM cl)"""


@query(
    "q_delivery_outcomes",
    f"""WITH {CLAIMS} SELECT event_id, outcome, CASE WHEN outcome = 'RETRY' THEN
      {NOW} + least(3600, CAST(5 * pow(2, attempts) AS BIGINT)) * 1000000 END AS next_us FROM oc""",
)
def delivery_outcomes(spark, sf):
    return delivery.outcomes(_claims(spark, sf), NOW).select("event_id", "outcome", "next_us")


@query(
    "q_delivery_tally",
    f"""WITH {CLAIMS} SELECT count(*) FILTER (WHERE outcome <> 'DEAD_EXHAUSTED') AS claimed,
      count(*) FILTER (WHERE outcome = 'PUBLISHED') AS published,
      count(*) FILTER (WHERE outcome IN ('RETRY', 'DEAD_FAILED')) AS failed,
      count(*) FILTER (WHERE outcome = 'STALE') AS stale FROM oc""",
)
def delivery_tally(spark, sf):
    return delivery.tally(delivery.outcomes(_claims(spark, sf), NOW))


@query(
    "q_delivery_status",
    f"""WITH {o.OUTBOX} SELECT count(*) FILTER (WHERE published_us IS NOT NULL) AS published,
      count(*) FILTER (WHERE dead_us IS NOT NULL) AS dead,
      count(*) FILTER (WHERE published_us IS NULL AND dead_us IS NULL) AS pending,
      count(*) FILTER (WHERE lease_us > {NOW}) AS leased,
      count(*) FILTER (WHERE lease_us <= {NOW}) AS expired_leases
    FROM dl JOIN outbox USING (event_id)""",
)
def delivery_status(spark, sf):
    return delivery.status(d.deliveries(spark, sf), d.outbox(spark, sf), NOW)


@query(
    "q_dead_letters",
    f"""WITH {o.OUTBOX} SELECT event_id, last_error, attempts FROM dl JOIN outbox USING (event_id)
    WHERE dead_us IS NOT NULL ORDER BY dead_us, event_id LIMIT 100""",
)
def dead_letters(spark, sf):
    return delivery.dead_letters(d.deliveries(spark, sf), d.outbox(spark, sf))


@query(
    "q_receipts_dedup",
    f"""WITH {o.OUTBOX} SELECT 'recording' AS consumer_id, event_id, min(occurred_us) AS recorded_us
    FROM (SELECT event_id, occurred_us FROM outbox UNION ALL
      SELECT event_id, occurred_us + 5 FROM outbox)
    WHERE event_id NOT IN (SELECT event_id FROM outbox WHERE published_us IS NOT NULL)
    GROUP BY 1, 2""",
)
def receipts_dedup(spark, sf):
    events = d.outbox(spark, sf).withColumn("consumer_id", F.lit("recording"))
    seen = events.select("consumer_id", "event_id", F.col("occurred_us").alias("recorded_us"))
    again = seen.withColumn("recorded_us", F.col("recorded_us") + 5)
    return delivery.new_receipts(
        seen.unionByName(again), events.filter("published_us IS NOT NULL")
    )


# --- consistency of stored results --------------------------------------------------------------


@query(
    "q_level_action_check",
    f"""WITH {o.REVIEWS} SELECT evaluation_id FROM ev
    WHERE level IS NOT NULL AND recipient_id IN (24, 25) AND level <> 'HIGH'""",
)
def level_action_check(spark, sf):
    rows = d.evaluations(spark, sf).filter("level IS NOT NULL")
    shown = F.when(F.col("recipient_id").isin(24, 25), "HOLD_AND_REVIEW").otherwise(
        F.col("suggested_action")
    )
    return rows.filter(validate.level_action_broken(F.col("level"), shown)).select("evaluation_id")


@query(
    "q_score_domain",
    f"""WITH {o.REVIEWS} SELECT evaluation_id FROM ev WHERE score IS NULL OR score > 0.98""",
)
def score_domain(spark, sf):
    shown = F.when(F.col("score") > 0.98, F.col("score") + 1).otherwise(F.col("score"))
    return d.evaluations(spark, sf).filter(validate.score_broken(shown)).select("evaluation_id")


@query(
    "q_evidence_documents",
    f"""WITH {o.REVIEWS}, t AS (SELECT evaluation_id, '{{"evaluation_id":' || evaluation_id ||
        ',"level":' || coalesce('"' || level || '"', 'null') ||
        ',"status":"' || status || '","transaction_id":' || transaction_id || '}}' AS document
      FROM ev)
    SELECT evaluation_id, document, sha256(document) AS sha256 FROM t""",
)
def evidence_documents(spark, sf):
    rows = d.evaluations(spark, sf).select("evaluation_id", "transaction_id", "level", "status")
    return sinks.evidence_documents(rows, "evaluation_id")


@query(
    "q_domain_events",
    f"""WITH {o.REVIEWS} SELECT 'RISK_EVALUATED' AS event_type,
      CAST(transaction_id AS VARCHAR) AS aggregate_id, created_us AS occurred_us,
      1 AS schema_version, count(*) AS n FROM ev GROUP BY 1, 2, 3, 4""",
)
def domain_events(spark, sf):
    rows = d.evaluations(spark, sf).select("evaluation_id", "transaction_id", "created_us")
    events = sinks.domain_events(rows, "RISK_EVALUATED", "transaction_id", "created_us")
    return events.groupBy("event_type", "aggregate_id", "occurred_us", "schema_version").agg(
        F.count_distinct("event_id").alias("n")
    )
