"""Queries from the feature vector to banded decisions and sequence evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import explain, features, risk, rules, sequence
from riskweave.plans import oracle as o
from riskweave.plans.registry import query
from riskweave.schemas import FEATURE_NAMES
from riskweave.sources import driver_tables as d

def _pick(frame, names, *more):
    """Features of every candidate; NULL where the history is refused."""
    kept = "CASE WHEN NOT history_limit_exceeded THEN"
    return features.candidates(frame).selectExpr(
        "transaction_id", *more, *(f"{kept} {features.FEATURES[name]} END AS {name}" for name in names)
    )


@query(
    "q_baseline_features",
    f"WITH {o.BASELINE} SELECT transaction_id, {o.BASELINE_FEATURES} FROM b",
)
def baseline_features(spark, sf):
    frame = features.with_baseline(features.baseline_frame(d.admitted(spark, sf)))
    return _pick(frame, features.BASELINE_FEATURES)


@query(
    "q_hour_features",
    f"WITH {o.BASELINE} SELECT transaction_id, {o.HOUR_FEATURES} FROM b",
)
def hour_features(spark, sf):
    frame = features.with_baseline(features.baseline_frame(d.admitted(spark, sf)))
    return _pick(features.with_hour_gap(frame), features.HOUR_FEATURES)


@query(
    "q_short_window_ratio",
    f"""WITH {o.BASELINE.replace(f"c.us - {30 * o.DAY})", f"c.us - {7 * o.DAY})")}
    SELECT transaction_id, CAST(ns AS DOUBLE) AS short_history_count,
      CASE WHEN nl >= 5 AND ns >= 5 THEN CAST(smed2 AS DOUBLE) / CAST(med2 AS DOUBLE) ELSE 0.0 END
        AS short_term_vs_long_term_amount_ratio,
      CASE WHEN nl >= 5 AND ns >= 5 THEN 0.0::DOUBLE ELSE 1.0 END AS short_baseline_insufficient
    FROM b""",
)
def short_window(spark, sf):
    frame = features.with_baseline(
        features.baseline_frame(d.admitted(spark, sf)), long_days=180, short_days=7
    )
    wanted = (
        "short_history_count",
        "short_term_vs_long_term_amount_ratio",
        "short_baseline_insufficient",
    )
    return _pick(frame, wanted)


def _activity(source: str, columns: str) -> str:
    return f"""WITH {source}, act AS (SELECT *, {o.ACTIVITY_COLUMNS} FROM tx), {o.LAST_DEVICE}
    SELECT transaction_id, {columns}
    FROM act LEFT JOIN inst USING (customer_id, currency, last_us)"""


RECIPIENT_SQL = """CAST(nr60 AS DOUBLE) AS recipient_transactions_last_hour,
  coalesce(CAST(us - first_r AS DOUBLE) / 86400000000.0, 0.0) AS recipient_observed_age_days,
  CASE WHEN first_r IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS recipient_activity_missing"""
DEVICE_SQL = """CASE WHEN last_device IS NOT NULL AND device_id <> last_device THEN 1.0::DOUBLE ELSE 0.0 END
    AS device_changed,
  CASE WHEN last_device IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS device_change_missing,
  CASE WHEN na > 0 AND ndev = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS device_not_seen_before,
  coalesce(CAST(us - last_us AS DOUBLE) / 86400000000.0, 0.0) AS days_since_last_transfer"""


RECIPIENT_COLUMNS = (
    "recipient_transactions_last_hour",
    "recipient_observed_age_days",
    "recipient_activity_missing",
)
DEVICE_COLUMNS = (
    "device_changed",
    "device_change_missing",
    "device_not_seen_before",
    "days_since_last_transfer",
)


def _recipient(tx, *more, limit=features.HISTORY_LIMIT):
    frame = features.with_recipient_history(features.activity_frame(tx, limit))
    return _pick(frame, RECIPIENT_COLUMNS, *more)


def _device(tx, *more, limit=features.HISTORY_LIMIT):
    frame = features.with_device_history(features.with_velocity(features.activity_frame(tx, limit)))
    return _pick(frame, DEVICE_COLUMNS, *more)


# A limit that many candidates pass, so that refusals are compared too.
LOW_LIMIT = 20


def refused(columns, n: str = "na", limit: int = LOW_LIMIT) -> str:
    values = ", ".join(f"CASE WHEN {n} <= {limit} THEN {c} END AS {c}" for c in columns)
    return f"transaction_id, {n} > {limit} AS history_limit_exceeded, {values}"


def _limited(columns_sql: str, columns) -> str:
    return f"""WITH {o.TX}, act AS (SELECT *, {o.ACTIVITY_COLUMNS} FROM tx), {o.LAST_DEVICE},
    v AS (SELECT transaction_id, na, {columns_sql}
      FROM act LEFT JOIN inst USING (customer_id, currency, last_us))
    SELECT {refused(columns)} FROM v"""


@query("q_recipient_age_limited", _limited(RECIPIENT_SQL, RECIPIENT_COLUMNS))
def recipient_age_limited(spark, sf):
    return _recipient(d.transactions(spark, sf), "history_limit_exceeded", limit=LOW_LIMIT)


@query("q_device_limited", _limited(DEVICE_SQL, DEVICE_COLUMNS))
def device_limited(spark, sf):
    return _device(d.transactions(spark, sf), "history_limit_exceeded", limit=LOW_LIMIT)


@query("q_recipient_age", _activity(o.TX, RECIPIENT_SQL))
def recipient_age(spark, sf):
    return _recipient(d.transactions(spark, sf))


@query("q_recipient_age_slow", _activity(o.SLOW, RECIPIENT_SQL))
def recipient_age_slow(spark, sf):
    return _recipient(d.slow_transactions(spark, sf))


@query("q_device", _activity(o.TX, DEVICE_SQL))
def device(spark, sf):
    return _device(d.transactions(spark, sf))


@query("q_device_slow", _activity(o.SLOW, DEVICE_SQL))
def device_slow(spark, sf):
    return _device(d.slow_transactions(spark, sf))


@query(
    "q_feature_contract",
    f"""WITH {o.FEATURES}
    SELECT CASE WHEN coalesce(transactions_last_5_min <= transactions_last_10_min
        AND transactions_last_10_min <= transactions_last_hour
        AND transactions_last_hour <= activity_history_count, false) THEN '' ELSE 'velocity_order'
        END AS violations, count(*) AS n FROM f GROUP BY 1""",
)
def feature_contract(spark, sf):
    checked = rules.feature_violations(features.behavior_v1(d.admitted(spark, sf)), FEATURE_NAMES)
    return checked.groupBy(F.array_join("violations", ",").alias("violations")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _rule_sql(ratio: float = 10.0, velocity: int = 5) -> str:
    return f"""{o.FEATURES}, r AS (
  SELECT transaction_id, code, feature, observed, threshold, missing,
    CASE WHEN missing <> '' THEN 'NOT_EVALUATED' WHEN observed >= threshold THEN 'MATCHED'
         ELSE 'NOT_MATCHED' END AS status, place
  FROM (
    SELECT transaction_id, 0 AS place, 'AMOUNT_ANOMALY' AS code,
      'amount_vs_customer_median' AS feature,
      amount_vs_customer_median AS observed, CAST({ratio} AS DOUBLE) AS threshold,
      concat_ws(',', CASE WHEN profile_missing = 1 THEN 'profile_missing' END,
        CASE WHEN baseline_insufficient = 1 THEN 'baseline_insufficient' END) AS missing FROM f
    UNION ALL
    SELECT transaction_id, 1, 'NEW_RECIPIENT', 'new_recipient', new_recipient, 1.0,
      concat_ws(',', CASE WHEN profile_missing = 1 THEN 'profile_missing' END,
        CASE WHEN baseline_insufficient = 1 THEN 'baseline_insufficient' END) FROM f
    UNION ALL
    SELECT transaction_id, 2, 'HIGH_VELOCITY', 'transactions_last_5_min', transactions_last_5_min,
      {velocity}.0,
      concat_ws(',', CASE WHEN activity_history_missing = 1 THEN 'activity_history_missing' END)
      FROM f
    UNION ALL
    SELECT transaction_id, 3, 'UNUSUAL_TIME', 'unusual_hour', unusual_hour, 1.0,
      concat_ws(',', CASE WHEN profile_missing = 1 THEN 'profile_missing' END,
        CASE WHEN baseline_insufficient = 1 THEN 'baseline_insufficient' END,
        CASE WHEN typical_hours_missing = 1 THEN 'typical_hours_missing' END) FROM f
    UNION ALL
    SELECT transaction_id, 4, 'DEVICE_CHANGED', 'device_changed', device_changed, 1.0,
      concat_ws(',', CASE WHEN activity_history_missing = 1 THEN 'activity_history_missing' END,
        CASE WHEN device_change_missing = 1 THEN 'device_change_missing' END) FROM f)),
m AS (
  SELECT *, CASE WHEN status <> 'MATCHED' THEN NULL WHEN code = 'AMOUNT_ANOMALY' THEN
      'Amount is ' || format('{{:.6g}}', observed) ||
      ' times the admitted long-window median (threshold {ratio:g}).'
    WHEN code = 'NEW_RECIPIENT' THEN 'Recipient is absent from the admitted long-window history.'
    WHEN code = 'HIGH_VELOCITY' THEN 'Captured activity contains ' || format('{{:g}}', observed)
      || ' prior transfers strictly within five minutes.'
    WHEN code = 'UNUSUAL_TIME' THEN
      'Transaction hour is outside the admitted history''s frequency-qualified hours.'
    ELSE 'Device differs from the last unambiguous device in captured activity.' END AS message
  FROM r)"""


def _ruled(spark, sf, policy=rules.RulePolicy(), keep=()):
    return rules.rules_v1(features.behavior_v1(d.admitted(spark, sf), keep=keep), policy)


@query(
    "q_rules",
    f"""WITH {_rule_sql()} SELECT transaction_id, code, status, feature, observed, threshold,
    missing, message FROM m""",
)
def rules_long(spark, sf):
    return rules.rule_rows(_ruled(spark, sf))


@query(
    "q_rules_velocity_one",
    f"""WITH {_rule_sql(velocity=1)} SELECT code, status, count(*) AS n FROM m GROUP BY 1, 2""",
)
def rules_velocity_one(spark, sf):
    return rules.rule_counts(_ruled(spark, sf, rules.RulePolicy(prior_transfers_5_min=1)))


@query(
    "q_rule_reasons",
    f"""WITH {_rule_sql()} SELECT transaction_id, code, message,
    CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY place) - 1 AS INTEGER) AS place
    FROM m WHERE status = 'MATCHED'""",
)
def rule_reasons(spark, sf):
    return rules.rule_reasons(_ruled(spark, sf))


@query(
    "q_rule_counts",
    f"WITH {_rule_sql()} SELECT code, status, count(*) AS n FROM m GROUP BY 1, 2",
)
def rule_counts(spark, sf):
    return rules.rule_counts(_ruled(spark, sf))


RISK_ITEMS = """, s0 AS (
  SELECT transaction_id,
    bool_or(status = 'NOT_EVALUATED') AS abstain,
    string_agg(code, ',' ORDER BY place) FILTER (WHERE status = 'NOT_EVALUATED') AS na_codes,
    fsum(CAST(CASE WHEN status <> 'MATCHED' THEN 0.0 WHEN code = 'AMOUNT_ANOMALY' THEN 0.4
      WHEN code = 'NEW_RECIPIENT' THEN 0.15 WHEN code = 'HIGH_VELOCITY' THEN 0.25
      ELSE 0.1 END AS DOUBLE) ORDER BY place) AS raw
  FROM m GROUP BY 1),
s AS (
  SELECT transaction_id, CASE WHEN abstain THEN NULL ELSE raw END AS rule_score,
    coalesce(na_codes, '') AS unavailable_rules FROM s0)"""


def _banded(score: str) -> str:
    return f"""CASE WHEN {score} >= 0.85 THEN 'CRITICAL' WHEN {score} >= 0.65 THEN 'HIGH'
      WHEN {score} >= 0.35 THEN 'MEDIUM' WHEN {score} IS NOT NULL THEN 'LOW' END AS level,
    CASE WHEN {score} >= 0.85 THEN 'URGENT_REVIEW' WHEN {score} >= 0.65 THEN 'HOLD_AND_REVIEW'
      WHEN {score} >= 0.35 THEN 'STEP_UP_VERIFICATION' WHEN {score} IS NOT NULL THEN 'ALLOW'
      END AS suggested_action,
    CASE WHEN {score} IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SCORED' END AS status"""


RISK_COLUMNS = (
    "transaction_id",
    "rule_score",
    "score",
    "level",
    "suggested_action",
    "status",
    "unavailable_rules",
)


@query(
    "q_risk_rules_only",
    f"""WITH {_rule_sql()}{RISK_ITEMS}
    SELECT transaction_id, rule_score, rule_score AS score, {_banded("rule_score")},
      unavailable_rules FROM s""",
)
def risk_rules_only(spark, sf):
    return risk.risk(_ruled(spark, sf)).select(*RISK_COLUMNS)


@query(
    "q_risk_strategies",
    f"""WITH {_rule_sql()}{RISK_ITEMS},
    x AS (SELECT s.*, recipient_id / 100.0 AS model FROM s JOIN tx USING (transaction_id)),
    y AS (
      SELECT transaction_id, 'rules_only' AS strategy, rule_score AS score FROM x UNION ALL
      SELECT transaction_id, 'ml_only', model FROM x UNION ALL
      SELECT transaction_id, 'hybrid',
        CASE WHEN rule_score IS NOT NULL THEN 0.5::DOUBLE * model + 0.5::DOUBLE * rule_score END
      FROM x)
    SELECT transaction_id, strategy, score, {_banded("score")} FROM y""",
)
def risk_strategies(spark, sf):
    ruled = _ruled(spark, sf, keep=("recipient_id",))
    model = F.col("recipient_id").cast("double") / 100
    scored = ruled.withColumn("rule_score", risk.rule_score(F.col("rules"), risk.RiskPolicy().rule_weights))
    each = F.array(
        *(
            F.struct(
                F.lit(name).alias("strategy"),
                risk.combine(risk.RiskPolicy(name), F.col("rule_score"), model).alias("score"),
            )
            for name in risk.STRATEGIES
        )
    )
    rows = scored.select("transaction_id", F.inline(each))
    band = risk.level(F.col("score"))
    return rows.select(
        "transaction_id",
        "strategy",
        "score",
        band.alias("level"),
        risk.action(band).alias("suggested_action"),
        F.when(F.col("score").isNull(), "INSUFFICIENT_EVIDENCE").otherwise("SCORED").alias("status"),
    )


@query(
    "q_decision_bands",
    f"""WITH {o.TX}, s AS (SELECT transaction_id, recipient_id / 100.0 AS score FROM tx)
    SELECT transaction_id, score, {_banded("score")} FROM s""",
)
def decision_bands(spark, sf):
    rows = d.transactions(spark, sf).select(
        "transaction_id", (F.col("recipient_id").cast("double") / 100).alias("score")
    )
    band = risk.level(F.col("score"))
    return rows.withColumns(
        {"level": band, "suggested_action": risk.action(band), "status": F.lit("SCORED")}
    )


SEQUENCE_SQL = f"""WITH {o.BASELINE.replace(
    o.held("admitted", "p.admitted_us"),
    o.held("(SELECT * REPLACE (recipient_id // 10 AS recipient_id) FROM admitted)", "p.admitted_us"),
)},
q0 AS (
  SELECT *, list_sort(list({{'us': us, 'id': CAST(transaction_id AS VARCHAR), 'c': cents}})
      OVER {o.frame(o.KEYS, 24 * o.HOUR)}) AS prev,
    count(*) OVER {o.frame(o.KEYS, 180 * o.DAY)} AS na,
    count(*) OVER {o.frame(o.KEYS, 24 * o.HOUR)} + 1 AS n24,
    coalesce(sum(cents) OVER {o.frame(o.KEYS, 24 * o.HOUR)}, 0) + cents AS sum24,
    count(*) OVER {o.frame(o.KEYS + ", recipient_id", 24 * o.HOUR)} + 1 AS nr,
    coalesce(sum(cents) OVER {o.frame(o.KEYS + ", recipient_id", 24 * o.HOUR)}, 0) + cents AS sumr
  FROM b),
q1 AS (
  SELECT *, list_append(list_transform(coalesce(prev, []), lambda x: x.c), cents) AS whole,
    CASE WHEN NOT pm AND nl >= 5 THEN med2 END AS m,
    concat_ws(',', CASE WHEN pm THEN 'profile_missing' WHEN nl < 5 THEN 'baseline_insufficient' END,
      CASE WHEN na = 0 THEN 'activity_history_missing' END) AS missing FROM q0),
q2 AS (SELECT *, whole[greatest(len(whole) - 3, 1):] AS l4 FROM q1),
q3 AS (SELECT *, list_sum(l4) AS t4, len(l4) AS k4 FROM q2),
q AS (
  SELECT transaction_id, missing, 'CUMULATIVE_LOW_VALUE_SEQUENCE' AS code, k4 AS observed_count,
    t4 AS observed_cents, CAST(2 * t4 AS DOUBLE) / CAST(m AS DOUBLE) AS cumulative_ratio,
    NULL AS growth_ratio, 4 AS threshold_count, 2.0::DOUBLE AS threshold_cumulative_ratio,
    NULL AS threshold_growth_ratio,
    k4 = 4 AND list_max(l4) * 2 <= m AND 2 * t4 >= 2 * m AS hit FROM q3
  UNION ALL
  SELECT transaction_id, missing, 'GRADUAL_AMOUNT_ESCALATION', k4, t4,
    CAST(2 * t4 AS DOUBLE) / CAST(m AS DOUBLE), CAST(l4[k4] AS DOUBLE) / CAST(l4[1] AS DOUBLE), 4,
    2.0, 2.0::DOUBLE,
    k4 = 4 AND l4[1] < l4[2] AND l4[2] < l4[3] AND l4[3] < l4[4] AND l4[4] >= 2 * l4[1]
      AND 2 * t4 >= 2 * m FROM q3
  UNION ALL
  SELECT transaction_id, missing, 'REPEATED_NEW_RECIPIENT', nr, sumr,
    CAST(2 * sumr AS DOUBLE) / CAST(m AS DOUBLE), NULL, 3, NULL, NULL, known = 0 AND nr >= 3 FROM q3
  UNION ALL
  SELECT transaction_id, missing, 'CUMULATIVE_AMOUNT_EXPOSURE', n24, sum24,
    CAST(2 * sum24 AS DOUBLE) / CAST(m AS DOUBLE), NULL, 3, 5.0, NULL,
    n24 >= 3 AND 2 * sum24 >= 5 * m FROM q3)
SELECT transaction_id, code, CASE WHEN missing <> '' THEN 'NOT_EVALUATED' WHEN hit THEN 'MATCHED'
    ELSE 'NOT_MATCHED' END AS status, observed_count, CAST(observed_cents AS BIGINT) AS observed_cents,
  cumulative_ratio, growth_ratio, threshold_count, threshold_cumulative_ratio,
  threshold_growth_ratio, 24 AS window_hours, missing FROM q"""


@query("q_sequence", SEQUENCE_SQL)
def sequence_evidence(spark, sf):
    tx = d.admitted(spark, sf).withColumn(
        "recipient_id", F.floor(F.col("recipient_id") / 10).cast("bigint")
    )
    rows = sequence.sequence_rows(sequence.sequence_v1(tx))
    return rows.withColumn("observed_cents", F.col("observed_cents").cast("bigint"))


# A fixed linear model, used to exercise the explanation operators.
LINEAR = tuple(((i * 7) % 11 - 5) / 8 for i in range(len(FEATURE_NAMES)))


def _contribution_sql() -> str:
    rows = []
    for i, name in enumerate(FEATURE_NAMES):
        flags = ", ".join(
            f"CASE WHEN {flag} = 1 THEN '{flag}' END" for flag in explain.AVAILABILITY.get(name, ())
        )
        missing = f"concat_ws(',', {flags})" if flags else "''"
        rows.append(
            f"SELECT transaction_id, {i} AS place, '{name}' AS feature, {name} AS value, "
            f"{name} * CAST({LINEAR[i]} AS DOUBLE) AS contribution, {missing} AS missing, "
            f"'{explain.LABELS[name]}' AS label FROM f"
        )
    return " UNION ALL ".join(rows)


@query(
    "q_top_contributions",
    f"""WITH {o.FEATURES}, c AS ({_contribution_sql()}), t AS (
      SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY -abs(contribution), place)
        AS rank FROM c)
    SELECT transaction_id, CAST(rank AS INTEGER) AS rank, feature, value, contribution, missing,
      label || CASE WHEN missing <> '' THEN ': unavailable; encoded value ' ||
          format('{{:.6g}}', value) || ' is a placeholder.'
        ELSE ': encoded value ' || format('{{:.6g}}', value) || '.' END
      || ' Model attribution ' || CASE WHEN contribution > 0 THEN 'adds to'
        WHEN contribution < 0 THEN 'subtracts from' ELSE 'does not change' END
      || ' the raw margin (' || format('{{:+.6g}}', contribution + 0.0) || ').' AS message
    FROM t WHERE rank <= 5""",
)
def top_contributions(spark, sf):
    explained = explain.linear_contributions(
        features.behavior_v1(d.admitted(spark, sf)), LINEAR, -1.0
    )
    return explain.top_contributions(explained)


@query(
    "q_explanation_check",
    f"""WITH {o.TX} SELECT recipient_id NOT IN (7, 8, 9) AS consistent, count(*) AS n
    FROM tx GROUP BY 1""",
)
def explanation_check(spark, sf):
    """Some explanations are broken: their score, their margin, or a contribution is gone."""
    rows = features.behavior_v1(d.admitted(spark, sf), keep=("recipient_id",))
    explained = explain.linear_contributions(rows, LINEAR, -1.0, [0.5] * len(FEATURE_NAMES))
    recipient, parts = F.col("recipient_id"), F.col("contributions")
    broken = explained.withColumns(
        {
            "score": F.col("score") + F.when(recipient == 7, 0.1).otherwise(0.0),
            "raw_margin": F.col("raw_margin") + F.when(recipient == 8, 0.5).otherwise(0.0),
            "contributions": F.when(recipient == 9, F.slice(parts, 1, 28)).otherwise(parts),
        }
    )
    checked = explain.with_consistency(broken)
    return checked.groupBy("consistent").agg(F.count(F.lit(1)).alias("n"))
