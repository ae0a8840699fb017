"""SQL twins of the derived tables, as reusable WITH items for an independent engine."""

from __future__ import annotations

DAY = 86_400_000_000

TX = """tx AS (
  SELECT event_id AS transaction_id, user_id AS customer_id,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 = 4 THEN 'USD' ELSE 'KZT' END AS currency,
         epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS recipient_id,
         event_type AS device_id,
         CASE event_type WHEN 'view' THEN 'WEB' WHEN 'click' THEN 'MOBILE'
              WHEN 'signup' THEN 'BRANCH' WHEN 'purchase' THEN 'MOBILE' ELSE 'ATM' END AS channel,
         'RECEIVED' AS status
  FROM events)"""

SLOW = """tx AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, 'KZT' AS currency,
         epoch_us(o_orderdate) AS us, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         coalesce(r.supp, -1) AS recipient_id, o_orderpriority AS device_id
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS supp FROM lineitem GROUP BY 1) r
    ON r.l_orderkey = o_orderkey)"""

CUSTOMERS = """cust AS (
  SELECT c_custkey AS customer_id, c_mktsegment AS segment,
         ['Asia/Almaty', 'UTC', 'America/New_York', 'Europe/London', 'Asia/Kolkata']
           [c_nationkey % 5 + 1] AS timezone
  FROM customer)"""

REVIEWED = (
    TX
    + """, reviewed AS (
  SELECT *, CASE WHEN device_id = 'error' THEN 'CONFIRMED_FRAUD'
                 WHEN device_id = 'signup' AND recipient_id < 30 THEN 'NEEDS_INVESTIGATION'
                 WHEN device_id = 'signup' AND recipient_id < 60 THEN NULL
                 ELSE 'LEGITIMATE' END AS verdict
  FROM tx)"""
)

ADMITTED = (
    REVIEWED
    + ", "
    + CUSTOMERS
    + """, admitted AS (
  SELECT reviewed.*, CASE WHEN verdict = 'LEGITIMATE'
           THEN us + CAST(recipient_id % 5 AS BIGINT) * 21600000000 END AS admitted_us,
         coalesce(cust.timezone, 'UTC') AS timezone
  FROM reviewed LEFT JOIN cust USING (customer_id)),
obs AS (SELECT * FROM admitted WHERE admitted_us IS NOT NULL)"""
)

LABELED = (
    ADMITTED
    + """, labeled AS (
  SELECT a.*, us + d AS available_us, us + d + 2 * 86400000000 AS label_available_us,
         CASE WHEN device_id = 'error' THEN 1 ELSE 0 END AS label
  FROM (SELECT *, CASE WHEN recipient_id < 33 THEN 0 WHEN recipient_id < 66 THEN 120000000
                       ELSE 7200000000 END AS d FROM admitted) a)"""
)


def hour_of(us: str, zone: str) -> str:
    """Local hour of UTC microseconds in a named zone."""
    return f"CAST(hour(timezone({zone}, timezone('UTC', make_timestamp({us})))) AS INTEGER)"


def frame(keys: str, span: int) -> str:
    return (
        f"(PARTITION BY {keys} ORDER BY us RANGE BETWEEN {span - 1} PRECEDING AND 1 PRECEDING)"
    )


KEYS = "customer_id, currency"
MINUTE = 60_000_000
HOUR = 60 * MINUTE

# Baselines: sorted admitted cents inside the long and short windows of each row. A row counts from
# the time it was admitted; ``seen`` is that time.


def held(source: str, seen: str, span: int = 30 * DAY) -> str:
    return f"""b0 AS (
  SELECT c.*, s.since, {seen.replace("p.", "c.")} AS own_seen, w.al, w.ash, w.hl,
    coalesce(w.known, 0) AS known
  FROM {source} c
  JOIN (SELECT {KEYS}, min({seen.replace("p.", "")}) AS since FROM {source} GROUP BY ALL) s
    USING ({KEYS})
  LEFT JOIN (
    SELECT c.transaction_id, list_sort(list(p.cents)) AS al,
      list_sort(list(p.cents) FILTER (WHERE p.us > c.us - {span})) AS ash,
      list({hour_of("p.us", "p.timezone")}) AS hl,
      count(*) FILTER (WHERE p.recipient_id = c.recipient_id) AS known
    FROM {source} c JOIN {source} p ON p.customer_id = c.customer_id AND p.currency = c.currency
      AND p.us < c.us AND p.us > c.us - {180 * DAY} AND {seen} <= c.us
    GROUP BY 1) w USING (transaction_id)),"""


BASELINE = (
    ADMITTED
    + f""", {held("admitted", "p.admitted_us")}
b1 AS (
  SELECT *, NOT coalesce(since < us OR (since = us AND own_seen IS DISTINCT FROM us), false) AS pm,
    coalesce(len(al), 0) AS nl, coalesce(len(ash), 0) AS ns FROM b0),
b2 AS (
  SELECT *, CASE WHEN nl > 0 THEN al[(nl + 1) // 2] + al[nl // 2 + 1] END AS med2,
    CASE WHEN ns > 0 THEN ash[(ns + 1) // 2] + ash[ns // 2 + 1] END AS smed2,
    CASE WHEN nl > 0 THEN al[(95 * nl + 99) // 100] END AS p95,
    CASE WHEN nl > 0 THEN list_sum(al) END AS suml,
    {hour_of("us", "timezone")} AS h FROM b1),
b3 AS (
  SELECT *, list_sort(list_transform(al, lambda v: abs(2 * v - med2))) AS dev,
    list_filter(range(24), lambda x: len(list_filter(hl, lambda y: y = x)) >= 2
      AND 10 * len(list_filter(hl, lambda y: y = x)) >= nl) AS typ FROM b2),
b AS (
  SELECT *, CASE WHEN nl > 0 THEN dev[(nl + 1) // 2] + dev[nl // 2 + 1] END AS mad4,
    list_min(list_transform(CASE WHEN nl >= 5 THEN typ END,
      lambda t: least(abs(h - t), 24 - abs(h - t)))) AS dist FROM b3)"""
)

ACTIVITY_COLUMNS = f"""
    count(*) OVER {frame(KEYS, 5 * MINUTE)} AS n5,
    count(*) OVER {frame(KEYS, 10 * MINUTE)} AS n10,
    count(*) OVER {frame(KEYS, HOUR)} AS n60,
    count(*) OVER {frame(KEYS, 180 * DAY)} AS na,
    max(us) OVER {frame(KEYS, 180 * DAY)} AS last_us,
    count(*) OVER {frame(KEYS + ", recipient_id", HOUR)} AS nr60,
    min(us) OVER {frame(KEYS + ", recipient_id", 180 * DAY)} AS first_r,
    count(*) OVER {frame(KEYS + ", device_id", 180 * DAY)} AS ndev"""

LAST_DEVICE = """inst AS (
  SELECT customer_id, currency, us AS last_us,
         CASE WHEN min(device_id) = max(device_id) THEN min(device_id) END AS last_device
  FROM tx GROUP BY 1, 2, 3)"""

BASELINE_FEATURES = """
  cents / 100.0 AS amount,
  CASE WHEN pm THEN 1.0::DOUBLE ELSE 0.0 END AS profile_missing,
  CASE WHEN nl >= 5 THEN 0.0::DOUBLE ELSE 1.0 END AS baseline_insufficient,
  CAST(nl AS DOUBLE) AS long_history_count,
  CAST(ns AS DOUBLE) AS short_history_count,
  CASE WHEN nl >= 5 THEN CAST(2 * cents AS DOUBLE) / CAST(med2 AS DOUBLE) ELSE 0.0 END
    AS amount_vs_customer_median,
  CASE WHEN nl >= 5 THEN CAST(cents AS DOUBLE) * nl / CAST(suml AS DOUBLE) ELSE 0.0 END
    AS amount_vs_customer_mean,
  CASE WHEN nl >= 5 THEN CAST(2 * abs(2 * cents - med2) AS DOUBLE)
    / CAST(greatest(mad4, 4) AS DOUBLE) ELSE 0.0 END AS robust_amount_deviation,
  CASE WHEN nl >= 5 AND mad4 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS mad_zero,
  CASE WHEN nl >= 5 AND mad4 < 4 THEN 1.0::DOUBLE ELSE 0.0 END AS mad_floor_applied,
  CASE WHEN nl >= 5 THEN CAST(cents AS DOUBLE) / CAST(p95 AS DOUBLE) ELSE 0.0 END
    AS amount_vs_p95,
  CASE WHEN nl >= 5 AND ns >= 5 THEN CAST(smed2 AS DOUBLE) / CAST(med2 AS DOUBLE) ELSE 0.0 END
    AS short_term_vs_long_term_amount_ratio,
  CASE WHEN nl >= 5 AND ns >= 5 THEN 0.0::DOUBLE ELSE 1.0 END AS short_baseline_insufficient,
  CASE WHEN nl >= 5 AND known = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS new_recipient"""

HOUR_FEATURES = """
  CASE WHEN coalesce(dist, 0) <> 0 THEN 1.0::DOUBLE ELSE 0.0 END AS unusual_hour,
  CAST(coalesce(dist, 0) AS DOUBLE) AS hour_deviation,
  CASE WHEN dist IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS typical_hours_missing"""

ACTIVITY_FEATURES = """
  CAST(n5 AS DOUBLE) AS transactions_last_5_min,
  CAST(n10 AS DOUBLE) AS transactions_last_10_min,
  CAST(n60 AS DOUBLE) AS transactions_last_hour,
  CAST(nr60 AS DOUBLE) AS recipient_transactions_last_hour,
  CAST(na AS DOUBLE) AS activity_history_count,
  CASE WHEN na = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS activity_history_missing,
  coalesce(CAST(us - first_r AS DOUBLE) / 86400000000.0, 0.0) AS recipient_observed_age_days,
  CASE WHEN first_r IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS recipient_activity_missing,
  CASE WHEN last_device IS NOT NULL AND device_id <> last_device THEN 1.0::DOUBLE ELSE 0.0 END
    AS device_changed,
  CASE WHEN last_device IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS device_change_missing,
  CASE WHEN na > 0 AND ndev = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS device_not_seen_before,
  coalesce(CAST(us - last_us AS DOUBLE) / 86400000000.0, 0.0) AS days_since_last_transfer"""

# One row per transaction with every feature, as WITH items ending in `f`.
FEATURES = (
    BASELINE
    + f""", act AS (SELECT transaction_id, {ACTIVITY_COLUMNS} FROM tx),
{LAST_DEVICE},
f AS (
  SELECT transaction_id, customer_id, currency, us, cents, recipient_id, device_id, med2, nl,
    known, pm, na, {BASELINE_FEATURES}, {HOUR_FEATURES}, {ACTIVITY_FEATURES}
  FROM b JOIN act USING (transaction_id) LEFT JOIN inst USING (customer_id, currency, last_us))"""
)

REVISIONS = (
    ADMITTED
    + """, nobs AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id, currency
    ORDER BY us, CAST(transaction_id AS VARCHAR)) AS admitted_version FROM obs),
rev AS (
  SELECT customer_id, currency, admitted_version AS version,
    us - CASE WHEN recipient_id = 17 THEN 3 * 86400000000 ELSE 0 END AS as_of_us, timezone,
    device_id <> 'view' AS verified,
    CASE WHEN device_id <> 'view' AND recipient_id <> 7
      THEN 'profile-learning-v1-experimental' END AS policy_version,
    CASE WHEN device_id <> 'view' THEN transaction_id END AS decision_id
  FROM nobs WHERE recipient_id <> 13),
dec AS (
  SELECT transaction_id AS decision_id, customer_id, currency, 'ACCEPT' AS action,
    'profile-learning-v1-experimental' AS policy_version, admitted_version AS version_after
  FROM nobs WHERE device_id <> 'view' AND recipient_id <> 11),
head AS (
  SELECT * FROM rev QUALIFY row_number() OVER (PARTITION BY customer_id, currency
    ORDER BY version DESC) = 1)"""
)


def statistics(source: str, name: str = "st") -> str:
    """Exact statistics per key over the rows of ``source``."""
    return f"""{name}0 AS (
  SELECT customer_id, currency, count(*) AS n, sum(cents) AS sum_cents, list_sort(list(cents)) AS a
  FROM {source} GROUP BY 1, 2),
{name}1 AS (SELECT *, a[(n + 1) // 2] + a[n // 2 + 1] AS median2, a[(95 * n + 99) // 100] AS p95
  FROM {name}0),
{name}2 AS (SELECT *, list_sort(list_transform(a, lambda v: abs(2 * v - median2))) AS dv
  FROM {name}1),
{name} AS (SELECT customer_id, currency, n, CAST(sum_cents AS BIGINT) AS sum_cents, median2, p95,
  dv[(n + 1) // 2] + dv[n // 2 + 1] AS mad4 FROM {name}2)"""

REVIEWS = (
    REVIEWED
    + """, ev0 AS (
  SELECT * EXCLUDE (status), transaction_id * 2 AS evaluation_id, us + 60000000 AS created_us
  FROM reviewed
  UNION ALL
  SELECT * EXCLUDE (status), transaction_id * 2 + 1, us + 3600000000 FROM reviewed WHERE device_id = 'error'),
ev1 AS (SELECT *, CASE WHEN device_id <> 'signup' THEN recipient_id / 100.0 END AS score FROM ev0),
ev AS (
  SELECT *, CASE WHEN score IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SCORED' END AS status,
    'rules_only' AS strategy,
    CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.65 THEN 'HIGH'
      WHEN score >= 0.35 THEN 'MEDIUM' WHEN score IS NOT NULL THEN 'LOW' END AS level,
    CASE WHEN score >= 0.85 THEN 'URGENT_REVIEW' WHEN score >= 0.65 THEN 'HOLD_AND_REVIEW'
      WHEN score >= 0.35 THEN 'STEP_UP_VERIFICATION' WHEN score IS NOT NULL THEN 'ALLOW' END
      AS suggested_action,
    CASE WHEN recipient_id >= 10 THEN recipient_id END AS profile_version FROM ev1),
latest AS (
  SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY transaction_id
    ORDER BY created_us DESC, evaluation_id DESC) = 1),
cs AS (
  SELECT evaluation_id AS case_id, transaction_id, evaluation_id AS assessment_id,
    created_us + 60000000 AS created_us, verdict, recipient_id, customer_id, currency,
    'r' || (recipient_id // 10) AS actor
  FROM latest WHERE device_id <> 'view'),
tr AS (
  SELECT case_id, 1 AS sequence, 'OPEN' AS previous, 'UNDER_REVIEW' AS target,
    created_us + 600000000 AS at_us, actor FROM cs WHERE verdict IS NOT NULL
  UNION ALL
  SELECT case_id, 2, CASE WHEN recipient_id = 43 THEN 'OPEN' ELSE 'UNDER_REVIEW' END, verdict,
    created_us + CAST(CASE WHEN recipient_id = 42 THEN -40 ELSE 20 END AS BIGINT) * 60000000, actor
  FROM cs WHERE verdict IN ('LEGITIMATE', 'CONFIRMED_FRAUD')
  UNION ALL
  SELECT case_id, CASE WHEN recipient_id = 41 THEN 4 ELSE 3 END, verdict, 'CLOSED',
    created_us + 1800000000, actor
  FROM cs WHERE verdict IN ('LEGITIMATE', 'CONFIRMED_FRAUD') AND recipient_id < 80),
fb AS (
  SELECT case_id * 10 + sequence AS feedback_id, case_id, sequence, verdict, at_us,
    CASE WHEN recipient_id = 45 THEN 'someone' ELSE actor END AS actor
  FROM (
    SELECT case_id, recipient_id, actor, 1 AS sequence, 'NEEDS_INVESTIGATION' AS verdict,
      created_us + 900000000 AS at_us
    FROM cs WHERE verdict = 'NEEDS_INVESTIGATION'
      OR (verdict IN ('LEGITIMATE', 'CONFIRMED_FRAUD') AND recipient_id >= 50)
    UNION ALL
    SELECT case_id, recipient_id, actor, CASE WHEN recipient_id >= 50 THEN 2 ELSE 1 END, verdict,
      created_us + 1200000000 FROM cs WHERE verdict IN ('LEGITIMATE', 'CONFIRMED_FRAUD')
    UNION ALL
    SELECT case_id, recipient_id, actor, CASE WHEN recipient_id >= 50 THEN 2 ELSE 1 END + 1,
      verdict, created_us + 1500000000
    FROM cs WHERE verdict IN ('LEGITIMATE', 'CONFIRMED_FRAUD') AND recipient_id = 44)),
st AS (
  SELECT cs.*, coalesce(t.target, 'OPEN') AS state FROM cs LEFT JOIN (
    SELECT case_id, arg_max(target, sequence) AS target FROM tr GROUP BY 1) t USING (case_id)),
lastv AS (SELECT case_id, arg_max(verdict, sequence) AS last_verdict, count(*) AS entries
  FROM fb GROUP BY 1)"""
)

OUTBOX = (
    TX
    + """, outbox AS (
  SELECT transaction_id AS event_id, us AS occurred_us, CAST(recipient_id // 15 AS INTEGER) AS attempts,
    CASE WHEN device_id = 'purchase' THEN us + 60000000 END AS published_us FROM tx),
dl AS (
  SELECT transaction_id AS event_id, us + recipient_id * 60000000 AS available_us,
    CASE WHEN device_id = 'click' THEN us + 2 * 86400000000 END AS lease_us,
    CASE WHEN device_id = 'purchase' THEN us + 60000000 END AS completed_us,
    CASE WHEN device_id = 'error' AND recipient_id > 60 THEN us + 120000000 END AS dead_us,
    CASE WHEN device_id = 'error' AND recipient_id > 60 THEN 'attempts_exhausted' END AS last_error
  FROM tx)"""
)
