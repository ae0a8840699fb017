"""Queries over raw activity: scans, windows, velocity, recipients, devices."""

from __future__ import annotations

from riskweave.operators import features, profiles
from riskweave.plans import oracle as o
from riskweave.plans.registry import query
from riskweave.schemas import FEATURE_NAMES
from riskweave.sources import driver_tables as d


@query(
    "q_tx_scan",
    f"""WITH {o.TX} SELECT transaction_id, customer_id, currency, us, cents, recipient_id,
    device_id, channel, status FROM tx""",
)
def tx_scan(spark, sf):
    return d.transactions(spark, sf)


@query(
    "q_customer_scan",
    f"WITH {o.CUSTOMERS} SELECT customer_id, timezone, segment FROM cust",
)
def customer_scan(spark, sf):
    return d.customers(spark, sf)


@query(
    "q_velocity",
    f"""WITH {o.TX}, a AS (SELECT *, {o.ACTIVITY_COLUMNS} FROM tx)
    SELECT transaction_id, customer_id, currency, us, na > 10000 AS history_limit_exceeded,
      n5 AS transactions_last_5_min, n10 AS transactions_last_10_min,
      n60 AS transactions_last_hour, na AS activity_history_count FROM a""",
)
def velocity(spark, sf):
    return features.velocity(d.transactions(spark, sf))


@query(
    "q_velocity_slow",
    f"""WITH {o.SLOW}, a AS (SELECT *, {o.ACTIVITY_COLUMNS} FROM tx)
    SELECT transaction_id, customer_id, currency, us, na > 10000 AS history_limit_exceeded,
      n5 AS transactions_last_5_min, n10 AS transactions_last_10_min,
      n60 AS transactions_last_hour, na AS activity_history_count FROM a""",
)
def velocity_slow(spark, sf):
    return features.velocity(d.slow_transactions(spark, sf))


@query(
    "q_features_behavior_v1",
    f"""WITH {o.FEATURES}
    SELECT * EXCLUDE (cents, recipient_id, device_id, med2, nl, known, pm, na),
      'behavior-v1' AS feature_version, na > 10000 AS history_limit_exceeded FROM f""",
)
def behavior(spark, sf):
    return features.behavior_v1(d.admitted(spark, sf))


LIMITED = 60


@query(
    "q_history_limit",
    f"""WITH {o.TX}, a AS (SELECT *, {o.ACTIVITY_COLUMNS} FROM tx)
    SELECT transaction_id, na > {LIMITED} AS history_limit_exceeded,
      CASE WHEN na <= {LIMITED} THEN n60 END AS transactions_last_hour,
      CASE WHEN na <= {LIMITED} THEN na END AS activity_history_count FROM a""",
)
def history_limit(spark, sf):
    """A low limit: most keys are long and go through chunks, and refusals occur."""
    rows = features.velocity(d.transactions(spark, sf), LIMITED)
    return rows.select(
        "transaction_id",
        "history_limit_exceeded",
        "transactions_last_hour",
        "activity_history_count",
    )


def _limited(name: str) -> str:
    return f"CASE WHEN na <= {LIMITED} THEN {name} END AS {name}"


@query(
    "q_features_limited",
    f"""WITH {o.FEATURES}
    SELECT transaction_id, na > {LIMITED} AS history_limit_exceeded,
      {", ".join(_limited(name) for name in FEATURE_NAMES)} FROM f""",
)
def features_limited(spark, sf):
    rows = features.behavior_v1(d.admitted(spark, sf), limit=LIMITED)
    return rows.select("transaction_id", "history_limit_exceeded", *FEATURE_NAMES)


# Revisions as stored, the one in force at each transaction's time, and when each observation came
# into force; then the baseline with the zone and the windows of the candidate's revision.
STORED = f"""{o.REVISIONS}, srev AS (
  SELECT * REPLACE (CASE WHEN version >= 12 THEN 'America/New_York' ELSE timezone END AS timezone),
    as_of_us + CASE WHEN version % 7 = 3 THEN 10 ELSE version % 4 END * {o.DAY} + 1 AS created_us,
    CASE WHEN version >= 20 THEN 9 ELSE 180 END AS ld,
    CASE WHEN version >= 20 THEN 4 WHEN version >= 6 THEN 7 ELSE 30 END AS sd FROM rev),
force AS (
  SELECT t.transaction_id, max(r.version) AS version, arg_max(r.timezone, r.version) AS zone,
    arg_max(r.ld, r.version) AS ld, arg_max(r.sd, r.version) AS sd
  FROM tx t JOIN srev r ON r.customer_id = t.customer_id AND r.currency = t.currency
    AND r.created_us <= t.us GROUP BY 1),
came AS (
  SELECT n.transaction_id, min(r.created_us) AS admitted_us
  FROM nobs n JOIN srev r ON r.customer_id = n.customer_id AND r.currency = n.currency
    AND r.version >= n.admitted_version GROUP BY 1),
adm AS (
  SELECT a.* EXCLUDE (admitted_us, timezone), came.admitted_us, force.version,
    coalesce(zone, 'UTC') AS timezone, coalesce(ld, 180) AS ld, coalesce(sd, 30) AS sd, s.since
  FROM admitted a LEFT JOIN came USING (transaction_id) LEFT JOIN force USING (transaction_id)
    LEFT JOIN (SELECT customer_id, currency, min(created_us) AS since FROM srev GROUP BY 1, 2) s
      ON s.customer_id = a.customer_id AND s.currency = a.currency)"""
STORED_BASELINE = f"""b0 AS (
  SELECT c.*, c.admitted_us AS own_seen, w.al, w.ash, w.hl, coalesce(w.known, 0) AS known
  FROM adm c LEFT JOIN (
    SELECT c.transaction_id, list_sort(list(p.cents)) AS al,
      list_sort(list(p.cents) FILTER (WHERE p.us > c.us - c.sd * {o.DAY})) AS ash,
      list({o.hour_of("p.us", "c.timezone")}) AS hl,
      count(*) FILTER (WHERE p.recipient_id = c.recipient_id) AS known
    FROM adm c JOIN adm p ON p.customer_id = c.customer_id AND p.currency = c.currency
      AND p.us < c.us AND p.us > c.us - c.ld * {o.DAY} AND p.admitted_us <= c.us
    GROUP BY 1) w USING (transaction_id)),"""


@query(
    "q_features_from_revisions",
    f"""WITH {o.FEATURES.replace(o.ADMITTED, STORED, 1).replace(
        o.held("admitted", "p.admitted_us"), STORED_BASELINE).replace(
        "known, pm, na,", "known, pm, na, version,")}
    SELECT transaction_id, version, na > 10000 AS history_limit_exceeded, {", ".join(FEATURE_NAMES)} FROM f""",
)
def features_from_revisions(spark, sf):
    """The vector against the profile in force at each transaction's time: decisions made days after
    the rows, missing revisions, changes of zone and of windows."""
    tx = profiles.stored_profiles(
        d.transactions(spark, sf), d.stored_revisions(spark, sf), d.numbered_observations(spark, sf)
    )
    rows = features.behavior_stored(tx, keep=("version",))
    return rows.select("transaction_id", "version", "history_limit_exceeded", *FEATURE_NAMES)
