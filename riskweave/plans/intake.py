"""Queries over validation and intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import intake, validate
from riskweave.plans import oracle as o
from riskweave.plans.registry import query
from riskweave.session import checkpoint_root
from riskweave.sources import driver_tables as d

ISO = """strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} % 1000000 <> 0
  THEN '.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00'"""
AMOUNT = """CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0')"""


def digest_sql(cents: str) -> str:
    return f"""sha256('submit-transaction:v1' || chr(10) || '{{"amount":"' ||
      {AMOUNT.format(c=cents)} || '","channel":"' || channel || '","currency":"' || currency ||
      '","customer_id":"' || customer_id || '","device_id":"' || device_id ||
      '","recipient_id":"' || recipient_id || '","status":"' || status ||
      '","timestamp":"' || {ISO.format(us="us")} || '","transaction_id":"' || transaction_id ||
      '"}}')"""


@query(
    "q_validate_tx",
    f"""WITH {o.TX} SELECT transaction_id, CASE recipient_id WHEN 4 THEN 'amount' WHEN 6 THEN 'amount'
      WHEN 1 THEN 'currency' WHEN 2 THEN 'currency' WHEN 3 THEN 'device_id' WHEN 7 THEN 'device_id'
      WHEN 9 THEN 'device_id' WHEN 8 THEN 'channel' WHEN 5 THEN 'timestamp' ELSE '' END
      AS violations,
      NOT (recipient_id BETWEEN 1 AND 9) AS valid FROM tx""",
)
def validate_tx(spark, sf):
    checked = validate.validate_transactions(d.raw_transactions(spark, sf))
    return checked.select(
        "transaction_id", F.array_join("violations", ",").alias("violations"), "valid"
    )


@query(
    "q_accepted_tx",
    f"""WITH {o.TX} SELECT transaction_id, cents, us FROM tx
    WHERE NOT (recipient_id BETWEEN 1 AND 9)""",
)
def accepted_tx(spark, sf):
    checked = validate.validate_transactions(d.raw_transactions(spark, sf))
    return validate.accepted(checked).select("transaction_id", "cents", "us")


@query(
    "q_validate_labels",
    f"""WITH {o.LABELED} SELECT transaction_id, concat_ws(',',
      CASE WHEN available_us - {o.MINUTE} < us THEN 'available_before_event' END,
      CASE WHEN label_available_us < available_us - {o.MINUTE} THEN 'label_before_available' END,
      CASE WHEN label NOT IN (0, 1) THEN 'label' END) AS violations FROM labeled""",
)
def validate_labels(spark, sf):
    shifted = d.labeled(spark, sf).withColumn("available_us", F.col("available_us") - o.MINUTE)
    checked = validate.label_violations(shifted)
    return checked.select("transaction_id", F.array_join("violations", ",").alias("violations"))


@query(
    "q_duplicate_tx",
    """SELECT l_orderkey AS transaction_id, count(*) AS n FROM lineitem GROUP BY 1
    HAVING count(*) > 1""",
)
def duplicate_tx(spark, sf):
    rows = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("transaction_id"))
    return validate.duplicates(rows, "transaction_id")


@query(
    "q_context_check",
    f"""WITH {o.REVISIONS} SELECT a.transaction_id, concat_ws(',',
      CASE WHEN a.us + CASE WHEN a.device_id = 'click' THEN -1 ELSE 1 END < a.us
        THEN 'captured_before_event' END,
      CASE WHEN head.as_of_us > a.us THEN 'revision_after_event' END,
      CASE WHEN admitted_version <= head.version THEN 'already_admitted' END) AS violations
    FROM admitted a LEFT JOIN head USING (customer_id, currency)
      LEFT JOIN nobs ON nobs.transaction_id = a.transaction_id""",
)
def context_check(spark, sf):
    from riskweave.operators.profiles import revision

    head = revision(d.revisions(spark, sf)).select(
        "customer_id",
        "currency",
        F.col("version").alias("profile_version"),
        F.col("as_of_us").alias("profile_as_of_us"),
    )
    rows = (
        d.transactions(spark, sf)
        .join(head, ["customer_id", "currency"], "left")
        .withColumn(
            "captured_us", F.col("us") + F.when(F.col("device_id") == "click", -1).otherwise(1)
        )
    )
    checked = validate.context_violations(rows, d.numbered_observations(spark, sf))
    return checked.select("transaction_id", F.array_join("violations", ",").alias("violations"))


# Each row is the activity of the customer's next one; some are tampered with.
CAPTURED = f"""{o.TX}, nx AS (
  SELECT *, lead(transaction_id) OVER (PARTITION BY {o.KEYS} ORDER BY us, CAST(transaction_id AS VARCHAR))
    AS candidate_id FROM tx),
cap AS (
  SELECT candidate_id, CASE WHEN recipient_id % 10 = 1 THEN candidate_id ELSE transaction_id END AS transaction_id,
    CASE WHEN recipient_id % 10 = 3 THEN customer_id + 1 ELSE customer_id END AS customer_id,
    CASE WHEN recipient_id % 10 = 2 THEN 'USD' ELSE currency END AS currency,
    us + CASE WHEN recipient_id % 10 = 4 THEN 60 WHEN recipient_id % 10 = 5 THEN -200 ELSE 0 END * {o.DAY} AS us,
    unnest(range(CASE WHEN recipient_id % 10 = 0 THEN 2 WHEN recipient_id % 10 = 6 THEN 4 ELSE 1 END)) AS copy
  FROM nx WHERE candidate_id IS NOT NULL)"""


@query(
    "q_context_activity_check",
    f"""WITH {CAPTURED} SELECT t.transaction_id, concat_ws(',',
      CASE WHEN count(c.us) > 3 THEN 'activity_limit_exceeded' END,
      CASE WHEN count(c.us) > count(DISTINCT c.transaction_id) THEN 'duplicate_activity' END,
      CASE WHEN bool_or(c.customer_id <> t.customer_id OR c.currency <> t.currency) THEN 'activity_out_of_scope' END,
      CASE WHEN bool_or(c.us >= t.us OR c.us <= t.us - {180 * o.DAY}) THEN 'activity_not_prior' END,
      CASE WHEN bool_or(c.transaction_id = t.transaction_id) THEN 'candidate_in_activity' END) AS violations
    FROM tx t LEFT JOIN cap c ON c.candidate_id = t.transaction_id GROUP BY 1""",
)
def context_activity_check(spark, sf):
    """Scope, order, the candidate itself, repeats, and a limit of three rows."""
    tx = d.transactions(spark, sf)
    checked = validate.activity_violations(tx, d.captured_activity(spark, sf), limit=3)
    return checked.select("transaction_id", F.array_join("violations", ",").alias("violations"))


@query("q_request_digest", f"WITH {o.TX} SELECT transaction_id, {digest_sql('cents')} AS d FROM tx")
def request_digest(spark, sf):
    return d.transactions(spark, sf).select("transaction_id", intake.request_digest().alias("d"))


REQUESTS = f"""{o.TX}, sent AS (
  SELECT * REPLACE (CASE WHEN recipient_id = 3 THEN customer_id + 1000000000 ELSE customer_id END
    AS customer_id) FROM tx),
att AS (
  SELECT *, 1 AS attempt, us AS arrived, 'k' || transaction_id AS key, cents AS c FROM sent
  UNION ALL SELECT *, 2, us + 1000000, 'k' || transaction_id, cents FROM sent
    WHERE device_id = 'click'
  UNION ALL SELECT *, 2, us + 1000000, 'k' || transaction_id, cents + 1 FROM sent
    WHERE device_id = 'view'
  UNION ALL SELECT *, 2, us + 1000000, 'other' || transaction_id, cents FROM sent
    WHERE device_id = 'signup')"""


@query(
    "q_idempotent_intake",
    f"""WITH {REQUESTS} SELECT transaction_id || '-' || attempt AS request_id,
      CASE WHEN recipient_id = 3 THEN 'UNKNOWN_CUSTOMER' WHEN attempt = 1 THEN 'ACCEPT'
        WHEN device_id = 'click' THEN 'REPLAY' WHEN device_id = 'view' THEN 'CONFLICT'
        ELSE 'DUPLICATE_TRANSACTION' END AS outcome, {digest_sql("c")} AS digest FROM att""",
)
def idempotent_intake(spark, sf):
    checkpoint_root(spark)
    result = intake.idempotent_intake(d.requests(spark, sf), d.customers(spark, sf))
    return result.select("request_id", "outcome", "digest")


@query(
    "q_unknown_customer",
    f"WITH {REQUESTS} SELECT transaction_id, customer_id FROM att WHERE recipient_id = 3",
)
def unknown_customer(spark, sf):
    return intake.unknown_customers(d.requests(spark, sf), d.customers(spark, sf)).select(
        "transaction_id", "customer_id"
    )


@query(
    "q_key_format",
    f"WITH {o.TX} SELECT transaction_id FROM tx WHERE device_id IN ('view', 'click')",
)
def key_format(spark, sf):
    separator = F.when(F.col("device_id").isin("view", "click"), " ").otherwise("-")
    rows = d.transactions(spark, sf).select(
        "transaction_id",
        F.concat(F.lit("key"), separator, F.col("transaction_id").cast("string")).alias("key"),
    )
    return intake.bad_keys(rows).select("transaction_id")


@query(
    "q_digest_check",
    f"WITH {o.TX} SELECT transaction_id FROM tx WHERE device_id = 'error'",
)
def digest_check(spark, sf):
    payload = F.concat_ws("|", "transaction_id", "customer_id", "cents")
    rows = d.transactions(spark, sf).select(
        "transaction_id",
        F.when(F.col("device_id") == "error", F.concat(payload, F.lit("!")))
        .otherwise(payload)
        .alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    return validate.digest_mismatch(rows, "payload", "digest").select("transaction_id")


@query(
    "q_history_diff",
    f"""WITH {o.TX} SELECT transaction_id, CASE WHEN device_id = 'view' THEN 'VANISHED'
      ELSE 'CHANGED' END AS change FROM tx WHERE device_id IN ('view', 'click')""",
)
def history_diff(spark, sf):
    old = d.transactions(spark, sf)
    new = old.filter("device_id <> 'view'").withColumn(
        "cents", F.col("cents") + F.when(F.col("device_id") == "click", 1).otherwise(0)
    )
    return validate.history_difference(old, new, "transaction_id")
