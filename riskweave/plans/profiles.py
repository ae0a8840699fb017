"""Queries over baselines and their revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.frames import DAY, KEYS
from riskweave.operators import features, profiles
from riskweave.plans import oracle as o
from riskweave.plans.scoring import LOW_LIMIT, refused
from riskweave.plans.registry import query
from riskweave.sources import driver_tables as d

# The cutoff of the descriptive reads: 2024-01-25T12:00Z.
AS_OF = 1_706_184_000_000_000
IN_LONG = f"us < {AS_OF} AND us > {AS_OF - 180 * DAY}"
IN_WEEK = f"us < {AS_OF} AND us > {AS_OF - 7 * DAY}"
STATS_SQL = f"""WITH {o.ADMITTED}, w AS (SELECT * FROM obs WHERE {IN_LONG}),
{o.statistics("w")} SELECT * FROM st"""


def _long(spark, sf):
    return profiles.in_window(d.observations(spark, sf), AS_OF, 180)


def _narrow(stats):
    return stats.withColumn("sum_cents", F.col("sum_cents").cast("bigint"))


@query("q_profile_stats", STATS_SQL)
def profile_stats(spark, sf):
    return _narrow(profiles.amount_statistics(_long(spark, sf)))


@query("q_profile_stats_long_keys", STATS_SQL)
def profile_stats_long_keys(spark, sf):
    """The path for keys of any size, applied to every key above 20 rows."""
    return _narrow(profiles.amount_statistics(_long(spark, sf), limit=20))


@query(
    "q_hour_histogram",
    f"""WITH {o.ADMITTED}, w AS (SELECT *, {o.hour_of("us", "timezone")} AS h FROM obs
      WHERE {IN_LONG})
    SELECT customer_id, currency, count(*) AS n,
      {", ".join(f"count(*) FILTER (WHERE h = {h}) AS h{h:02d}" for h in range(24))}
    FROM w GROUP BY 1, 2""",
)
def hour_histogram(spark, sf):
    return profiles.hour_histogram(_long(spark, sf))


@query(
    "q_typical_hours",
    f"""WITH {o.ADMITTED}, w AS (SELECT *, {o.hour_of("us", "timezone")} AS h FROM obs
      WHERE {IN_LONG}),
    c AS (SELECT customer_id, currency, h, count(*) AS k FROM w GROUP BY 1, 2, 3),
    t AS (SELECT *, sum(k) OVER (PARTITION BY customer_id, currency) AS n FROM c)
    SELECT customer_id, currency, string_agg(h, ',' ORDER BY h) AS observed_hours,
      coalesce(string_agg(h, ',' ORDER BY h) FILTER (WHERE k >= 2 AND 10 * k >= n), '')
        AS typical_hours
    FROM t GROUP BY 1, 2""",
)
def typical_hours(spark, sf):
    return profiles.hour_view(_long(spark, sf)).select(
        *KEYS,
        F.array_join("observed_hours", ",").alias("observed_hours"),
        F.array_join("typical_hours", ",").alias("typical_hours"),
    )


@query(
    "q_known_recipients",
    f"""WITH {o.ADMITTED} SELECT DISTINCT customer_id, currency, recipient_id FROM obs
    WHERE {IN_LONG}""",
)
def known_recipients(spark, sf):
    return profiles.known_recipients(_long(spark, sf))


@query(
    "q_behavior_window",
    f"""WITH {o.ADMITTED}, w AS (SELECT * FROM obs WHERE {IN_LONG}), {o.statistics("w")}
    SELECT st.*, k.known_recipients, st.n / 180.0::DOUBLE AS per_day, 180 AS days
    FROM st JOIN (SELECT customer_id, currency, count(DISTINCT recipient_id) AS known_recipients
      FROM w GROUP BY 1, 2) k USING (customer_id, currency)""",
)
def behavior_window(spark, sf):
    window = profiles.behavior_window(d.observations(spark, sf), AS_OF, 180)
    return _narrow(window.drop("hour_counts", "typical_hours", "observed_hours"))


@query(
    "q_candidate_baseline",
    f"""WITH {o.BASELINE} SELECT transaction_id, nl::INTEGER AS n_long, ns::INTEGER AS n_short,
      CASE WHEN NOT pm THEN med2 END AS median2_long, CASE WHEN NOT pm THEN mad4 END AS mad4_long,
      CASE WHEN NOT pm THEN p95 END AS p95_long FROM b""",
)
def candidate_baseline(spark, sf):
    frame = features.with_baseline(features.baseline_frame(d.admitted(spark, sf)))
    return features.candidates(frame).select(
        "transaction_id", "n_long", "n_short", "median2_long", "mad4_long", "p95_long"
    )


BASELINE_COLUMNS = ("n_long", "n_short", "median2_long", "mad4_long", "p95_long")


@query(
    "q_candidate_baseline_limited",
    f"""WITH {o.BASELINE}, v AS (
      SELECT transaction_id, count(*) OVER {o.frame(o.KEYS, 180 * o.DAY)} AS na,
        CASE WHEN pm THEN 0 ELSE nl END::INTEGER AS n_long,
        CASE WHEN pm THEN 0 ELSE ns END::INTEGER AS n_short,
        CASE WHEN NOT pm THEN med2 END AS median2_long, CASE WHEN NOT pm THEN mad4 END AS mad4_long,
        CASE WHEN NOT pm THEN p95 END AS p95_long FROM b)
    SELECT {refused(BASELINE_COLUMNS)} FROM v""",
)
def candidate_baseline_limited(spark, sf):
    frame = features.with_baseline(features.baseline_frame(d.admitted(spark, sf), LOW_LIMIT))
    return features.candidates(frame).select(
        "transaction_id", "history_limit_exceeded", *BASELINE_COLUMNS
    )


@query(
    "q_profile_head",
    f"""WITH {o.REVISIONS} SELECT customer_id, currency, version, as_of_us, timezone, verified
    FROM head""",
)
def profile_head(spark, sf):
    return profiles.revision(d.revisions(spark, sf)).select(
        *KEYS, "version", "as_of_us", "timezone", "verified"
    )


@query(
    "q_profile_pinned",
    f"""WITH {o.REVISIONS} SELECT customer_id, currency, version, as_of_us FROM rev
    WHERE version = 5""",
)
def profile_pinned(spark, sf):
    return profiles.revision(d.revisions(spark, sf), 5).select(*KEYS, "version", "as_of_us")


@query(
    "q_profile_hydrate",
    f"""WITH {o.REVISIONS} SELECT customer_id, currency, transaction_id, cents, us,
      admitted_version, version
    FROM nobs JOIN head USING (customer_id, currency)
    WHERE admitted_version <= version AND us <= as_of_us AND us > as_of_us - {180 * DAY}""",
)
def profile_hydrate(spark, sf):
    head = profiles.revision(d.revisions(spark, sf))
    return profiles.hydrate(head, d.numbered_observations(spark, sf)).select(
        *KEYS, "transaction_id", "cents", "us", "admitted_version", "version"
    )


def _view_sql(head: str) -> str:
    return f"""WITH {o.REVISIONS}, hd AS ({head}),
    vis AS (SELECT nobs.* FROM nobs JOIN hd USING (customer_id, currency)
      WHERE admitted_version <= version),
    wl AS (SELECT * FROM vis WHERE {IN_LONG}), ws AS (SELECT * FROM vis WHERE {IN_WEEK}),
    {o.statistics("wl", "l")}, {o.statistics("ws", "s")}
    SELECT cust.customer_id, 'KZT' AS currency, hd.version, hd.as_of_us,
      coalesce(l.n, 0) AS long_n, l.median2 AS long_median2, l.mad4 AS long_mad4, l.p95 AS long_p95,
      l.sum_cents AS long_sum_cents, coalesce(s.n, 0) AS short_n, s.median2 AS short_median2,
      CASE WHEN hd.version IS NULL THEN 'UNINITIALIZED' WHEN l.n IS NULL THEN 'EMPTY'
        WHEN l.n < 5 THEN 'INSUFFICIENT_HISTORY' ELSE 'SUFFICIENT_HISTORY' END AS status,
      coalesce(hd.as_of_us > {AS_OF}, false) AS unavailable
    FROM cust LEFT JOIN hd ON hd.customer_id = cust.customer_id AND hd.currency = 'KZT'
      LEFT JOIN l ON l.customer_id = cust.customer_id AND l.currency = 'KZT'
      LEFT JOIN s ON s.customer_id = cust.customer_id AND s.currency = 'KZT'"""


VIEW = (
    *KEYS,
    "version",
    "as_of_us",
    "long_n",
    "long_median2",
    "long_mad4",
    "long_p95",
    "long_sum_cents",
    "short_n",
    "short_median2",
    "status",
    "unavailable",
)


def _view(spark, sf, version):
    view = profiles.profile_view(
        d.customers(spark, sf).select("customer_id"),
        d.revisions(spark, sf),
        d.numbered_observations(spark, sf),
        AS_OF,
        version=version,
        short_days=7,
    )
    return view.withColumn("long_sum_cents", F.col("long_sum_cents").cast("bigint")).select(*VIEW)


@query("q_profile_view", _view_sql("SELECT * FROM head"))
def profile_view(spark, sf):
    return _view(spark, sf, None)


@query("q_profile_asof", _view_sql("SELECT * FROM rev WHERE version = 20"))
def profile_asof(spark, sf):
    return _view(spark, sf, 20)


@query(
    "q_baseline_status",
    f"SELECT status, count(*) AS n FROM ({_view_sql('SELECT * FROM rev WHERE version = 4')}) "
    "GROUP BY 1",
)
def baseline_status(spark, sf):
    return _view(spark, sf, 4).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _summary_sql(limit: int) -> str:
    return f"""WITH {o.REVISIONS}, w AS (
      SELECT n.customer_id, n.currency, n.admitted_version AS version, n.us AS as_of_us,
        count(*) FILTER (WHERE p.us < n.us) AS prior,
        list(p.cents ORDER BY p.cents) FILTER (WHERE p.admitted_version <= n.admitted_version) AS a
      FROM nobs n JOIN nobs p ON p.customer_id = n.customer_id AND p.currency = n.currency
        AND p.us <= n.us AND p.us > n.us - {180 * DAY} GROUP BY 1, 2, 3, 4)
    SELECT customer_id, currency, version, as_of_us, prior > {limit} AS history_limit_exceeded,
      CASE WHEN prior <= {limit} THEN len(a)::INTEGER END AS n_long,
      CASE WHEN prior <= {limit} THEN a[(len(a) + 1) // 2] + a[len(a) // 2 + 1] END AS median2 FROM w"""


@query("q_revision_summary", _summary_sql(10_000))
def revision_summary(spark, sf):
    return profiles.revision_summary(d.numbered_observations(spark, sf))


@query("q_revision_summary_limited", _summary_sql(20))
def revision_summary_limited(spark, sf):
    """With a limit of 20 rows, so that long keys are cut and revisions refused."""
    return profiles.revision_summary(d.numbered_observations(spark, sf), limit=20)


@query(
    "q_prior_revisions",
    f"""WITH {o.REVISIONS}
    SELECT tx.customer_id, tx.currency, tx.us, tx.transaction_id,
      count(version) AS prior_revisions, max(version) AS latest_version
    FROM tx LEFT JOIN rev ON rev.customer_id = tx.customer_id AND rev.currency = tx.currency
      AND verified AND as_of_us < tx.us
    GROUP BY 1, 2, 3, 4""",
)
def prior_revisions(spark, sf):
    return profiles.prior_revisions(d.transactions(spark, sf), d.revisions(spark, sf))


@query(
    "q_revision_check",
    f"""WITH {o.REVISIONS}, c AS (
      SELECT a.customer_id, a.currency, a.version, concat_ws(',',
        CASE WHEN a.version > 1 AND b.version IS NULL THEN 'version_gap' END,
        CASE WHEN a.as_of_us < b.as_of_us THEN 'time_backwards' END) AS violations
      FROM rev a LEFT JOIN rev b ON a.customer_id = b.customer_id AND a.currency = b.currency
        AND a.version = b.version + 1)
    SELECT * FROM c WHERE violations <> ''""",
)
def revision_check(spark, sf):
    return profiles.revision_violations(d.revisions(spark, sf))


@query(
    "q_profile_provenance",
    f"""WITH {o.REVISIONS} SELECT customer_id, currency, version FROM rev
    WHERE verified <> (policy_version IS NOT NULL AND decision_id IS NOT NULL)""",
)
def provenance(spark, sf):
    return profiles.provenance_violations(d.revisions(spark, sf)).select(*KEYS, "version")


@query(
    "q_unbacked_profiles",
    f"""WITH {o.REVISIONS} SELECT customer_id, currency, version FROM rev WHERE verified
    AND NOT EXISTS (SELECT 1 FROM dec WHERE dec.customer_id = rev.customer_id
      AND dec.currency = rev.currency AND dec.decision_id = rev.decision_id
      AND dec.policy_version = rev.policy_version AND dec.version_after = rev.version)""",
)
def unbacked(spark, sf):
    return profiles.unbacked_revisions(d.revisions(spark, sf), d.decisions(spark, sf)).select(
        *KEYS, "version"
    )


@query(
    "q_dropped_observations",
    f"""WITH {o.REVISIONS} SELECT transaction_id FROM nobs
    WHERE us > {AS_OF - 180 * DAY} AND us < {AS_OF} AND recipient_id % 10 = 3""",
)
def dropped_observations(spark, sf):
    """A later revision that lost some observations."""
    before = d.numbered_observations(spark, sf)
    after = before.filter("recipient_id % 10 <> 3")
    return profiles.dropped_observations(before, after, AS_OF).select("transaction_id")
