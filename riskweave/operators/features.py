"""The 29 behavioural features, computed for a whole table at once.

Input rows carry ``transaction_id, customer_id, currency, us, cents, recipient_id, device_id``.
For the baseline part they also carry ``admitted_us`` (the time the row became part of the
customer's baseline, NULL when it never did) and ``timezone``. Baselines contain admitted rows
only; activity features see every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import amounts
from riskweave.functions.frames import (
    DAY,
    HOUR,
    MINUTE,
    add,
    before,
    fractional_days,
    local_hour,
    prior,
    prior_count,
    prior_sum,
)
from riskweave.operators.history import (
    ACTIVITY_SPAN,
    GROUP,
    HISTORY_LIMIT,
    bounded,
    candidates,
    history_frame,
)
from riskweave.operators.rolling import rolling_statistics
from riskweave.schemas import FEATURE_NAMES, FEATURE_VERSION

MINIMUM_HISTORY = 5
KEYS_OUT = ("customer_id", "currency", "us")


def activity_frame(tx: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    return history_frame(tx, limit)


def with_velocity(frame: DataFrame) -> DataFrame:
    """Prior rows in 5, 10, 60 minutes and 180 days, and the last earlier instant."""
    frame = add(
        frame,
        n_activity=prior_count("is_history", ACTIVITY_SPAN, *GROUP),
        _last=f"max(CASE WHEN is_history THEN us END) {before(*GROUP)}",
    )
    frame = bounded(
        frame,
        n_5m=prior_count("is_history", 5 * MINUTE, *GROUP),
        n_10m=prior_count("is_history", 10 * MINUTE, *GROUP),
        n_60m=prior_count("is_history", HOUR, *GROUP),
    )
    return bounded(
        frame, last_us=f"CASE WHEN _last > us - {ACTIVITY_SPAN} THEN _last END"
    ).drop("_last")


def with_recipient_history(frame: DataFrame) -> DataFrame:
    """Prior rows to the same recipient: count in one hour, earliest instant in 180 days."""
    group = (*GROUP, "recipient_id")
    frame = bounded(
        frame,
        n_recipient_60m=prior_count("is_history", HOUR, *group),
        first_recipient_us=(
            f"min(CASE WHEN is_history THEN us END) {prior(ACTIVITY_SPAN, *group)}"
        ),
    )
    return frame


def with_last_device(frame: DataFrame) -> DataFrame:
    """Device at the last earlier instant, when it is the only one there."""
    instant = f"OVER (PARTITION BY {', '.join(GROUP)}, us)"
    device = "CASE WHEN is_history THEN device_id END"
    frame = add(frame, _low=f"min({device}) {instant}", _high=f"max({device}) {instant}")
    at_last = "named_struct('us', us, 'device', CASE WHEN _low = _high THEN _low END)"
    frame = add(
        frame, _at=f"last(CASE WHEN is_history THEN {at_last} END, true) {before(*GROUP)}"
    )
    return bounded(
        frame, last_device=f"CASE WHEN _at.us > us - {ACTIVITY_SPAN} THEN _at.device END"
    ).drop("_low", "_high", "_at")


def with_device_recency(frame: DataFrame) -> DataFrame:
    """Whether the candidate's device occurs in its activity."""
    latest = f"max(CASE WHEN is_history THEN us END) {before(*GROUP, 'device_id')}"
    frame = add(frame, _same=latest)
    return bounded(frame, device_seen=f"coalesce(_same > us - {ACTIVITY_SPAN}, false)").drop("_same")


def with_device_history(frame: DataFrame) -> DataFrame:
    return with_device_recency(with_last_device(frame))


# Whole-key aggregate: when the first baseline of a key came into being.
PROFILE_SINCE = {"profile_since": "min(admitted_us)"}


def baseline_frame(tx: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    return history_frame(tx, limit, PROFILE_SINCE)


def with_baseline(
    frame: DataFrame, long_days: int = 180, short_days: int = 30, seen: str = "admitted_us"
) -> DataFrame:
    """Exact statistics of the rows that each candidate's baseline held at its own time.

    A row is held from ``seen`` (when it was admitted, or later if it was only known later); a row
    admitted after the candidate does not count, whenever it happened. Window columns are added
    before this: its pass keeps the groups where they are, but Spark cannot know that.
    """
    if not 0 < short_days <= long_days <= 180:
        raise ValueError("windows must satisfy 0 < short <= long <= 180 days")
    exists = f"(profile_since < us OR (profile_since = us AND NOT coalesce({seen} = us, false)))"
    frame = add(
        frame,
        profile_missing=f"NOT coalesce({exists}, false)",
        local_hour=local_hour("us", "timezone"),
        seen_us=seen,
    )
    frame = rolling_statistics(frame, long_days * DAY, short_days * DAY).drop("seen_us")
    held = "CASE WHEN NOT history_limit_exceeded AND NOT profile_missing THEN"
    values = {
        "n_long": "CASE WHEN NOT history_limit_exceeded THEN IF(profile_missing, 0, n_long) END",
        "n_short": "CASE WHEN NOT history_limit_exceeded THEN IF(profile_missing, 0, n_short) END",
        "sum_long": "CASE WHEN NOT history_limit_exceeded THEN sum_long END",
        "hour_counts": "CASE WHEN NOT history_limit_exceeded THEN hour_counts END",
        "n_known_recipient": "CASE WHEN NOT history_limit_exceeded THEN n_known_recipient END",
        **{k: f"{held} {k} END" for k in ("median2_long", "median2_short", "p95_long", "mad4_long")},
    }
    return frame.selectExpr(
        *(f"{values[c]} AS {c}" if c in values else f"`{c}`" for c in frame.columns)
    )


def typical_hours(counts: str, n: str, minimum: int = 2) -> str:
    """Hours seen at least ``minimum`` times and in at least a tenth of ``n`` rows."""
    return (
        f"filter(sequence(0, 23), h -> get({counts}, h) >= {minimum}"
        f" AND get({counts}, h) * 10 >= {n})"
    )


def hour_distance(hour: str, hours: str) -> str:
    """Circular distance to the nearest listed hour; NULL when the list is empty."""
    return f"array_min(transform({hours}, t -> least(abs({hour} - t), 24 - abs({hour} - t))))"


ENOUGH = f"n_long >= {MINIMUM_HISTORY}"
SHORT_ENOUGH = f"({ENOUGH} AND n_short >= {MINIMUM_HISTORY})"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1D ELSE 0D END"


def _when_enough(value: str) -> str:
    return f"CASE WHEN {ENOUGH} THEN {value} ELSE 0D END"


BASELINE_FEATURES = {
    "amount": "CAST(cents AS DOUBLE) / 100D",
    "profile_missing": _flag("profile_missing"),
    "baseline_insufficient": _flag(f"NOT {ENOUGH}"),
    "long_history_count": "CAST(n_long AS DOUBLE)",
    "short_history_count": "CAST(n_short AS DOUBLE)",
    "amount_vs_customer_median": _when_enough(amounts.ratio("cents * 2", "median2_long")),
    "amount_vs_customer_mean": _when_enough(
        f"CAST(cents AS DOUBLE) * n_long / {amounts.nonzero('sum_long')}"
    ),
    "robust_amount_deviation": _when_enough(
        amounts.ratio("abs(cents * 2 - median2_long) * 2", "greatest(mad4_long, 4)")
    ),
    "mad_zero": _flag(f"{ENOUGH} AND mad4_long = 0"),
    "mad_floor_applied": _flag(f"{ENOUGH} AND mad4_long < 4"),
    "amount_vs_p95": _when_enough(amounts.ratio("cents", "p95_long")),
    "short_term_vs_long_term_amount_ratio": (
        f"CASE WHEN {SHORT_ENOUGH} THEN {amounts.ratio('median2_short', 'median2_long')} "
        "ELSE 0D END"
    ),
    "short_baseline_insufficient": _flag(f"NOT {SHORT_ENOUGH}"),
    "new_recipient": _flag(f"{ENOUGH} AND n_known_recipient = 0"),
}

HOUR_FEATURES = {
    "unusual_hour": _flag("hour_gap > 0"),
    "hour_deviation": "CAST(coalesce(hour_gap, 0) AS DOUBLE)",
    "typical_hours_missing": _flag("hour_gap IS NULL"),
}

ACTIVITY_FEATURES = {
    "transactions_last_5_min": "CAST(n_5m AS DOUBLE)",
    "transactions_last_10_min": "CAST(n_10m AS DOUBLE)",
    "transactions_last_hour": "CAST(n_60m AS DOUBLE)",
    "recipient_transactions_last_hour": "CAST(n_recipient_60m AS DOUBLE)",
    "activity_history_count": "CAST(n_activity AS DOUBLE)",
    "activity_history_missing": _flag("n_activity = 0"),
    "recipient_observed_age_days": (
        f"coalesce({fractional_days('us - first_recipient_us')}, 0D)"
    ),
    "recipient_activity_missing": _flag("first_recipient_us IS NULL"),
    "device_changed": _flag("last_device IS NOT NULL AND device_id <> last_device"),
    "device_change_missing": _flag("last_device IS NULL"),
    "device_not_seen_before": _flag("n_activity > 0 AND NOT device_seen"),
    "days_since_last_transfer": f"coalesce({fractional_days('us - last_us')}, 0D)",
}

FEATURES = {**BASELINE_FEATURES, **HOUR_FEATURES, **ACTIVITY_FEATURES}


def with_hour_gap(frame: DataFrame) -> DataFrame:
    hours = typical_hours("hour_counts", "n_long")
    return add(
        frame, hour_gap=f"CASE WHEN {ENOUGH} THEN {hour_distance('local_hour', hours)} END"
    )


def refuse_beyond(limit: int, columns: dict[str, str]) -> list[str]:
    """The contract refuses a candidate whose history passes the limit; its values are NULL."""
    return [
        f"CASE WHEN n_activity <= {limit} THEN {value} END AS {name}"
        for name, value in columns.items()
    ]


def history_flag(limit: int) -> str:
    return f"n_activity > {limit} AS history_limit_exceeded"


def velocity(tx: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Open-ended activity counts per row."""
    frame = candidates(with_velocity(activity_frame(tx, limit)))
    values = {
        "transactions_last_5_min": "n_5m",
        "transactions_last_10_min": "n_10m",
        "transactions_last_hour": "n_60m",
        "activity_history_count": "n_activity",
    }
    return frame.selectExpr(
        "transaction_id", *KEYS_OUT, history_flag(limit), *refuse_beyond(limit, values)
    )


def behavior_v1(
    tx: DataFrame,
    *,
    limit: int = HISTORY_LIMIT,
    long_days: int = 180,
    short_days: int = 30,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """All 29 features in contract order, one row per transaction.

    ``keep`` names more columns to pass through (intermediate statistics included).
    """
    frame = with_last_device(with_velocity(baseline_frame(tx, limit)))
    frame = with_device_recency(with_recipient_history(frame))
    frame = with_baseline(frame, long_days, short_days)
    return vector(candidates(frame), limit, keep)


#: Whole-key aggregates of rows that carry the stored profile of their moment.
STORED_PROFILE = {"profile_since": "min(profile_us)", "zones": "collect_set(timezone)"}


def behavior_stored(tx: DataFrame, *, limit: int = HISTORY_LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 29 features against the profile that was in force at each candidate's time.

    Rows come from :func:`riskweave.operators.profiles.stored_profiles`. Zone and windows are those
    of the candidate's revision: hours of older rows are read in its zone, too.
    """
    frame = with_last_device(with_velocity(history_frame(tx, limit, STORED_PROFILE)))
    frame = with_device_recency(with_recipient_history(frame))
    by_zone = f"map_from_arrays(zones, transform(zones, z -> {local_hour('us', 'z')}))"
    frame = with_baseline(add(frame, zone_hours=by_zone).drop("zones"))
    return vector(candidates(frame), limit, keep)


def vector(
    rows: DataFrame, limit: int = HISTORY_LIMIT, keep: tuple[str, ...] = (), whole: bool = False
) -> DataFrame:
    """The features by name. Of a ``whole`` frame every candidate has them; the limit is only marked."""
    values = {name: FEATURES[name] for name in FEATURE_NAMES}
    columns = [f"{value} AS {name}" for name, value in values.items()] if whole else refuse_beyond(limit, values)
    return with_hour_gap(rows).selectExpr(
        "transaction_id",
        *KEYS_OUT,
        *keep,
        f"'{FEATURE_VERSION}' AS feature_version",
        history_flag(limit),
        *columns,
    )
