"""Time frames over microsecond columns, and counts that stay linear in the rows.

All frames are open at both ends: a row at the candidate's own instant, or exactly one span
earlier, is outside. Frames are SQL text: one expression, one call into the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

KEYS = ("customer_id", "currency")


def _over(keys: tuple[str, ...], low: str, high: str) -> str:
    return f"OVER (PARTITION BY {', '.join(keys)} ORDER BY us RANGE BETWEEN {low} AND {high})"


def prior(span: int, *keys: str) -> str:
    """Rows with ``us - span < row.us < us``."""
    return _over(keys, f"{span - 1} PRECEDING", "1 PRECEDING")


def before(*keys: str) -> str:
    """Every row of an earlier instant."""
    return _over(keys, "UNBOUNDED PRECEDING", "1 PRECEDING")


def expired(span: int, *keys: str) -> str:
    """Rows at or before ``us - span``: those that already left the span."""
    return _over(keys, "UNBOUNDED PRECEDING", f"{span} PRECEDING")


def prior_count(condition: str, span: int, *keys: str) -> str:
    """Count inside the open span.

    The difference of two frames that only grow: Spark updates both incrementally, so the work is
    linear in the rows, where a sliding frame is rescanned for every row.
    """
    counted = f"count_if({condition})"
    return f"({counted} {before(*keys)} - {counted} {expired(span, *keys)})"


def prior_sum(value: str, span: int, *keys: str) -> str:
    """Exact sum of integer values inside the open span; wide enough for 10^18 cents per row."""
    total = f"sum(CAST({value} AS DECIMAL(18, 0)))"
    return (
        f"(coalesce({total} {before(*keys)}, CAST(0 AS DECIMAL(28, 0)))"
        f" - coalesce({total} {expired(span, *keys)}, CAST(0 AS DECIMAL(28, 0))))"
    )


def add(frame: DataFrame, **columns: str) -> DataFrame:
    """Adds SQL expressions as columns."""
    return frame.selectExpr("*", *(f"{text} AS {name}" for name, text in columns.items()))


def micros(timestamp: Column) -> Column:
    """UTC microseconds of a TIMESTAMP, or of a TIMESTAMP_NTZ that holds UTC wall time."""
    return F.unix_micros(timestamp.cast("timestamp"))


def local_hour(us: str, timezone: str) -> str:
    return f"hour(from_utc_timestamp(timestamp_micros({us}), {timezone}))"


def fractional_days(us: str) -> str:
    return f"(CAST({us} AS DOUBLE) / {float(DAY)}D)"
