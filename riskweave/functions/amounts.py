"""Money as integer cents, and exact order statistics of sorted cent arrays.

Medians are kept doubled and deviations quadrupled, so that they stay whole numbers; one
floating-point division happens at the very end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def amount_text(cents: Column) -> Column:
    """Two decimals, as text."""
    return (cents.cast("decimal(20,0)") / F.lit(100)).cast("decimal(20,2)").cast("string")


def median2(ordered: str) -> str:
    """Twice the median of a sorted array column; NULL when it is empty."""
    n = f"size({ordered})"
    return f"(get({ordered}, int(({n} + 1) div 2) - 1) + get({ordered}, int({n} div 2)))"


def mad4(ordered: str, doubled_median: str) -> str:
    """Four times the median absolute deviation."""
    gaps = f"sort_array(transform({ordered}, v -> abs(v * 2 - {doubled_median})))"
    n = f"size({ordered})"
    return (
        f"element_at(transform(array({gaps}), "
        f"g -> get(g, int(({n} + 1) div 2) - 1) + get(g, int({n} div 2))), 1)"
    )


def nearest_rank(n: str, percent: int = 95) -> str:
    return f"(({n} * {percent} + 99) div 100)"


def p95(ordered: str) -> str:
    return f"get({ordered}, int({nearest_rank(f'size({ordered})')}) - 1)"


def nonzero(value: str) -> str:
    """As a floating-point base; NULL when zero, which sums of valid amounts never are."""
    return f"nullif(CAST({value} AS DOUBLE), 0D)"


def ratio(numerator: str, denominator: str) -> str:
    return f"CAST({numerator} AS DOUBLE) / {nonzero(denominator)}"
