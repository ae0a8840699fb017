"""Number formatting and canonical policy digests."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def general6(value: Column) -> Column:
    """Six significant digits without trailing zeros, rounded from the exact binary value.

    The scaled value is itself rounded to a double, which can land on a half that the exact value
    misses. The rounding error of that product (computed from the two halves of the significand)
    then decides; a true half goes to the even digit.
    """
    x = value.cast("double")
    digits = 5 - F.floor(F.log10(F.abs(x)))
    up, down = F.pow(F.lit(10.0), digits), F.pow(F.lit(10.0), -digits)
    scaled = x * up
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * up - scaled) + (x - high) * up
    half = F.abs(scaled - F.floor(scaled)) == 0.5
    whole = (
        F.when(half & (error < 0), F.floor(scaled).cast("double"))
        .when(half & (error > 0), F.ceil(scaled).cast("double"))
        .otherwise(F.rint(scaled))
    )
    rounded = F.when(digits >= 0, whole / up).otherwise(F.rint(x / down) * down)
    text = F.format_string("%.6g", F.coalesce(rounded, x))
    text = F.regexp_replace(text, r"(\.[0-9]*?)0+(e|$)", "$1$2")
    return F.regexp_replace(text, r"\.(e|$)", "$1")


def signed6(value: Column) -> Column:
    return F.concat(F.when(value < 0, "").otherwise("+"), general6(value))


def fingerprint(document: dict[str, Any]) -> str:
    """SHA-256 of compact JSON with sorted keys; stamped on rows as a literal."""
    text = json.dumps(document, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()
