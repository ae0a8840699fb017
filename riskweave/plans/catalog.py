"""Collects every registered query."""

from __future__ import annotations

from riskweave.plans import (  # noqa: F401
    activity,
    datasets,
    intake,
    learning,
    profiles,
    reviews,
    scoring,
    streams,
)
from riskweave.plans.registry import ORACLES, PLANS, Plan


def plans() -> dict[str, Plan]:
    return dict(PLANS)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
