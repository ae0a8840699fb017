"""Named queries: each a Spark plan, most with an SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.session import use_utc

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(use_utc(spark), sf_dir)

        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register
