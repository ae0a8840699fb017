import pytest
from pyspark.sql import functions as F

from riskweave.operators import datasets
from riskweave.plans import catalog
from riskweave.sources import driver_tables as d

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("feature", ["amount_vs_customer_median", "hour_deviation"])
def test_a_label_in_a_baseline_feature_is_seen(spark, monkeypatch, feature):
    prepare = datasets.prepare

    def leaking(frame):
        return prepare(frame).withColumn(feature, F.coalesce(feature, F.lit(0)) + F.col("label"))

    monkeypatch.setattr(datasets, "prepare", leaking)
    found = catalog.plans()["q_label_independence"](spark, SF)
    assert found.filter("NOT activity_changed").isEmpty() and not found.isEmpty()


def test_preparation_carries_no_other_columns_along(spark):
    """Passes in Python are given every column of their frame, so others have to be dropped before."""
    rows = d.labeled(spark, SF).withColumn("ballast", F.rand(1))
    plan = datasets.prepare(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "ballast" not in plan and "RECEIVED" not in plan
    assert "ballast" in rows._jdf.queryExecution().optimizedPlan().toString()
