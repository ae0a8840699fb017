from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import experiment, explain, metrics, models, tree_explain
from riskweave.schemas import FEATURE_NAMES


@pytest.fixture(scope="module")
def data(spark):
    columns = [f"(hash(id, {i}) % 1000) / 100D AS {n}" for i, n in enumerate(FEATURE_NAMES)]
    rows = spark.range(600).selectExpr("id AS transaction_id", *columns)
    label = (F.col("amount") + F.col("hour_deviation") * F.col("amount") > 12).cast("int")
    return rows.withColumn("label", label).cache()


@pytest.fixture(scope="module")
def fitted(data):
    return models.fit_candidates(data, seed=17, trees=6)


def test_candidates_rank_well(data, fitted):
    table = {r.name: r for r in models.validation_table(fitted, data).collect()}
    assert set(table) == {"logistic_regression", "random_forest", "boosted_trees"}
    assert table["boosted_trees"].roc_auc > 0.8
    best = metrics.select_model(models.validation_table(fitted, data)).first()
    assert best.average_precision == max(r.average_precision for r in table.values())


def test_training_needs_both_classes(data):
    with pytest.raises(ValueError):
        models.fit_candidates(data.filter("label = 1"), seed=1, trees=1)


def test_linear_explanation_rebuilds_the_score(data, fitted):
    coefficients, intercept, means = models.linear_form(fitted["logistic_regression"])
    explained = explain.linear_contributions(data, coefficients, intercept, means)
    assert explain.with_consistency(explained).filter("NOT consistent").isEmpty()
    scored = models.score(fitted["logistic_regression"], data)
    assert metrics.score_parity(scored, explained).first().within


def test_tree_explanation_rebuilds_the_score(data, fitted):
    model = fitted["boosted_trees"].stages[-1]
    explained = tree_explain.tree_contributions(data, model, FEATURE_NAMES)
    assert explain.with_consistency(explained).filter("NOT consistent").isEmpty()
    scored = models.score(fitted["boosted_trees"], data)
    assert metrics.score_parity(scored, explained).first().within


def test_tree_contributions_are_shapley_values(data, fitted):
    """Against the definition: every order of revealing the features of one tree."""
    found = tree_explain.leaves(fitted["boosted_trees"].stages[-1])[:8]
    x = np.array([[r[n] for n in FEATURE_NAMES] for r in data.limit(3).collect()])
    used = sorted({c.feature for leaf in found for c in leaf.conditions})

    def value(row, known):
        return sum(
            leaf.value
            * np.prod([
                float(c.low < row[c.feature] <= c.high) if c.feature in known else c.share
                for c in leaf.conditions
            ])
            for leaf in found
        )

    got, _ = tree_explain.contributions_of(found, x)
    for row, parts in zip(x, got, strict=True):
        for feature in used:
            others = [f for f in used if f != feature]
            total = 0.0
            for k in range(len(others) + 1):
                share = factorial(k) * factorial(len(others) - k) / factorial(len(used))
                for known in combinations(others, k):
                    total += share * (value(row, {*known, feature}) - value(row, set(known)))
            assert abs(parts[feature] - total) < 1e-9


def test_experiment_chooses_on_validation_and_measures_on_tests(spark, data):
    from pyspark.sql import functions as F

    third = F.pmod(F.xxhash64("transaction_id"), F.lit(4))
    named = F.when(third == 0, "validation").when(third == 1, "test").when(third < 4, "train")
    rows = data.withColumn("split", F.when(F.col("transaction_id") % 17 == 0, None).otherwise(named))
    found = experiment.experiment(rows, seed=3, trees=4)
    quality = {r["name"]: r.average_precision for r in found.candidates.collect()}
    assert found.chosen in quality and quality[found.chosen] == max(quality.values())
    validation = models.score(found.models[found.chosen], rows.filter("split = 'validation'"))
    f1 = {r.threshold: r.f1 for r in metrics.threshold_grid(validation).collect()}
    assert f1[found.threshold] == max(f1.values())
    assert all(t <= found.threshold for t, f in f1.items() if f == f1[found.threshold])
    (test,) = found.tests.collect()  # no held-out rows here, so no row for them
    scored = models.score(found.models[found.chosen], rows.filter("split = 'test'")).collect()
    hits = [(r.score >= found.threshold, r.label == 1) for r in scored]
    assert (test.split, test.n) == ("test", len(hits))
    assert (test.tp, test.fp) == (hits.count((True, True)), hits.count((True, False)))
    assert (test.fn, test.tn) == (hits.count((False, True)), hits.count((False, False)))


def test_explanations_of_other_evaluations_are_found(spark):
    names = ("a", "b")
    schema = "transaction_id long, a double, b double, score double, model_version string"
    rows = [(i, 1.0, 2.0, 0.5, "m1") for i in range(6)] + [(6, None, 2.0, None, None)]
    explained = spark.createDataFrame(rows, schema)
    stored = [
        (0, [1.0, 2.0], 0.5, "m1"),
        (1, [1.0, 3.0], 0.5, "m1"),
        (2, [1.0, 2.0], 0.5, "m2"),
        (3, [1.0, 2.0], 0.6, "m1"),
        (4, None, None, None),
        (6, [None, 2.0], None, None),
    ]
    evaluated = spark.createDataFrame(
        stored, "transaction_id long, vector array<double>, score double, model_version string"
    )
    found = explain.evaluation_differences(explained, evaluated, names)
    assert {r.transaction_id: r.violations for r in found.collect()} == {
        0: [],
        1: ["vector"],
        2: ["model_version"],
        3: ["score"],
        4: ["vector", "model_version", "score"],
        5: ["not_evaluated"],
        6: [],
    }
