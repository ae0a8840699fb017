"""Model candidates on the feature vector, with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.datasets import class_weights
from riskweave.operators.metrics import ranking
from riskweave.schemas import FEATURE_NAMES


def fit_candidates(
    train: DataFrame,
    seed: int,
    features: tuple[str, ...] = FEATURE_NAMES,
    trees: int = 120,
    names: tuple[str, ...] = ("logistic_regression", "random_forest", "boosted_trees"),
) -> dict[str, PipelineModel]:
    """Logistic regression, random forest and boosted trees, fitted on the training rows only."""
    weights = class_weights(train).first()
    if not 0 < weights.positives < weights.n:
        raise ValueError("training needs both classes")
    positive = F.col("label") == 1
    rows = train.withColumns(
        {
            "balanced": F.when(positive, weights.positive_weight).otherwise(
                weights.negative_weight
            ),
            "ratio": F.when(positive, weights.negatives_per_positive).otherwise(1.0),
            "label": F.col("label").cast("double"),
        }
    )
    assembled = VectorAssembler(inputCols=list(features), outputCol="vector")
    scaled = StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True)
    stages = {
        "logistic_regression": [
            assembled,
            scaled,
            # A penalty of one against the summed, balanced loss.
            LogisticRegression(
                featuresCol="scaled",
                weightCol="balanced",
                maxIter=2000,
                regParam=1.0 / weights.n,
                standardization=False,
            ),
        ],
        "random_forest": [
            assembled,
            RandomForestClassifier(
                featuresCol="vector",
                weightCol="balanced",
                numTrees=trees,
                maxDepth=6,
                minInstancesPerNode=5,
                seed=seed,
            ),
        ],
        "boosted_trees": [
            assembled,
            GBTClassifier(
                featuresCol="vector",
                weightCol="ratio",
                maxIter=trees,
                maxDepth=3,
                stepSize=0.05,
                seed=seed,
            ),
        ],
    }
    return {name: Pipeline(stages=stages[name]).fit(rows) for name in names}


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``score``, the probability of the positive class, to every row."""
    scored = model.transform(rows)
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("score"))


def linear_form(model: PipelineModel) -> tuple[list[float], float, list[float]]:
    """(coefficients, intercept, means) of a fitted logistic pipeline, on unscaled features."""
    scaler, linear = model.stages[1], model.stages[2]
    pairs = zip(linear.coefficients.toArray(), scaler.std.toArray(), strict=True)
    coefficients = [float(c / s) if s else 0.0 for c, s in pairs]
    means = [float(m) for m in scaler.mean.toArray()]
    shift = sum(c * m for c, m in zip(coefficients, means, strict=True))
    return coefficients, float(linear.intercept) - shift, means


def validation_table(models: dict[str, PipelineModel], validation: DataFrame) -> DataFrame:
    """One row of ranking metrics per candidate."""
    parts = [
        ranking(score(model, validation)).withColumn("name", F.lit(name))
        for name, model in models.items()
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table
