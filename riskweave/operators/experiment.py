"""One whole experiment: fit the candidates, choose on validation rows, measure on test rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import metrics, models
from riskweave.session import checkpoint_root

TESTS = ("test", "held_out_test")


@dataclass(frozen=True)
class Experiment:
    """``candidates`` has a row of validation metrics for each model; ``tests`` a row for each test
    split: the confusion of the chosen model at the chosen threshold, and its ranking metrics."""

    models: dict[str, PipelineModel]
    chosen: str
    threshold: float
    candidates: DataFrame
    tests: DataFrame | None


def experiment(rows: DataFrame, seed: int = 17, trees: int = 120) -> Experiment:
    """Runs on prepared rows with ``split`` and ``label``; rows of no split take no part.

    The model of the highest average precision on validation rows is chosen, then the threshold of
    the highest F1 on the same rows; test rows are scored by that model only, and nothing is chosen
    by them. The rows are computed once for all passes. A test split without both classes has no
    ranking metrics; one without rows has no row
    (``tests`` is None without any).
    """
    checkpoint_root(rows.sparkSession)
    rows = rows.filter("split IS NOT NULL").checkpoint()
    validation = rows.filter("split = 'validation'")
    fitted = models.fit_candidates(rows.filter("split = 'train'"), seed=seed, trees=trees)
    candidates = models.validation_table(fitted, validation).checkpoint()
    best = metrics.select_model(candidates.filter("NOT isnan(average_precision)")).first()
    if best is None:
        raise ValueError("validation needs a positive row")
    scored = models.score(fitted[best["name"]], validation)
    threshold = metrics.best_threshold(metrics.threshold_grid(scored)).first()["threshold"]
    held = models.score(fitted[best["name"]], rows.filter(F.col("split").isin(*TESTS)))
    held = held.select("split", "label", "score").checkpoint()
    parts = []
    for split in sorted(r["split"] for r in held.select("split").distinct().collect()):
        own = held.filter(F.col("split") == split)
        counted = metrics.confusion(own, threshold).withColumn("split", F.lit(split))
        ranked = metrics.ranking(own).select(
            F.lit(split).alias("split"),
            *(
                F.when(F.col("positives").cast("double") * F.col("negatives") > 0, F.col(m)).alias(m)
                for m in ("roc_auc", "average_precision")
            ),
        )
        parts.append(counted.join(ranked, "split"))
    tests = reduce(DataFrame.unionByName, parts) if parts else None
    return Experiment(fitted, best["name"], float(threshold), candidates, tests)
