"""Ranking and threshold metrics of scored, labelled rows, exact under ties."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import checkpoint_root

SLOTS = 1_000


def _over(numerator: Column, denominator: Column) -> Column:
    """A share that is zero when its base is."""
    return F.when(
        denominator != 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """One row of counts and rates, in one aggregation."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be in [0, 1]")
    hit, positive = F.col("score") >= threshold, F.col("label") == 1
    counts = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(positive).alias("positives"),
        F.count_if(~positive & ~hit).alias("tn"),
        F.count_if(~positive & hit).alias("fp"),
        F.count_if(positive & ~hit).alias("fn"),
        F.count_if(positive & hit).alias("tp"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*",
        _over(F.col("positives"), F.col("n")).alias("prevalence"),
        _over(tp, tp + fp).alias("precision"),
        _over(tp, tp + fn).alias("recall"),
        _over(tp * 2, tp * 2 + fp + fn).alias("f1"),
        _over(fp, fp + tn).alias("fpr"),
    )


def cumulative(scored: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Distinct scores with positives and negatives at, and at or above, each score.

    Rows are first counted per distinct score, once. Scores are accumulated inside slots of about
    equal size, whose totals are accumulated first. Slot edges only balance the work: any edges give
    the same result.
    """
    by_score = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    checkpoint_root(scored.sparkSession)
    by_score = by_score.checkpoint()
    steps = [i / slots for i in range(1, slots)]
    edges = sorted(set(by_score.approxQuantile("score", steps, 0.1 / slots)))
    slotted = Bucketizer(
        splits=[-float("inf"), *edges, float("inf")], inputCol="score", outputCol="slot"
    ).transform(by_score)
    above = Window.orderBy(F.col("slot").desc())
    totals = (
        slotted.groupBy("slot")
        .agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
        .select(
            "slot",
            (F.sum("p").over(above) - F.col("p")).alias("p_above"),
            (F.sum("q").over(above) - F.col("q")).alias("q_above"),
        )
    )
    inside = Window.partitionBy("slot").orderBy(F.col("score").desc())
    return slotted.join(F.broadcast(totals), "slot").select(
        "score",
        "pos",
        "neg",
        (F.col("p_above") + F.sum("pos").over(inside)).alias("tp"),
        (F.col("q_above") + F.sum("neg").over(inside)).alias("fp"),
    )


def ranking(scored: DataFrame) -> DataFrame:
    """ROC-AUC by tie-aware ranks and average precision by steps (not by trapezoids)."""
    steps = cumulative(scored)
    wide = F.col("neg").cast("decimal(20,0)") * (F.col("tp") * 2 - F.col("pos")).cast(
        "decimal(18,0)"
    )
    totals = steps.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(wide).alias("_pairs2"),
        F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_steps"),
    )
    positives, negatives = (F.col(c).cast("double") for c in ("positives", "negatives"))
    return totals.select(
        "positives",
        "negatives",
        (F.col("_pairs2").cast("double") / (positives * negatives * 2)).alias("roc_auc"),
        (F.col("_steps") / positives).alias("average_precision"),
    )


def threshold_grid(scored: DataFrame, steps: int = 20) -> DataFrame:
    """Counts and F1 at every grid threshold, from one pass and no join."""
    positive = F.col("label") == 1
    hits = [F.col("score") >= i / steps for i in range(1, steps)]
    counts = scored.agg(
        F.count_if(positive).alias("p"),
        *(F.count_if(positive & h).alias(f"tp{i}") for i, h in enumerate(hits, 1)),
        *(F.count_if(~positive & h).alias(f"fp{i}") for i, h in enumerate(hits, 1)),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(i / steps).alias("threshold"),
                F.col(f"tp{i}").alias("tp"),
                F.col(f"fp{i}").alias("fp"),
                (F.col("p") - F.col(f"tp{i}")).alias("fn"),
            )
            for i in range(1, steps)
        )
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    grid = counts.select(F.inline(rows))
    return grid.withColumn("f1", _over(tp * 2, tp * 2 + fp + fn))


def best_threshold(grid: DataFrame) -> DataFrame:
    """The threshold of the highest F1; a tie goes to the higher threshold."""
    best = grid.agg(F.max(F.struct("f1", "threshold")).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("f1"))


def select_model(candidates: DataFrame) -> DataFrame:
    """The model of the highest validation average precision; a tie goes to the earlier name."""
    return candidates.orderBy(F.col("average_precision").desc(), "name").limit(1)


def score_parity(left: DataFrame, right: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Largest difference of two scorings, and whether it is tolerable."""
    joined = left.select("transaction_id", "score").join(
        right.select("transaction_id", F.col("score").alias("other")), "transaction_id", "full"
    )
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("score").isNull() | F.col("other").isNull()).alias("unmatched"),
        F.max(F.abs(F.col("score") - F.col("other"))).alias("max_abs_difference"),
    ).withColumn(
        "within", (F.col("unmatched") == 0) & (F.col("max_abs_difference") <= tolerance)
    )


def seed_summary(runs: DataFrame, metric: str) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(metric).alias("mean"),
        F.stddev_samp(metric).alias("sample_sd"),
    )


def unusable_scores(scored: DataFrame) -> DataFrame:
    bad = F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0.0, 1.0)
    return scored.filter(bad | ~F.col("label").isin(0, 1))
