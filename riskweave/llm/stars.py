"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import freeze

#: A task writes files for each exchange, however few its edges are, so there is one for so many.
TASK_EDGES = 2_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Ties each larger neighbour of a node to the least of the node and its neighbours."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return near.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the least of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    ties = edges.join(least, "b").where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    return ties.union(least.select("m", "b")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``uid`` and ``class_uid``, the least node of its component, for nodes other than that.

    Edges are pairs ``a``, ``b``. Ends when a round changes nothing, after about as many rounds as
    the logarithm of the longest chain.
    """
    now = freeze(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    mark = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    seen = now.agg(*mark).first()
    while True:
        tasks = 1 + seen["n"] // TASK_EDGES
        large = _large(now.coalesce(tasks)).coalesce(tasks)
        now = freeze(_small(large).coalesce(tasks))
        new = now.agg(*mark).first()
        if new == seen:
            return now.select(F.col("b").alias("uid"), F.col("a").alias("class_uid"))
        seen = new
