"""Exact additive contributions of boosted trees.

A tree's answer for a row, with some features unknown, averages both branches by how many training
rows took them. Every leaf then is a product of one factor per feature on its path, and the Shapley
value of a product needs only the few subsets of those features. The leaves of a model are small
and fixed; rows are processed in Arrow batches where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import factorial, inf

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame

# The link of Spark's boosted classifier: probability = sigmoid(2 * raw prediction).
LINK = 2.0


@dataclass(frozen=True)
class Condition:
    """A feature's interval on one path (low < x <= high) and its share of the training rows."""

    feature: int
    low: float
    high: float
    share: float


@dataclass(frozen=True)
class Leaf:
    value: float
    conditions: tuple[Condition, ...]


def _descend(node, scale: float, path: dict[int, tuple[float, float, float]]) -> Iterator[Leaf]:
    if node.subtreeDepth() == 0:
        conditions = tuple(Condition(f, *bounds) for f, bounds in sorted(path.items()))
        yield Leaf(node.prediction() * scale, conditions)
        return
    feature, cut = node.split().featureIndex(), node.split().threshold()
    low, high, share = path.get(feature, (-inf, inf, 1.0))
    rows = node.impurityStats().count()
    for child, bounds in (
        (node.leftChild(), (low, min(high, cut))),
        (node.rightChild(), (max(low, cut), high)),
    ):
        part = child.impurityStats().count() / rows
        yield from _descend(child, scale, {**path, feature: (*bounds, share * part)})


def leaves(model: GBTClassificationModel) -> list[Leaf]:
    """All leaves of a fitted model, on the scale of the margin."""
    found: list[Leaf] = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        found += _descend(tree._java_obj.rootNode(), weight * LINK, {})
    return found


def _leaf_contributions(leaf: Leaf, x: np.ndarray, out: np.ndarray) -> None:
    parts = leaf.conditions
    size = len(parts)
    inside = [((x[:, c.feature] > c.low) & (x[:, c.feature] <= c.high)).astype(float) for c in parts]
    for i, own in enumerate(parts):
        others = [j for j in range(size) if j != i]
        weight = np.zeros(len(x))
        for k in range(size):
            share = factorial(k) * factorial(size - k - 1) / factorial(size)
            for known in combinations(others, k):
                term = np.full(len(x), share)
                for j in others:
                    term *= inside[j] if j in known else parts[j].share
                weight += term
        out[:, own.feature] += leaf.value * (inside[i] - own.share) * weight


def contributions_of(found: Sequence[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(contributions per row and feature, base value)."""
    out = np.zeros_like(x)
    for leaf in found:
        _leaf_contributions(leaf, x, out)
    base = sum(leaf.value * float(np.prod([c.share for c in leaf.conditions])) for leaf in found)
    return out, base


def margins_of(found: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for leaf in found:
        hit = np.ones(len(x), dtype=bool)
        for c in leaf.conditions:
            hit &= (x[:, c.feature] > c.low) & (x[:, c.feature] <= c.high)
        total += leaf.value * hit
    return total


def tree_contributions(
    rows: DataFrame, model: GBTClassificationModel, names: Sequence[str]
) -> DataFrame:
    """Adds ``contributions``, ``base_value``, ``raw_margin`` and ``score`` to every row."""
    found, names = leaves(model), list(names)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            x = np.column_stack(columns).astype(float)
            parts, base = contributions_of(found, x)
            margin = margins_of(found, x)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            added = {
                "contributions": pa.ListArray.from_arrays(offsets, parts.ravel()),
                "base_value": pa.array(np.full(len(x), base)),
                "raw_margin": pa.array(margin),
                "score": pa.array(1.0 / (1.0 + np.exp(-margin))),
            }
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added.values()], names=[*batch.schema.names, *added]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    schema = f"{fields}, contributions array<double>, base_value double, raw_margin double, score double"
    return rows.mapInArrow(explain, schema)
