import hashlib
import math
import random

import pytest

from riskweave.llm.centroids import cluster


def brute(rows, size, count, rounds):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(256 * x) for x in v]))
    mark = lambda key: hashlib.sha256(f"2:{'' if key is None else key}".encode()).hexdigest()
    centres = [p for _, p in sorted(kept, key=lambda x: (mark(x[0]), x[1]))[:count]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [min((apart(p, c), k) for k, c in enumerate(centres)) for _, p in kept]
        if turn < rounds:
            for k in range(len(centres)):
                own = [p for (_, p), (_, j) in zip(kept, near, strict=True) if j == k]
                if own:
                    centres[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    own = [sum(d for d, j in near if j == k) for k in range(len(centres))]
    rows = [(key, k, d, own[k], sum(own)) for (key, _), (d, k) in zip(kept, near, strict=True)]
    return rows, centres


def vectors(n, size, seed=3):
    r = random.Random(seed)
    rows = [(i, [r.choice([-1, 0.5, 2]) + r.gauss(0, 0.3) for _ in range(size)]) for i in range(n)]
    odd = [None, [], [1.0] * (size - 1), [1.0] * (size + 1), [1.0] * (size - 1) + [None]]
    odd += [[float("nan")] + [0.0] * (size - 1), [0.0] * (size - 1) + [float("-inf")]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    return rows + [rows[3], rows[3], (None, rows[5][1]), (7, [-0.0] * size), (8, [1e-9] * size)]


@pytest.mark.parametrize("n, size, count, rounds", [(200, 6, 7, 5), (9, 3, 40, 2), (50, 64, 5, 1), (30, 4, 3, 0)])
def test_clusters_are_exact(spark, n, size, count, rounds):
    rows = vectors(n, size)
    made = [(k, v, "own", 5) for k, v in rows]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, cluster string, point int").repartition(3)
    found, centres = cluster(df, size=size, centroids=count, rounds=rounds)
    want, final = brute(rows, size, count, rounds)
    assert centres == final
    got = [(r.vec_id, r._cluster, r.distance, r.cluster_inertia, r.inertia) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert found.columns == ["vec_id", "embedding", "cluster", "point", "_cluster", "distance", "cluster_inertia", "inertia"]


def test_no_usable_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    found, centres = cluster(df)
    assert (found.collect(), centres) == ([], [])
    assert cluster(df.limit(0))[0].columns == ["vec_id", "embedding", "cluster", "distance", "cluster_inertia", "inertia"]


def test_large_components(spark):
    """Distances beyond 64 bits to other centroids do not matter, those to the nearest one raise."""
    df = spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found, _ = cluster(df, size=2, centroids=3, rounds=1)
    assert {(r.vec_id, r.distance) for r in found.collect()} == {(1, 0), (2, 0), (3, 0)}
    with pytest.raises(Exception, match="passes 64 bits"):
        cluster(df, size=2, centroids=1, rounds=0)
