"""Exact integer k-means in expressions of the JVM.

Vectors become whole numbers, centroids are literal arrays in the plan, and a distance is
``aggregate`` over ``zip_with``; ``array_min`` of structs (distance, number) chooses the cluster.
A round is one grouped sum a component, which combines before the shuffle. What reaches the driver
is one row a centroid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import free_name, once, stored

SIZE, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has exactly so many components, none null or non-finite."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return (F.size(vector) == size) & F.forall(vector.cast("array<double>"), real)


def whole(vector: Column, scale: int) -> Column:
    def component(x: Column) -> Column:
        far = F.raise_error(F.lit("a component passes 62 bits"))
        return F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale).cast("long")).otherwise(far.cast("long"))

    return F.transform(vector.cast("array<double>"), component)


def by_cluster(cluster: Column, values: list, kind: str) -> Column:
    """A literal for each cluster (at most as many as there are centroids)."""
    return F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), cluster + 1)


def room(size: int) -> int:
    """Components up to this bound keep sums of their products below 2**60."""
    return math.isqrt(2**60 // size)


def square_norm(point: Column, most: int) -> Column:
    """The sum of squares; null where a component passes the bound."""
    near = F.forall(point, lambda x: F.abs(x) <= most)
    squares = F.transform(point, lambda x: x * x)
    return F.when(near, F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x))


def nearest(point: Column, norm: Column, centres: list[list[int]], most: int) -> Column:
    """The least (distance, cluster) of a point; distances that pass 64 bits come last.

    With both norms known, a distance is norm + norm - 2 * product; else it is summed square by
    square, each step checked.
    """
    # Written as text: one call, not one for each of the literals.
    rows = []
    for k, c in enumerate(centres):
        own = f"{sum(x * x for x in c)}L" if max(map(abs, c), default=0) <= most else "CAST(NULL AS BIGINT)"
        rows.append(f"named_struct('at', array({', '.join(f'{x}L' for x in c)}), 'norm', {own}, 'cluster', {k})")
    table = F.expr(f"array({', '.join(rows)})")
    zero = F.lit(0).cast("long")

    def checked(a: Column, b: Column) -> Column:
        gap = F.try_subtract(a, b)
        return F.try_multiply(gap, gap)

    def measured(centre: Column) -> Column:
        product = F.aggregate(F.zip_with(point, centre["at"], lambda a, b: a * b), zero, lambda total, x: total + x)
        squares = F.aggregate(F.zip_with(point, centre["at"], checked), zero, lambda total, x: F.try_add(total, x))
        known = norm.isNotNull() & centre["norm"].isNotNull()
        distance = F.when(known, norm + centre["norm"] - product - product).otherwise(squares)
        return F.struct(distance.alias("distance"), centre["cluster"].alias("cluster"))

    def placed(found: Column) -> Column:
        return F.struct(found["distance"].isNull().alias("far"), found["distance"], found["cluster"])

    return F.array_min(F.transform(F.transform(table, measured), placed))


def cluster(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    size: int = SIZE,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: str = "2:",
) -> tuple[DataFrame, list[list[int]]]:
    """Each usable vector's cluster, and the final centroids in order.

    Components are ``floor(scale * x)``. The first centroids are the vectors with the least
    lowercase-hex SHA-256 of ``seed`` and the key (a null key counts as no text; ties by the
    vector). Each of ``rounds`` rounds assigns every vector to the nearest centroid (squared
    Euclidean distance, ties to the smaller number) and moves every non-empty centroid to the
    componentwise ``floor(sum / count)``; sums are exact at any count.

    The rows have the columns of ``rows`` and ``cluster``, ``distance``, ``cluster_inertia`` and
    ``inertia`` (underscores before a name that is taken). Vectors that are null, of another size or
    hold a null or non-finite component are left out. With fewer vectors than centroids each vector
    is one (repeated rows too, so that the later of equal centroids stays empty). A distance that
    passes 64 bits raises an error, as it has no result. An empty table gives an empty table.
    """
    names = rows.columns
    point, norm, order, near = (free_name(n, names) for n in ("point", "norm", "order", "near"))
    most = room(size)
    kept = rows.where(usable(F.col(vector), size)).select(*names, once(point, whole(F.col(vector), scale)))
    kept = stored(kept.withColumn(norm, square_norm(F.col(point), most)), "vectors")

    mark = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    first = kept.select(mark.alias(order), point).orderBy(order, point).limit(centroids)
    centres = [list(r[point]) for r in first.collect()]  # one row a centroid
    total = [F.sum(F.col(point)[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(size)]
    for _ in range(rounds if centres else 0):
        best = nearest(F.col(point), F.col(norm), centres, most)
        assigned = kept.select(point, best["cluster"].alias("_cluster"))
        for r in assigned.groupBy("_cluster").agg(F.count("*").alias("n"), *total).collect():  # as many rows
            centres[r["_cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]

    cluster_, distance_, own_, all_ = (free_name(n, names) for n in ("cluster", "distance", "cluster_inertia", "inertia"))
    if not centres:
        kinds = zip((cluster_, distance_, own_, all_), ("int", "long", "long", "long"), strict=True)
        return kept.drop(point, norm).select("*", *[F.lit(None).cast(k).alias(n) for n, k in kinds]), centres
    chosen = kept.select(*names, once(near, nearest(F.col(point), F.col(norm), centres, most)))
    far = F.raise_error(F.lit("a squared distance passes 64 bits")).cast("long")
    distance = F.when(F.col(near)["far"], far).otherwise(F.col(near)["distance"])
    final = stored(chosen.select(*names, F.col(near)["cluster"].alias(cluster_), distance.alias(distance_)), "clusters")
    sums = {r[0]: r[1] for r in final.groupBy(cluster_).agg(F.sum(distance_)).collect()}  # one row a centroid
    inertias = [sums.get(k, 0) for k in range(len(centres))]
    result = final.withColumn(own_, by_cluster(F.col(cluster_), inertias, "long"))
    return result.withColumn(all_, F.lit(sum(inertias)).cast("long")), centres
