"""Nearest neighbours by inner product over robustly pruned directed graphs, one for each shard.

Equal vectors are one node that holds its smallest ids. A shard's graph is grown in batches: each
batch is searched for in the graph so far, and of what a search has met the edges are kept that no
nearer kept one makes needless (with some slack, so that long edges stay). A shard holds vectors whose
norms are alike (within a factor of 1.42), and its graph is one of directions, so that edges stay
short whatever the norms are; searches go by the inner products themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.llm.common import freeze

DEGREE, BEAM, SLACK = 32, 96, 1.2
#: Nodes that a search of a finished graph holds open, and bands of norms to a factor of two.
WIDE, BANDS = 192, 2
SHARD_VECTORS = 8192
QUERY_BLOCK = 512
BATCH = 512


# --- one graph ---------------------------------------------------------------------------------


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """The best ``beam`` nodes that greedy search meets for each query, best first; -1 for none."""
    q, n = len(queries), len(x)
    rows = np.arange(q)
    pool = np.full((q, beam), -1, np.int64)
    pool[:, 0] = entry
    score = np.full((q, beam), -np.inf, np.float32)
    score[:, 0] = queries @ x[entry]
    done = np.ones((q, beam), bool)
    done[:, 0] = False
    met = np.zeros((q, n + 1), bool)  # the last column stands for no edge
    met[:, entry] = met[:, n] = True
    active = rows
    while len(active):
        at = np.argmin(done[active], 1)  # pools are sorted: the first one open is the best
        here = pool[active, at]
        done[active, at] = True
        near = graph[here]
        near = np.where(near < 0, n, near)
        fresh = ~met[active[:, None], near]
        met[active[:, None], near] = True
        value = np.einsum("qrd,qd->qr", x[np.minimum(near, n - 1)], queries[active])
        value[~fresh] = -np.inf
        both = np.concatenate([score[active], value], 1)
        order = np.argsort(-both, 1, kind="stable")[:, :beam]
        pick = lambda a, b: np.take_along_axis(np.concatenate([a, b], 1), order, 1)
        score[active] = pick(score[active], value)
        pool[active] = pick(pool[active], np.where(fresh, near, -1))
        done[active] = pick(done[active], ~fresh)
        active = active[~done[active].all(1)]
    return pool


def prune(x: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Edges of each node ``own`` among its candidates ``near`` (-1 for none)."""
    out = np.full((len(own), degree), -1, np.int64)
    rest = (near >= 0) & (near != own[:, None])
    safe = np.maximum(near, 0)
    vectors = x[safe]
    away = ((vectors - x[own][:, None]) ** 2).sum(2)
    rows = np.arange(len(own))
    for k in range(degree):
        left = np.where(rest, away, np.inf)
        best = left.argmin(1)
        some = rest[rows, best]
        if not some.any():
            break
        out[some, k] = safe[rows, best][some]
        between = ((vectors - vectors[rows, best][:, None]) ** 2).sum(2)
        rest &= slack * slack * between > away
        rest[rows, best] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, slack: float = SLACK) -> tuple[np.ndarray, int]:
    """The graph of a shard (rows of node numbers, -1 for none) and the node where searches begin."""
    n = len(x)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    graph = np.full((n, degree), -1, np.int64)
    at = 1
    while at < n:
        new = order[at : at + min(BATCH, at)]
        near = beam_search(x, graph, entry, x[new], beam)
        if at < degree:  # the first nodes may all know each other
            near = np.concatenate([near, np.broadcast_to(new, (len(new), len(new)))], 1)
        graph[new] = prune(x, new, near, degree, slack)
        source = np.repeat(new, degree)
        target = graph[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        ends, first, count = np.unique(target, return_index=True, return_counts=True)
        width = int(count.max(initial=0))
        added = np.full((len(ends), width), -1, np.int64)
        added[np.repeat(np.arange(len(ends)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for lo in range(0, len(ends), BATCH):
            own = ends[lo : lo + BATCH]
            graph[own] = prune(x, own, np.concatenate([graph[own], added[lo : lo + BATCH]], 1), degree, slack)
        at += len(new)
    return graph, entry


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at norm 1, and at norms of at most 1 that keep their proportions; none overflows."""
    most = np.abs(vectors).max(1, keepdims=True, initial=0)
    unit = vectors / most
    norm = np.sqrt((unit**2).sum(1, keepdims=True))
    unit /= norm
    size = most / most.max(initial=0) * norm
    return unit.astype(np.float32), (unit * (size / size.max(initial=0))).astype(np.float32)


# --- shards and queries ------------------------------------------------------------------------

INDEX = "shard int, entry int, ids array<array<long>>, vectors binary, graph binary"


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that may take part: with an id, every component there
    and finite, and one of them not zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.coalesce(fine & F.exists("v", lambda x: x != 0), F.lit(False))
    )


def common_length(held: DataFrame) -> int:
    """The length that most vectors have (the least of several)."""
    most = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return most["n"] if most else 0


def band(v: Column) -> Column:
    """The band of a vector's norm; a double's range has at most some 4,300."""
    most = F.array_max(F.transform(v, F.abs))
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / most) * (x / most))
    return F.floor(BANDS * (F.log2(most) + F.log2(square) / 2)).cast("int")


def index(held: DataFrame, keep: int, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """A row for each shard: its distinct vectors, the ``keep`` smallest ids of each, the graph.

    Shards are numbered from 0 without gaps, but for those that the hash leaves empty.
    """
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = held.distinct().withColumn("nth", nth).where(F.col("nth") <= keep)
    nodes = nodes.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = freeze(nodes.withColumn("band", band(F.col("v"))))
    sizes = sorted((r["band"], math.ceil(r["count"] / shard_vectors)) for r in nodes.groupBy("band").count().collect())
    begin = accumulate((n for _, n in sizes), initial=0)
    places = [(b, n, at) for (b, n), at in zip(sizes, begin, strict=False)]
    parts = held.sparkSession.createDataFrame(places, "band int, parts int, base int")
    part = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
    dealt = nodes.join(F.broadcast(parts), "band").select("v", "ids", (F.col("base") + part).alias("shard"))

    def grow(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        v = rows.column("v").combine_chunks()
        vectors = v.values.to_numpy(zero_copy_only=False).reshape(len(v), -1)
        order = np.lexsort(vectors.T[::-1])  # the same graph, whatever order the rows came in
        vectors = vectors[order]
        graph, entry = build(directions(vectors)[0])
        return pa.table(
            {
                "shard": rows.column("shard").slice(0, 1),
                "entry": pa.array([entry], pa.int32()),
                "ids": pa.array([rows.column("ids").take(pa.array(order)).to_pylist()], pa.list_(pa.list_(pa.int64()))),
                "vectors": pa.array([vectors.tobytes()], pa.binary()),
                "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()),
            }
        )

    return dealt.groupBy("shard").applyInArrow(grow, INDEX)


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest of ``rows`` found for each query (rows of the same columns), by inner product.

    Returns ``query_id``, ``rank``, ``vec_id``, ``score``. A query is not its own neighbour (by id).
    Rows and queries that are null, zero, not finite, without an id or of another length than most of
    the rows take no part. Ties go to the smaller id; a row that is there twice counts once. Empty tables give none.
    """
    held = usable(rows, key, vector)
    length = common_length(held)
    held = freeze(held.where(F.size("v") == length))
    asked = freeze(usable(queries, key, vector).where(F.size("v") == length).distinct())
    shards = freeze(index(held, k + 1))
    if shards.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    packed = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("part")).agg(
        F.collect_list(F.struct("id", "v")).alias("asked")
    )
    last = shards.agg(F.max("shard")).first()[0]
    everywhere = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names = ("asked", "entry", "ids", "vectors", "graph")
                asked, entry, ids, vectors, graph = (batch.column(c)[i] for c in names)
                q = asked.values.field("id").to_numpy()
                qv = asked.values.field("v").flatten().to_numpy().reshape(len(q), -1)
                x = np.frombuffer(vectors.as_buffer(), np.float64).reshape(-1, qv.shape[1])
                edges = np.frombuffer(graph.as_buffer(), np.int32).reshape(len(x), -1).astype(np.int64)
                if len(x) <= WIDE:
                    found = np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
                else:
                    found = beam_search(directions(x)[1], edges, entry.as_py(), directions(qv)[0], WIDE)
                yield _best(q, qv, x, found, ids.values, k)

    met = everywhere.join(shards, "shard").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best(q: np.ndarray, qv: np.ndarray, x: np.ndarray, found: np.ndarray, ids: pa.Array, k: int) -> pa.RecordBatch:
    """The ``k`` best ids of each query among the nodes found, with their products in doubles."""
    width = np.diff(ids.offsets.to_numpy())
    flat, begin = ids.flatten().to_numpy(), ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()
    row, col = np.nonzero(found >= 0)
    node = found[row, col]
    score = np.einsum("nd,nd->n", qv[row], x[node])
    many = width[node]
    shift = np.cumsum(many) - many
    vec = flat[np.repeat(begin[node] - shift, many) + np.arange(int(many.sum()))]
    row, score = np.repeat(row, many), np.repeat(score, many)
    other = vec != q[row]
    row, score, vec = row[other], score[other], vec[other]
    order = np.lexsort((vec, -score, row))
    row, score, vec = row[order], score[order], vec[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    return pa.RecordBatch.from_arrays(
        [pa.array(q[row[keep]]), pa.array(vec[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"]
    )
