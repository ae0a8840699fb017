"""Near-duplicate classes by BagMinHash signatures of weighted word shingles.

Each shingle of a document, weighted by how often it occurs, owns Poisson processes over the
discretised weight intervals (0, 1], (1, 2], (2, 4], ...: points in time order, each with a slot and
a place inside its interval. A point counts if its place is within the shingle's weight, so equal
shingles of two documents share exactly the points up to the smaller weight. The first point of
each slot is the signature; two slots agree with the probability of the weighted Jaccard
similarity. Points are made only up to the time at which all slots have one.

Signatures are cut into bands. Texts that share a band are compared exactly, by the overlap of
their shingle multisets: first with one text of the band. Where texts that hang together by bands
are still in several classes, they are dealt to blocks by class and length and compared block
against block inside the tasks, but for blocks of one class, or of lengths that cannot be similar.
So no group is expanded into rows of pairs, and no link between texts of different classes is
skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import freeze, spread_join
from riskweave.llm.pieces import (
    ROW_BITS,
    Distinct,
    Piece,
    Windows,
    Words,
    cut,
    digests,
    each_piece,
    mix,
    other_fields,
    with_marks,
)
from riskweave.llm.stars import components

SHINGLE = 5
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
#: About so many shingles and texts at most are a block that is compared with another at once.
BLOCK_ITEMS, BLOCK_DOCS = 1 << 15, 1 << 10
#: An occurrence that more pairs of two blocks share is counted by a matrix product.
MANY_PAIRS = 1 << 10
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# --- signatures --------------------------------------------------------------------------------


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit words."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Bags:
    """The shingle multisets of the documents of a piece.

    A text of fewer words than a shingle has all its words as its one shingle.
    """

    def __init__(self, piece: Piece, shingle: int = SHINGLE):
        words = Words(piece.body, piece.ends)
        self.n_docs, self.words = len(piece.ends), words
        first = words.bounds - words.counts
        windows = Windows(words.hashes)
        doc = np.repeat(np.arange(self.n_docs), words.counts)
        at = np.flatnonzero(words.left() >= shingle)
        owners, hashes = [doc[at]], [windows.at(at, shingle)]
        for size in range(1, shingle):
            short = np.flatnonzero(words.counts == size)
            owners.append(short)
            hashes.append(windows.at(first[short], size))
        rows = Distinct(np.concatenate(owners).astype(np.uint64), np.concatenate(hashes))
        self.doc, self.hash = rows.lanes[0].astype(np.int64), rows.lanes[1]
        self.weight = np.bincount(rows.back, minlength=len(self.doc))
        named = np.ascontiguousarray(words.ids.T).tobytes()  # sixteen bytes a word
        self.text = list(digests(named, 16 * first, 16 * words.bounds))

    def bag(self, doc: int) -> np.ndarray:
        """One number for each occurrence of each shingle, sorted: overlap is plain set overlap."""
        lo, hi = np.searchsorted(self.doc, [doc, doc + 1])
        weight = self.weight[lo:hi]
        nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
        return np.sort(mix(np.repeat(self.hash[lo:hi], weight) + nth.astype(np.uint64) * GOLDEN))


def signatures(doc: np.ndarray, elements: np.ndarray, weight: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """The signature of every document: for each slot the name of its first point."""
    level = np.ceil(np.log2(weight)).astype(np.int64) + 1  # intervals that the weight reaches into
    which = np.repeat(np.arange(len(doc)), level)
    step = np.arange(len(which)) - np.repeat(np.cumsum(level) - level, level)
    low = np.where(step == 0, 0, 2.0 ** (step - 1))
    size = np.where(step == 0, 1, low)
    owner, reach = doc[which], weight[which]
    seed = mix(elements[which] + (step.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    total = np.bincount(doc, weight, n_docs)
    horizon = slots * (np.log(slots) + 3) / np.maximum(total, 1e-300)
    out = np.zeros((n_docs, slots), np.uint64)
    open_docs = total > 0
    while open_docs.any():
        active = np.flatnonzero(open_docs[owner])
        time, start, chunk = np.zeros(len(active)), 0, 2
        least, found = np.full(n_docs * slots, np.inf), []
        while len(active):
            point = seed[active][:, None] + np.arange(start + 1, start + chunk + 1, dtype=np.uint64) * GOLDEN
            name = mix(point)
            times = time[:, None] + np.cumsum(-np.log(unit(mix(name))), 1) / size[active][:, None]
            place = low[active][:, None] + unit(mix(name ^ GOLDEN)) * size[active][:, None]
            inside = times <= horizon[owner[active]][:, None]
            r, c = np.nonzero(inside & (place <= reach[active][:, None]))
            slot = owner[active][r] * slots + (name[r, c] % np.uint64(slots)).astype(np.int64)
            np.minimum.at(least, slot, times[r, c])
            found.append((slot, times[r, c], name[r, c]))
            going = inside[:, -1]
            active, time = active[going], times[going, -1]
            start, chunk = start + chunk, min(64, chunk * (2 if start else 1))
        for slot, when, name in found:
            first = when == least[slot]
            out.reshape(-1)[slot[first]] = name[first]
        open_docs &= np.isinf(least.reshape(n_docs, slots)).any(1)
        horizon *= 1.5
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, parts.shape[:2])
    for r in range(rows):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + parts[:, :, r])
    return key.view(np.int64)


SKETCH = "uid long, key long, ta long, tb long, bands array<long>"


def sketches(pieces: DataFrame, key_at: int | None) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in each_piece(batches):
            bags = Bags(piece)
            n = bags.n_docs
            keys = band_keys(signatures(bags.doc, bags.hash, bags.weight, n, SLOTS), BANDS, ROWS)
            wordless = bags.words.counts == 0
            offsets = np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)
            key = piece.rows.field(key_at).cast(pa.int64()) if key_at is not None else pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((piece.id << ROW_BITS) + np.arange(n)),
                    key,
                    pa.array(bags.text[0].view(np.int64), mask=wordless),
                    pa.array(bags.text[1].view(np.int64), mask=wordless),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                ],
                names=["uid", "key", "ta", "tb", "bands"],
            )

    return pieces.mapInArrow(sketch, SKETCH)


# --- exact comparison --------------------------------------------------------------------------


def bags_of(pieces: DataFrame, wanted: DataFrame) -> DataFrame:
    """The multisets of the wanted documents (``uid``); texts stay where they are."""
    lists = wanted.groupBy(F.shiftright("uid", ROW_BITS).alias("piece")).agg(F.collect_list("uid").alias("uids"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece, uids = Piece(batch, i), batch.column("uids")[i].as_py()
                bags = Bags(piece.only([u & ((1 << ROW_BITS) - 1) for u in uids]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids, pa.int64()), pa.array([bags.bag(k).tobytes() for k in range(len(uids))], pa.binary())],
                    names=["uid", "bag"],
                )

    return pieces.join(lists, "piece").mapInArrow(unpack, "uid long, bag binary")


def links(bags: DataFrame, pairs: DataFrame, threshold: float, salts: int = 16) -> DataFrame:
    """Those pairs (``a``, ``b``) whose multisets overlap enough. One ``a`` may be in many pairs."""
    left = pairs.select("a", F.pmod("b", F.lit(salts)).alias("salt")).distinct()
    left = left.join(bags.withColumnRenamed("uid", "a"), "a")
    right = pairs.join(bags.select(F.col("uid").alias("b"), F.col("bag").alias("other")), "b")
    both = right.withColumn("salt", F.pmod("b", F.lit(salts))).join(left, ["a", "salt"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = shared >= threshold * (len(x) + len(y) - shared) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "bag", "other").mapInArrow(compare, "a long, b long")


class Block:
    """Multisets of several documents, as one sorted list of occurrences with their owners."""

    def __init__(self, rows: pa.StructArray):
        self.uid = rows.field("uid").to_numpy()
        self.of_class = rows.field("class_uid").to_numpy()
        bags = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.field("bag")]
        self.size = np.array([len(x) for x in bags], np.int64)
        self.item = np.concatenate(bags)
        self.owner = np.repeat(np.arange(len(bags)), self.size)


def overlaps(a: Block, b: Block, columns: int = 8192) -> np.ndarray:
    """Shared occurrences of each document of one block with each of the other."""
    shared = np.intersect1d(a.item, b.item)
    out = np.zeros((len(a.uid), len(b.uid)), np.float32)
    if not len(shared):
        return out
    places, counts = [], []
    for block in (a, b):
        at = np.minimum(np.searchsorted(shared, block.item), len(shared) - 1)
        hit = np.flatnonzero(shared[at] == block.item)
        hit = hit[np.argsort(at[hit], kind="stable")]
        places.append((at[hit], block.owner[hit]))
        counts.append(np.bincount(at[hit], minlength=len(shared)))
    (at, owner), (_, others) = places
    many = counts[0] * counts[1] > MANY_PAIRS
    few = ~many[at]
    at, owner = at[few], owner[few]
    size = counts[1][at]
    first = (np.cumsum(counts[1]) - counts[1])[at]
    other = others[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    pair = np.repeat(owner, size) * len(b.uid) + other
    out += np.bincount(pair, minlength=out.size).reshape(out.shape)
    column, n = np.cumsum(many) - 1, int(many.sum())
    for low in range(0, n, columns):
        sides = []
        for (at, owner), block in zip(places, (a, b), strict=True):
            own = many[at] & (column[at] >= low) & (column[at] < low + columns)
            side = np.zeros((len(block.uid), min(columns, n - low)), np.float32)
            side[owner[own], column[at[own]] - low] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def _joining(a: Block, b: Block, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the links as join the same classes: each class hangs together already."""
    head: dict[int, int] = {}

    def root(c: int) -> int:
        while head.get(c, c) != c:
            head[c] = c = head.get(head[c], head[c])
        return c

    keep = []
    for k, (c, d) in enumerate(zip(a.of_class[x].tolist(), b.of_class[y].tolist(), strict=True)):
        c, d = root(c), root(d)
        if c != d:
            head[max(c, d)] = min(c, d)
            keep.append(k)
    return x[keep], y[keep]


def in_blocks(sized: DataFrame, threshold: float) -> DataFrame:
    """Adds ``block`` to texts (``uid, cluster, class_uid, n``): a name within the cluster.

    A cluster of more than a block is cut by ranges of length, its classes of more than a block
    stay by themselves, and what is still more than a block is dealt by hash. All of it takes
    counts, so that no task sorts a cluster.
    """
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_ITEMS, F.count("*") / BLOCK_DOCS))

    def counted(rows: DataFrame, key: str, name: str) -> DataFrame:
        large = rows.groupBy(key).agg(blocks.alias(name)).where(F.col(name) > 1)
        return spread_join(rows, large, key)

    rows = counted(counted(sized, "cluster", "in_cluster"), "class_uid", "in_class")
    step = max(0.05, -math.log(max(threshold, 0.1)))
    large = F.col("in_cluster").isNotNull()
    own = F.when(large & F.col("in_class").isNotNull(), F.col("class_uid")).otherwise(-1)
    span = F.when(large, F.floor(F.log("n") / step)).otherwise(0)
    rows = counted(rows.withColumn("cell", F.struct("cluster", own.alias("own"), span.alias("span"))), "cell", "in_cell")
    part = F.pmod(F.xxhash64("uid"), F.coalesce("in_cell", F.lit(1)))
    block = F.struct("cell.own", "cell.span", part.alias("part"))
    return rows.select("uid", "cluster", "class_uid", "n", block.alias("block"))


def block_links(bags: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Links between different classes of a cluster: ``members`` has ``uid, cluster, class_uid``."""
    sized = members.join(bags.select("uid", (F.octet_length("bag") / 8).cast("long").alias("n")), "uid")
    placed = freeze(in_blocks(freeze(sized), threshold))
    about = placed.groupBy("cluster", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("class_uid").alias("c"), F.max("class_uid").alias("d")
    )
    other = about.toDF("cluster", "block2", "low2", "high2", "c2", "d2")
    may = (F.col("high") >= threshold * F.col("low2")) & (F.col("high2") >= threshold * F.col("low"))
    one = (F.col("c") == F.col("d")) & (F.col("c2") == F.col("d2")) & (F.col("c") == F.col("c2"))
    facing = about.join(other, "cluster").where((F.col("block") <= F.col("block2")) & may & ~one)
    row = F.struct("uid", "class_uid", "bag")
    full = placed.join(bags, "uid").groupBy("cluster", "block").agg(F.collect_list(row).alias("left"))
    joined = (
        facing.select("cluster", "block", "block2")
        .join(full, ["cluster", "block"])
        .join(full.toDF("cluster", "block2", "right"), ["cluster", "block2"])
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (Block(batch.column(k)[i].values) for k in (0, 1))
                shared = overlaps(a, b)
                linked = shared >= threshold * (a.size[:, None] + b.size - shared) - 1e-6
                linked &= a.of_class[:, None] != b.of_class
                x, y = _joining(a, b, *np.nonzero(linked))
                yield pa.RecordBatch.from_arrays([pa.array(a.uid[x]), pa.array(b.uid[y])], names=["a", "b"])

    return joined.select("left", "right").mapInArrow(compare, "a long, b long")


# --- classes -----------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Classes of documents whose texts are linked by weighted Jaccard similarity of word shingles.

    Returns the pieces of the documents, and a row for each document: ``uid`` (its place), ``key``
    (the given column as long, null where there is none), ``class_uid``, and ``class_key``, the
    smallest key of its class. Equal word sequences are one text. Texts of fewer than five words
    are near-duplicates of texts with the same words only; texts without words (nulls too) are
    never linked. Repeated rows fall in one class. An empty table gives no rows.
    """
    pieces = cut(docs, text)
    names = [f.name for f in other_fields(docs, text)]
    sketch = freeze(sketches(pieces, names.index(key) if key in names else None))
    same = sketch.where("ta is not null").groupBy("ta", "tb").agg(F.min("uid").alias("rep"))
    bands = (
        sketch.join(same.select(F.col("rep").alias("uid")), "uid", "left_semi")
        .select("uid", F.explode("bands").alias("band"))
    )
    full = bands.groupBy("band").agg(F.min("uid").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = freeze(bands.join(full, "band"))

    pairs = shared.where("uid <> lead").select(F.col("lead").alias("a"), F.col("uid").alias("b")).distinct()
    pairs = freeze(pairs)
    bags = freeze(bags_of(pieces, shared.select("uid").distinct()))
    edges = freeze(links(bags, pairs, threshold))
    classes = components(edges)
    clusters = components(pairs).withColumnRenamed("class_uid", "cluster")
    members = (
        bags.select("uid")
        .join(clusters, "uid", "left")
        .join(classes, "uid", "left")
        .select("uid", F.coalesce("cluster", "uid").alias("cluster"), F.coalesce("class_uid", "uid").alias("class_uid"))
    )
    several = members.groupBy("cluster").agg(F.min("class_uid").alias("x"), F.max("class_uid").alias("y"))
    members = members.join(several.where("x <> y").select("cluster"), "cluster", "left_semi")
    classes = components(edges.union(block_links(bags, members, threshold)))

    placed = (
        sketch.select("uid", "key", "ta", "tb")
        .join(same, ["ta", "tb"], "left")
        .select("uid", "key", F.coalesce("rep", "uid").alias("rep"))
        .join(classes.withColumnRenamed("uid", "rep"), "rep", "left")
        .select("uid", "key", F.coalesce("class_uid", "rep").alias("class_uid"))
    )
    heads = placed.groupBy("class_uid").agg(
        F.min("key").alias("class_key"), F.min(F.struct("key", "uid")).alias("first")
    )
    found = placed.join(heads, "class_uid").select(
        "uid", "key", "class_uid", "class_key", (F.col("first.uid") == F.col("uid")).alias("first")
    )
    return pieces, found


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """The documents as they came, with one of each class: that of the smallest key."""
    pieces, found = near_duplicates(docs, text, key, threshold)
    gone = found.where("not first").select(
        F.shiftright("uid", ROW_BITS).alias("piece"),
        F.lit(0).alias("level"),
        F.col("uid").bitwiseAND((1 << ROW_BITS) - 1).cast("int").alias("bucket"),
        F.lit(b"").alias("bits"),
    )
    others = other_fields(docs, text)
    schema = T.StructType([*others, T.StructField(text, T.StringType())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in each_piece(batches):
            left = np.ones(len(piece.ends), bool)
            left[[b for _, b in piece.marks]] = False
            raw, begin = piece.body.tobytes(), np.concatenate([[0], piece.ends[:-1]])
            texts = pa.array([raw[a : b - 1] for a, b in zip(begin, piece.ends, strict=True)], pa.binary())
            batch = pa.RecordBatch.from_arrays(
                [*piece.carried(len(others)), texts.cast(pa.string())], names=schema.fieldNames()
            )
            yield batch.filter(pa.array(left))

    return with_marks(pieces, gone).mapInArrow(keep, schema).select(*docs.columns)
