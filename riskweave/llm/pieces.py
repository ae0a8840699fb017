"""Whole texts in pieces, fingerprints of their windows, and the exchange that finds repeats.

A *piece* is a row with about a megabyte of consecutive documents: their other columns, their end
offsets and their UTF-8 bytes, each followed by one line feed. Pieces are written once, bucketed by
their id, so that later passes meet what was learned about a piece without moving its text again.

An *exchange* asks for each fingerprint of each piece whether it is found elsewhere. A piece sends
every different fingerprint once (so a hot one arrives once a piece, not once a row), packed by
range, and gets one bit back for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import freeze, stored

PIECE_BYTES = 1 << 20
#: Bits of a piece's number within its task, and of a document's number within its piece.
PIECE_BITS, ROW_BITS = 24, 18
#: Weights of byte values, for orders by hash.
LANES = np.random.default_rng(20240607).integers(0, 2**64, (2, 256), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit words over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What a lane begins with, and the odd factor of the left one of two joined hashes.
LANE_KEYS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
LEFT = np.uint64(0xA24BAED4963EE407)
#: The first n bytes of a little-endian word.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Strings shorter than this are held whole in two words.
SHORT = 16


def joint(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order. Every step is mixed, so that no sum of terms can cancel out."""
    return mix(left * LEFT + right)


def words_at(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The eight bytes from each start as a little-endian word; ``raw`` has eight more bytes."""
    return np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))[starts]


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2 of each stretch, as two rows of 64-bit words."""
    spans = zip(starts.tolist(), ends.tolist(), strict=True)
    found = b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in spans)
    return np.frombuffer(found, "<u8").reshape(-1, 2).T


def identities(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each stretch of bytes: its bytes and length below ``SHORT``, so that they
    differ if the stretches do; else 120 bits of BLAKE2 under a mark of their own."""
    raw = np.concatenate([body, np.zeros(2 * SHORT, np.uint8)])
    size = ends - starts
    out = np.empty((2, len(starts)), np.uint64)
    out[0] = words_at(raw, starts) & FIRST_BYTES[np.minimum(size, 8)]
    rest = words_at(raw, starts + 8) & FIRST_BYTES[np.clip(size - 8, 0, 7)]
    out[1] = rest | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size >= SHORT)
    if len(long):
        out[:, long] = digests(body.tobytes(), starts[long], ends[long])
        out[1, long] |= np.uint64(255 << 56)
    return out


def symbols(ids: np.ndarray, lane: int = 0) -> np.ndarray:
    """One hash for each identity."""
    key = np.uint64(LANE_KEYS[lane])
    return joint(mix(ids[0] ^ key), mix(ids[1] + key))


class Windows:
    """Hashes of windows of any length over a sequence of hashes, each of which stands for ``unit``
    places from its own.

    A window is the joint hash of its first and its last ``unit * 2**k`` places, the most that are
    fewer than its own, each of them joined from halves, down to single hashes; where first and last
    overlap, they still say all of it. Few windows are worked out one by one, many from the halves
    of all places.
    """

    def __init__(self, single: np.ndarray, unit: int = 1):
        self.levels, self.unit = [single], unit

    def _halves(self, starts: np.ndarray, level: int) -> np.ndarray:
        size = len(self.levels[0])
        if level < len(self.levels):
            return self.levels[level][starts]
        if len(starts) << level > level * size:
            while len(self.levels) <= level:
                last, step = self.levels[-1], self.unit << (len(self.levels) - 1)
                fit = max(0, len(last) - step)
                self.levels.append(joint(last[:fit], last[step : step + fit]))
            return self.levels[level][starts]
        step = self.unit << (level - 1)
        return joint(self._halves(starts, level - 1), self._halves(starts + step, level - 1))

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Windows of one length, at least ``unit``."""
        level = max(0, (-(-length // self.unit) - 1).bit_length() - 1)
        first = self._halves(starts, level)
        last = self._halves(starts + (length - (self.unit << level)), level)
        return joint(first, last ^ mix(np.full(1, length, np.uint64)))


def grams(body: np.ndarray, lane: int = 0) -> Windows:
    """Windows of at least eight bytes of a text, over all its strings of eight bytes."""
    a = np.concatenate([body, np.zeros(7, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        a = a[:-step] | (a[step:] << np.uint64(8 * step))
    return Windows(mix(a ^ np.uint64(LANE_KEYS[lane])), 8)


#: Which bytes end a word.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Word bounds of a piece, identities and hashes of the words, and where each document's words end."""

    def __init__(self, body: np.ndarray, ends: np.ndarray, blank: np.ndarray = BLANK):
        inside = np.zeros(len(body) + 2, np.int8)
        inside[1:-1] = ~blank[body]
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.ids = identities(body, self.starts, self.ends)
        self.hashes = symbols(self.ids)
        self.bounds = np.searchsorted(self.starts, ends)
        self.counts = np.diff(self.bounds, prepend=0)

    def __len__(self) -> int:
        return len(self.starts)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document."""
        return np.repeat(self.bounds, self.counts) - np.arange(len(self))


# --- pieces ------------------------------------------------------------------------------------


def runs(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Consecutive texts of about ``limit`` bytes: from, to, their bytes with a line feed after
    each, and where each ends. A longer text is a run of its own; nulls count as empty."""
    whole = texts.cast(pa.large_binary()).fill_null(b"")
    feed, nothing = pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary())
    whole = pc.binary_join_element_wise(whole, feed, nothing)
    size = np.cumsum(pc.binary_length(whole).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        to = min(to, at + (1 << ROW_BITS))
        yield at, to, b"".join(whole.slice(at, to - at).to_pylist()), size[at:to] - base
        at = to


def cut(docs: DataFrame, text: str) -> DataFrame:
    """Pieces of the texts; a null text counts as empty. Bucketed by piece, in the shared folder."""
    others = [f for f in docs.schema.fields if f.name != text]
    names = [f"c{i}" for i in range(len(others))]
    body = docs[text].cast("string").alias("body")
    plain = docs.select(
        F.struct(*[docs[f.name].alias(n) for f, n in zip(others, names, strict=True)], F.lit(0).alias("pad")).alias("row"),
        body,
    )
    schema = T.StructType(
        [
            T.StructField("piece", T.LongType()),
            T.StructField("rows", T.ArrayType(plain.schema["row"].dataType)),
            T.StructField("ends", T.ArrayType(T.LongType())),
            T.StructField("body", T.BinaryType()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << PIECE_BITS
        for batch in batches:
            for at, to, joined, ends in runs(batch.column(1)):
                rows = batch.column(0).slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([piece], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.concat_arrays([rows])),
                        pa.array([ends.tolist()], pa.list_(pa.int64())),
                        pa.array([joined], pa.binary()),
                    ],
                    names=["piece", "rows", "ends", "body"],
                )
                piece += 1

    return stored(plain.mapInArrow(pack, schema), "pieces", "piece")


def other_fields(docs: DataFrame, text: str) -> list[T.StructField]:
    return [f for f in docs.schema.fields if f.name != text]


class Piece:
    """One row of pieces within a task."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.id = batch.column("piece")[i].as_py()
        self.ends = np.asarray(batch.column("ends")[i].values.to_numpy(zero_copy_only=False), np.int64)
        self.body = np.frombuffer(batch.column("body")[i].as_buffer(), np.uint8)
        self.rows = batch.column("rows")[i].values
        self.marks: dict[tuple[int, int], bytes] = {}
        if "marks" in batch.schema.names and batch.column("marks")[i].is_valid:
            for m in batch.column("marks")[i].as_py():
                self.marks[m["level"], m["bucket"]] = m["bits"]

    def only(self, chosen: list[int]) -> Piece:
        """A piece of some of its documents, in the given order, without their other columns."""
        begin = np.concatenate([[0], self.ends[:-1]])
        out = Piece.__new__(Piece)
        parts = [self.body[begin[k] : self.ends[k]] for k in chosen]
        out.id, out.body, out.ends = self.id, np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return out

    def carried(self, count: int) -> list[pa.Array]:
        """The other columns of the documents."""
        return [self.rows.field(j) for j in range(count)]


def each_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Piece(batch, i)


# --- exchange ----------------------------------------------------------------------------------


class Distinct:
    """The different rows of some columns of 64-bit words, sorted by the first."""

    def __init__(self, *lanes: np.ndarray):
        order = np.lexsort(lanes[::-1]) if len(lanes) > 1 else np.argsort(lanes[0], kind="stable")
        kept = [x[order] for x in lanes]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in kept])
        group = np.cumsum(new) - 1
        self.back = np.empty(len(order), np.int64)
        self.back[order] = group
        self.lanes = [x[new] for x in kept]
        self.several = np.bincount(group, minlength=len(self.lanes[0])) > 1

    def slices(self, buckets: int) -> np.ndarray:
        """Bounds of the buckets: ranges of the first lane."""
        place = (self.lanes[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return np.searchsorted(place, np.arange(buckets + 1))


SENT = "bucket int, piece long, level int, size int, blob binary"
MARKS = "piece long, level int, bucket int, bits binary"


def sent(piece: Piece, level: int, rows: Distinct, buckets: int) -> pa.RecordBatch:
    bounds = rows.slices(buckets)
    full = np.flatnonzero(np.diff(bounds))
    blobs = []
    for b in full:
        own = slice(bounds[b], bounds[b + 1])
        blobs.append(b"".join(x[own].tobytes() for x in rows.lanes) + rows.several[own].tobytes())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full.astype(np.int32)),
            pa.array(np.full(len(full), piece.id, np.int64)),
            pa.array(np.full(len(full), level, np.int32)),
            pa.array(np.diff(bounds)[full].astype(np.int32)),
            pa.array(blobs, pa.binary()),
        ],
        names=["bucket", "piece", "level", "size", "blob"],
    )


def answered(piece: Piece, level: int, rows: Distinct, buckets: int, bits: int = 1) -> list[np.ndarray]:
    """What came back for each row, as ``bits`` columns of booleans."""
    bounds = rows.slices(buckets)
    out = np.zeros((bits, len(rows.lanes[0])), bool)
    for b in np.flatnonzero(np.diff(bounds)):
        size = bounds[b + 1] - bounds[b]
        raw = np.frombuffer(piece.marks[level, int(b)], np.uint8)
        out[:, bounds[b] : bounds[b + 1]] = np.unpackbits(raw, count=bits * size).reshape(bits, size).view(bool)
    return [x[rows.back] for x in out]


def repeats(lanes: list[np.ndarray], several: np.ndarray) -> list[np.ndarray]:
    """Judges one bucket: whether a row is found in several pieces, or several times in its own."""
    order = np.lexsort(lanes[::-1]) if len(lanes) > 1 else np.argsort(lanes[0], kind="stable")
    kept = [x[order] for x in lanes]
    same = np.logical_and.reduce([x[1:] == x[:-1] for x in kept])
    found = several[order].copy()
    found[1:] |= same
    found[:-1] |= same
    out = np.empty(len(order), bool)
    out[order] = found
    return [out]


def exchange(
    sending: DataFrame,
    lanes: int,
    judge: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]] = repeats,
) -> DataFrame:
    """Marks for what was sent, frozen. A bucket holds each fingerprint once a piece."""

    def settle(rows: pa.Table) -> pa.Table:
        sizes = rows.column("size").to_numpy().astype(np.int64)
        columns: list[list[np.ndarray]] = [[] for _ in range(lanes + 1)]
        for blob, n in zip(rows.column("blob"), sizes, strict=True):
            raw = blob.as_buffer()
            for k in range(lanes):
                columns[k].append(np.frombuffer(raw, np.uint64, n, 8 * n * k))
            columns[lanes].append(np.frombuffer(raw, bool, n, 8 * n * lanes))
        whole = [np.concatenate(c) for c in columns]
        flags = judge(whole[:lanes], whole[lanes])
        bits, at = [], 0
        for n in sizes:
            bits.append(np.packbits(np.stack([f[at : at + n] for f in flags]).ravel()).tobytes())
            at += n
        return pa.table(
            {
                "piece": rows.column("piece"),
                "level": rows.column("level"),
                "bucket": rows.column("bucket"),
                "bits": pa.array(bits, pa.binary()),
            }
        )

    return freeze(sending.groupBy("bucket").applyInArrow(settle, MARKS))


def with_marks(pieces: DataFrame, *marks: DataFrame) -> DataFrame:
    """Each piece with all that came back for it (at most some bits a window of its own)."""
    known = marks[0]
    for m in marks[1:]:
        known = known.unionByName(m)
    known = known.groupBy("piece").agg(F.collect_list(F.struct("level", "bucket", "bits")).alias("marks"))
    return pieces.join(known, "piece", "left")


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the spans."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0
