"""Token ids in files: canonical, length-limited Huffman codes in blocks that decode on their own.

The file format is a Parquet data set of blocks beside a one-row code book. A block holds whole
documents in ascending ``doc_id`` order (nulls first; equal ids by their tokens): the bits of their
ids, how many ids each document has, and the bit offset of every 256th id. A reader starts at all
offsets of a block at once and looks each next code up in a table of ``2**limit`` entries.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.llm.common import partitions
from riskweave.llm.pieces import FIRST_BYTES, identities, joint, mix, runs, words_at
from riskweave.session import checkpoint_root

LIMIT = 18
STRIDE = 256
BLOCK_IDS = 1 << 18
#: A task forgets the parts it has encoded beyond this many.
CACHED_PARTS = 1_200_000
BATCH_BYTES = 2 << 20


# --- encoding texts ----------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def gather(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``values``, one after the other."""
    shift = np.cumsum(sizes) - sizes
    return values[np.repeat(first - shift, sizes) + np.arange(int(sizes.sum()))]


#: Bytes that are white space; letters; marks that end a run of letters.
WHITE, LETTER, STOP = np.zeros((3, 256), bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
STOP[list(b".,;:!?")] = True


def part_starts(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of parts of texts (each followed by a line feed) that encode on their own.

    A byte-level vocabulary's pre-tokens never go on from a mark into white space, nor from a letter
    into a full stop or comma, so a text may be parted before either. It is not parted where white
    space beyond ASCII comes before.
    """
    before = np.concatenate([[np.uint8(10)] * 3, raw])[:-1]
    b3, b2, b1 = before[:-2], before[1:-1], before[2:]
    wide = ((b3 >= 0xE1) & (b3 <= 0xE3) & ((b2 == 0x80) | (b2 == 0x81) | (b2 == 0x9A))) | (
        (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    )
    cut = (WHITE[raw] & ~WHITE[b1] & ~wide) | (STOP[raw] & LETTER[b1])
    cut[ends - 1] = True  # the line feed is not the text's
    cut[np.concatenate([[0], ends[:-1]])] = True
    starts = np.flatnonzero(cut)
    stops = np.append(starts[1:], len(raw))
    own = np.ones(len(starts), bool)
    own[np.searchsorted(starts, ends - 1)] = False
    return starts[own], stops[own]


def splits_like_bytes(tokenizer) -> bool:
    """Whether a tokenizer splits texts as ``part_starts`` assumes: by the common byte-level rule,
    with no normaliser and no added token that a part could cut or that looks around itself."""
    made = json.loads(tokenizer.to_str())
    split = made["pre_tokenizer"] or {}
    common = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
    if not common or made["normalizer"] is not None or made.get("truncation") or made.get("padding"):
        return False
    for token in made["added_tokens"]:
        raw = np.frombuffer(token["content"].encode(), np.uint8)
        if token["single_word"] or token["lstrip"] or token["rstrip"] or (WHITE | STOP)[raw].any():
            return False
    return True


class ByteParts:
    """Encodes texts part by part; a part that was met before is looked up.

    Parts below eight bytes meet by their bytes. Others meet by a hash, and their identities
    (``pieces.identities``) are compared on every hit: two parts of one hash make it start over with
    another one. Texts of a tokenizer that splits otherwise are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.parted = splits_like_bytes(self.tokenizer)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(names.values()) + 1, np.int64)
        self.size[list(names.values())] = [len(x) for x in names]
        for number, token in self.tokenizer.get_added_tokens_decoder().items():
            self.size[number] = len(token.content.encode())
        self.salt = np.uint64(0)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.names = np.zeros((0, 2), np.uint64)
        self.first, self.sizes = np.zeros((2, 0), np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _met(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
        """Keys of the different parts, one of each, which each is, which are known, and their names."""
        size = stops - starts
        short = words_at(np.append(raw, np.zeros(8, np.uint8)), starts) & FIRST_BYTES[np.minimum(size, 7)]
        key = short | size.astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(size > 7)
        names = identities(raw, starts[long], stops[long])
        while True:
            key[long] = joint(mix(names[0] ^ self.salt), names[1]) | np.uint64(1 << 63)
            found, sample, at = np.unique(key, return_index=True, return_inverse=True)
            place = np.searchsorted(self.known, found)
            old = place < len(self.known)
            old[old] = self.known[place[old]] == found[old]
            nth = np.zeros(len(key), np.int64)  # where a long part's name is
            nth[long] = np.arange(len(long))
            own = np.zeros((len(found), 2), np.uint64)
            hashed = found >= np.uint64(1 << 63)
            own[hashed] = names.T[nth[sample[hashed]]]
            alike = (names.T == own[at[long]]).all()
            if alike and (self.names[place[old]] == own[old]).all():
                return found, sample, at, old, own
            self.forget()
            self.salt += np.uint64(1)

    def encode(self, body: bytes, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each document closed by ``end``, and the number of each document."""
        if len(self.known) > CACHED_PARTS:
            self.forget()
        raw = np.frombuffer(body, np.uint8)
        if self.parted:
            starts, stops = part_starts(raw, ends)
        else:
            starts, stops = np.concatenate([[0], ends[:-1]]), ends - 1
            starts, stops = starts[starts < stops], stops[starts < stops]
        found, sample, at, old, names = self._met(raw, starts, stops)
        fresh = sample[~old]
        if len(fresh):
            self._learn(body, starts[fresh], stops[fresh], found[~old], names[~old])
        place = np.searchsorted(self.known, found)
        first, sizes = self.first[place][at], self.sizes[place][at]
        closing = np.searchsorted(starts, ends)  # after the parts of a document comes its end
        sizes, first = np.insert(sizes, closing, 1), np.insert(first, closing, len(self.ids))
        ids = gather(np.append(self.ids, np.uint32(end)), first, sizes)
        edges = np.cumsum(sizes)[closing + np.arange(len(closing))]
        return ids, np.diff(edges, prepend=0)

    def _learn(self, body: bytes, starts: np.ndarray, stops: np.ndarray, key: np.ndarray, names: np.ndarray) -> None:
        raw = np.frombuffer(body, np.uint8)
        # Parts from white space to a mark may stand side by side and be encoded in one go.
        chain_ = self.parted & WHITE[raw[starts]] & ~WHITE[raw[stops - 1]] & (raw[stops - 1] < 128)
        order = np.concatenate([np.flatnonzero(chain_), np.flatnonzero(~chain_)])
        joined = int(chain_.sum())
        size = (stops - starts)[order]
        ids, sizes = [], []
        for lo in range(0, joined, 20_000):
            hi = min(joined, lo + 20_000)
            text = b"".join(body[a:b] for a, b in zip(starts[order[lo:hi]], stops[order[lo:hi]], strict=True)).decode()
            own = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            reach = np.cumsum(self.size[own])
            upto = np.searchsorted(reach, np.cumsum(size[lo:hi]))
            ids.append(own)
            sizes.append(np.diff(upto + 1, prepend=0))
        alone = [body[a:b].decode() for a, b in zip(starts[order[joined:]], stops[order[joined:]], strict=True)]
        for found in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False):
            ids.append(np.array(found.ids, np.uint32))
            sizes.append(np.array([len(found.ids)]))
        sizes = np.concatenate(sizes).astype(np.int64)
        first = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, *ids])
        known = np.concatenate([self.known, key[order]])
        by_key = np.argsort(known, kind="stable")
        self.known = known[by_key]
        self.names = np.concatenate([self.names, names[order]])[by_key]
        self.first = np.concatenate([self.first, first])[by_key]
        self.sizes = np.concatenate([self.sizes, sizes])[by_key]


def width(tokenizer: str) -> str:
    """The narrowest little-endian word for the ids of a vocabulary."""
    return "<u2" if _tokenizer(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """``doc_id`` and ``ids`` (words of ``width``) of every text; null counts as empty."""
    kind = width(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteParts(tokenizer)
        for batch in batches:
            for lo, hi, body, ends in runs(batch.column(1), BATCH_BYTES):
                ids, counts = encoder.encode(body, ends, end)
                own = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own, binaries(ids.astype(kind), counts)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        encode, "doc_id long, ids binary"
    )


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    kind = pa.binary() if offsets[-1] < 2**31 else pa.large_binary()
    offsets = offsets.astype(np.int32 if kind == pa.binary() else np.int64)
    return pa.Array.from_buffers(kind, len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


# --- codes -------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for a count of 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids have no codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    merged, from_leaf = leaves, np.ones(len(leaves), bool)
    levels = [from_leaf]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        by_weight = np.argsort(both, kind="stable")
        merged, from_leaf = both[by_weight], by_weight < len(leaves)
        levels.append(from_leaf)
    wanted = 2 * len(leaves) - 2
    for from_leaf in reversed(levels):
        taken = int(from_leaf[:wanted].sum())
        out[order[:taken]] += 1
        wanted = 2 * (wanted - taken)
    return out


class Code:
    """Canonical codes: by length, then id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.limit = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        width = np.left_shift(1, self.limit - self.lengths[order])
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (np.cumsum(width) - width) >> (self.limit - self.lengths[order])
        spare = (1 << self.limit) - int(width.sum())
        self.symbols = np.concatenate([np.repeat(order, width), np.zeros(spare, np.int64)]).astype(np.uint32)
        self.steps = np.concatenate([np.repeat(self.lengths[order], width), np.ones(spare, np.int64)])

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of the ids, and the bit offset of every ``STRIDE``-th."""
        sizes = self.lengths[ids]
        offset = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        word = offset >> 5
        value = self.codes[ids] << (64 - (offset & 31) - sizes).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(total // 32 + 3, np.uint64)  # every word has a code that begins in it
        if len(ids):
            out[word[first]] |= np.bitwise_or.reduceat(value >> np.uint64(32), first)
            out[word[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[: (total + 7) // 8], offset[::STRIDE]

    def unpack(self, bits: bytes, offsets: np.ndarray, count: int) -> np.ndarray:
        """All ids of a block, from all its offsets at once."""
        raw = np.concatenate([np.frombuffer(bits, np.uint8), np.zeros(STRIDE * self.limit // 8 + 8, np.uint8)])
        wide = raw.astype(np.uint32)
        wide = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]
        at = offsets.astype(np.int64)
        out = np.empty((STRIDE, len(at)), np.uint32)
        last, down = len(wide) - 1, np.uint32(32 - self.limit)
        for k in range(STRIDE):
            found = (wide[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> down
            out[k] = self.symbols[found]
            at += self.steps[found]
        return out.T.ravel()[:count]


# --- files -------------------------------------------------------------------------------------

BLOCKS = (
    "part int, first long, n_ids long, doc_ids array<long>, counts array<long>, offsets array<long>, bits binary"
)


def write_tokens(tokens: DataFrame, path: str, kind: str = "<u4", limit: int = LIMIT) -> None:
    """Writes documents of ids (``doc_id``, ``ids`` as words of ``kind``) to ``path``."""
    spark = tokens.sparkSession

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            own = np.bincount(np.frombuffer(raw, kind))
            if len(own) > len(counts):
                own, counts = counts, own
            counts[: len(own)] += own
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    # One row an id of the vocabulary: bounded, whatever the corpus.
    total = tokens.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = total.toArrow()
    size = max(rows.column("id").to_pylist(), default=0) + 1
    counts = np.zeros(size, np.int64)
    counts[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    lengths = code_lengths(counts, limit)
    book = [(bytearray(lengths.tobytes()),)]
    spark.createDataFrame(book, "lengths binary").coalesce(1).write.parquet(f"{path}/book")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, first = Code(lengths), TaskContext.get().partitionId(), 0
        size_of = np.dtype(kind).itemsize
        held: list[tuple[int | None, bytes]] = []
        waiting = 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(row)
                waiting += len(row[1]) // size_of
                if waiting >= BLOCK_IDS:
                    yield _block(code, part, first, held, kind)
                    first, held, waiting = first + waiting, [], 0
        if held:
            yield _block(code, part, first, held, kind)

    ordered = tokens.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _block(code: Code, part: int, first: int, held: list[tuple[int | None, bytes]], kind: str) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(x for _, x in held), kind)
    bits, offsets = code.pack(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()),
            pa.array([first], pa.int64()),
            pa.array([len(ids)], pa.int64()),
            pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
            pa.array([[len(x) // ids.itemsize for _, x in held]], pa.list_(pa.int64())),
            pa.array([offsets.tolist()], pa.list_(pa.int64())),
            pa.array([bits], pa.binary()),
        ],
        names=["part", "first", "n_ids", "doc_ids", "counts", "offsets", "bits"],
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/book").first()[0], np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row a part of the files, at most as many as the writer's shuffle had partitions.
    ends = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(starts), "part").select(
        (F.col("base") + F.col("first")).alias("start"), "n_ids", "doc_ids", "counts", "offsets", "bits"
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                start, n, docs, counts, offsets, bits = (batch.column(k)[i] for k in range(6))
                sizes = counts.values.to_numpy()
                ids = code.unpack(bits.as_py(), offsets.values.to_numpy(), n.as_py())
                first = start.as_py() + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(first), pa.array(sizes), binaries(ids.astype("<u4"), sizes)],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def store(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """Encodes the texts once, writes the files, reads them back.

    A null or empty text has the end id alone. Other columns are not stored. Equal ``doc_id`` are
    kept, ordered by their ids; null ones come first. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_root(spark)}/tokens_{uuid.uuid4().hex}"
    encoded(docs, tokenizer, end).write.option("compression", "zstd").parquet(f"{path}/plain")
    write_tokens(spark.read.schema("doc_id long, ids binary").parquet(f"{path}/plain"), path, width(tokenizer))
    return read_tokens(spark, path)
