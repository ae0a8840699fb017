"""SentencePiece ids by matching all pieces against a suffix array of the batch, and back.

The different segments of a batch (runs that no piece crosses) are written one after the other and
their suffixes sorted. Every piece of the vocabulary is looked up in that order by binary search;
its range of suffixes are its occurrences, the edges of a lattice over the text. Sorted, they are
relaxed: for a unigram model by position, as best paths; for a BPE model by merge priority, then
position, as a best path over its scores (which only rank merges) would not give its ids.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskweave.llm.common import free_name
from riskweave.llm.token_store import binaries, gather

MARK = "▁"
#: Characters in a sorted word of 64 bits.
PACK = 4
#: A task forgets the segments it has encoded beyond this many.
CACHED_SEGMENTS = 400_000
BATCH_BYTES = 2 << 20
#: Characters whose suffixes are sorted together.
INDEXED = 1 << 18
#: Longer segments are relaxed with a queue of their own.
LONG = 200
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: numbers, or bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 2:
            size, at = number(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class Model:
    """A vocabulary as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = p = sentencepiece.SentencePieceProcessor(model_file=path)
        top = [(k, v) for k, v in _fields(p.serialized_model_proto())]
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        normalizer = dict(_fields(next((v for k, v in top if k == 3), b"")))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have a lattice")
        self.prefix = bool(normalizer.get(3, 1))
        kinds = [dict(_fields(v)).get(3, 1) for k, v in top if k == 1]
        if {4, 5} & set(kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        size = p.get_piece_size()
        self.unknown = p.unk_id()
        names = [p.id_to_piece(i) for i in range(size)]
        self.bytes = np.full(256, -1, np.int64)
        for i, kind in enumerate(kinds):
            if kind == 6:
                self.bytes[int(names[i][1:-1], 16)] = i
        self.fallback = bool((self.bytes >= 0).all())
        self.ids = np.array([i for i, kind in enumerate(kinds) if kind == 1], np.int64)
        pieces = [names[i] for i in self.ids]
        self.scores = np.array([p.get_score(int(i)) for i in self.ids], np.float64)
        self.lengths = np.array([len(x) for x in pieces], np.int64)
        self.ranks = np.unique(-self.scores, return_inverse=True)[1]  # 0 for the highest score
        self.alphabet = np.array(sorted({ord(c) for x in pieces for c in x}), np.uint32)
        if len(self.alphabet) >= 1 << 16:
            raise ValueError("more than 65,535 different characters")
        self.width = -(-int(self.lengths.max(initial=1)) // PACK)
        codes = np.zeros((len(pieces), self.width * PACK), np.uint64)
        flat = self.coded("".join(pieces))
        row = np.repeat(np.arange(len(pieces)), self.lengths)
        codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)] = flat
        self.low = packed(codes.reshape(-1, self.width, PACK))
        past = np.arange(self.width * PACK) >= self.lengths[:, None]
        self.high = packed(np.where(past, np.uint64(0xFFFF), codes).reshape(-1, self.width, PACK))
        crossing = any(re.search(f"[^{MARK}]{MARK}", x) for x in pieces) or any("\n" in x for x in pieces)
        self.segments = re.compile(r"(?s:.+)" if crossing else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        shown = [b"" for _ in names]
        for i, kind in enumerate(kinds):
            if kind == 6:
                shown[i] = bytes([int(names[i][1:-1], 16)])
            elif kind == 1:
                shown[i] = names[i].replace(MARK, " ").encode()
            elif kind == 2:
                shown[i] = " ⁇ ".encode()
        self.shown_sizes = np.array([len(x) for x in shown], np.int64)
        self.shown_first = np.cumsum(self.shown_sizes) - self.shown_sizes
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def coded(self, text: str) -> np.ndarray:
        """Places of the characters in the alphabet, from 1; 0 for all others."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0).astype(np.uint64)


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def packed(codes: np.ndarray) -> np.ndarray:
    out = codes[..., 0].copy()
    for k in range(1, PACK):
        out = out << np.uint64(16) | codes[..., k]
    return out


# --- the lattice -------------------------------------------------------------------------------


def suffixes(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array (as far as the longest piece sees), and the first words of each suffix."""
    n = len(codes)
    wide = np.concatenate([codes, np.zeros((width + 1) * PACK, np.uint64)])
    first = packed(np.stack([wide[k : len(wide) - PACK + k] for k in range(PACK)], -1))
    words = np.stack([first[k * PACK : k * PACK + n] for k in range(width)], 1)
    rank = np.unique(first, return_inverse=True)[1].astype(np.uint64)
    reach = PACK
    while reach < width * PACK:  # ranks of twice the length, from ranks of the length
        behind = np.concatenate([rank[reach:], np.zeros(min(reach, len(rank)), np.uint64)])
        rank = np.unique(rank << np.uint64(32) | behind, return_inverse=True)[1].astype(np.uint64)
        reach *= 2
    return np.argsort(rank[:n]), words


def _bound(words: np.ndarray, order: np.ndarray, keys: np.ndarray, after: bool) -> np.ndarray:
    """For each key, how many suffixes sort before it (or not after it)."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(order))
    for _ in range(int(len(order)).bit_length()):
        open_ = low < high
        middle = (low + high) // 2
        own = words[order[np.minimum(middle, len(order) - 1)]]
        less, tie = np.zeros(len(keys), bool), np.ones(len(keys), bool)
        for k in range(words.shape[1]):
            less |= tie & (own[:, k] < keys[:, k])
            tie &= own[:, k] == keys[:, k]
        right = open_ & (less | tie if after else less)
        low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
    return low


def edges(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and pieces of all occurrences of all pieces in the text."""
    order, words = suffixes(codes, model.width)
    low = _bound(words, order, model.low, False)
    count = np.maximum(0, _bound(words, order, model.high, True) - low)
    return gather(order.astype(np.int32), low, count), np.repeat(np.arange(len(model.ids), dtype=np.int32), count)


def relax_merges(
    start: np.ndarray, end: np.ndarray, rank: np.ndarray, segment: np.ndarray, length: np.ndarray, n: int
) -> np.ndarray:
    """Where the symbols of a BPE model end: for each place, the end of the symbol from there.

    In a round each segment makes its best merge: the lowest rank (highest score), then the leftmost.
    """
    ahead = np.arange(1, n + 2)
    alive = np.ones(n + 1, bool)
    far = length[segment] > LONG
    for own in np.unique(segment[far]):
        pick = np.flatnonzero(segment == own)
        _merge_one(start[pick], end[pick], rank[pick], ahead, alive)
    left = np.flatnonzero(~far & (end - start > 1))
    wide, deep = int(n).bit_length(), int(rank.max(initial=0)).bit_length()
    key = segment[left].astype(np.int64) << (wide + deep)
    key |= rank[left].astype(np.int64) << wide
    left = left[np.argsort(key | start[left])]
    a, b, s = start[left], end[left], segment[left]
    while len(a):
        middle = ahead[a]
        fits = alive[a] & (middle < b)
        fits &= ahead[np.minimum(middle, n)] == b
        at = np.flatnonzero(fits)
        at = at[np.diff(s[at], prepend=-1) != 0]
        if not len(at):
            break
        alive[ahead[a[at]]] = False
        ahead[a[at]] = b[at]
        moved = np.zeros(len(length), bool)
        moved[s[at]] = True
        keep = moved[s] & alive[a] & alive[np.minimum(b, n)] & (ahead[a] < b)
        a, b, s = a[keep], b[keep], s[keep]
    return ahead


def _merge_one(start: np.ndarray, end: np.ndarray, rank: np.ndarray, ahead: np.ndarray, alive: np.ndarray) -> None:
    """The same for one long segment, with a queue."""
    known = {(int(a), int(b)): int(c) for a, b, c in zip(start, end, rank, strict=True)}
    first, last = int(start.min()), int(end.max())
    before = {p: p - 1 for p in range(first, last + 1)}
    queue = [(c, a, b) for (a, b), c in known.items() if b - a == 2]
    heapq.heapify(queue)
    while queue:
        _, a, b = heapq.heappop(queue)
        middle = int(ahead[a])
        if not alive[a] or middle >= b or ahead[middle] != b:
            continue
        alive[middle] = False
        ahead[a] = b
        before[b] = a
        for x, y in ((before[a], b), (a, int(ahead[b]) if b < len(ahead) else b)):
            if x >= first and (x, y) in known and (x < a or y > b):
                heapq.heappush(queue, (known[x, y], x, y))


def relax_paths(
    start: np.ndarray, end: np.ndarray, score: np.ndarray, offset: np.ndarray, n: int, unknown: float
) -> np.ndarray:
    """The same for a unigram model: best paths, from each segment's first place to its last.

    ``offset`` is each place's distance from the start of its segment. A character that no piece
    covers alone costs ``unknown``.
    """
    single = np.zeros(n, bool)
    single[start[end - start == 1]] = True
    lone = np.flatnonzero(~single)
    start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
    score = np.concatenate([score, np.full(len(lone), unknown)])
    reach = offset[start] + (end - start)
    order = np.lexsort((start, end, reach))
    start, end, score, reach = start[order], end[order], score[order], reach[order]
    best, back = np.zeros(n + 1), np.arange(-1, n)
    total = np.zeros(n + 1)
    for k in range(1, int(reach.max(initial=0)) + 1):
        lo, hi = np.searchsorted(reach, [k, k + 1])
        s, e = start[lo:hi], end[lo:hi]
        value = np.where(offset[s] == 0, 0.0, best[s]) + score[lo:hi]
        first = np.flatnonzero(np.diff(e, prepend=-1))
        most = np.maximum.reduceat(value, first)
        top = np.flatnonzero(value == np.repeat(most, np.diff(np.append(first, len(e)))))
        top = top[np.diff(e[top], prepend=-1) != 0]
        total[e[first]] = most
        best[e[first]] = most
        back[e[top]] = s[top]
    return back


def fresh_ids(model: Model, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of different segments, in texts of a bounded size (or one long segment)."""
    reach = np.cumsum([len(x) + 1 for x in parts])
    done, low = [], 0
    while low < len(parts):
        base = reach[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(reach, base + INDEXED, "right")))
        done.append(_indexed_ids(model, parts[low:high]))
        low = high
    ids, sizes = zip(*done, strict=True) if done else ((), ())
    return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])


def _indexed_ids(model: Model, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in parts], np.int64)
    text = "\0".join(parts) + "\0"  # the end of a segment is a place that no piece covers
    codes = model.coded(text)
    segment = np.repeat(np.arange(len(parts), dtype=np.int32), length + 1)
    begin = np.cumsum(length + 1) - length - 1
    codes[begin + length] = 0
    n = len(codes)
    start, piece = edges(model, codes)
    end = start + model.lengths[piece].astype(np.int32)
    inner = np.ones(n, bool)
    inner[begin + length] = False
    if model.kind == BPE:
        ahead = relax_merges(start, end, model.ranks[piece], segment[start], length, n)
        first = _walk(ahead, begin, begin + length)
    else:
        offset = np.arange(n) - begin[segment]
        back = relax_paths(start, end, model.scores[piece], offset, n, float(model.scores.min(initial=0)) - 10)
        ahead = np.arange(1, n + 2)
        at, low = begin + length, begin
        while True:
            open_ = at > low
            if not open_.any():
                break
            at, low = at[open_], low[open_]
            ahead[back[at]] = at
            at = back[at]
        first = _walk(ahead, begin, begin + length)
    # A symbol's piece is that of its edge; symbols without one are single unknown characters.
    chosen = np.zeros(n + 1, np.int64)
    chosen[first] = ahead[first]
    at = np.full(n + 1, -1, np.int64)
    own = chosen[start] == end
    at[start[own]] = model.ids[piece[own]]
    ids = at[first]
    owner = segment[first]
    if (ids < 0).any():
        ids, owner = _unknown(model, text, ids, first, owner)
    return ids.astype(np.uint32), np.bincount(owner, minlength=len(parts))


def _walk(ahead: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The starts of all symbols, in order."""
    at, out = begin[begin < end], []
    end = end[begin < end]
    while len(at):
        out.append(at)
        at = ahead[at]
        at, end = at[at < end], end[at < end]
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _unknown(model: Model, text: str, ids: np.ndarray, first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unknown characters as their bytes, or each run of them as one unknown id."""
    lone = ids < 0
    if not model.fallback:
        again = np.zeros(len(ids), bool)
        again[1:] = lone[1:] & lone[:-1] & (owner[1:] == owner[:-1])
        ids = np.where(lone, model.unknown, ids)
        return ids[~again], owner[~again]
    raw = [text[p].encode("utf-8", "replace") for p in first[lone]]
    times = np.ones(len(ids), np.int64)
    times[lone] = [len(x) for x in raw]
    out = np.repeat(ids, times)
    out[out < 0] = model.bytes[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.repeat(owner, times)


class PartEncoder(dict):
    """Ids of texts; each different part of a text is encoded once, all new ones of a batch together."""

    def __init__(self, split: Callable[[str], list[str]], fresh_ids: Callable[[list[str]], tuple]):
        super().__init__()
        self.split, self.fresh_ids = split, fresh_ids
        self.fresh: list[str] = []
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids = np.zeros(0, np.uint32)
        self.sizes = np.zeros(0, np.int64)

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        self.fresh.append(part)
        return number

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each document."""
        if len(self) > CACHED_SEGMENTS:
            self.forget()
        parts = [self.split(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        if self.fresh:
            ids, sizes = self.fresh_ids(self.fresh)
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.fresh = []
        sizes, first = self.sizes[at], (np.cumsum(self.sizes) - self.sizes)[at]
        ids = gather(self.ids, first, sizes)
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(edges)


def by_size(batch: pa.RecordBatch, at: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text in column ``at``, at least a row each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


# --- operators ---------------------------------------------------------------------------------


def encoder(path: str) -> PartEncoder:
    model = load(path)
    return PartEncoder(
        lambda text: model.segments.findall(model.library.normalize(text)), lambda parts: fresh_ids(model, parts)
    )


def texts_of(m: Model, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of documents with ``counts`` ids each."""
    raw = gather(m.shown, m.shown_first[ids], m.shown_sizes[ids]).tobytes()
    at = np.concatenate([[0], np.cumsum(m.shown_sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
    texts = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        a += bool(m.prefix and raw[a : a + 1] == b" " and b > a)
        texts.append(raw[a:b].decode("utf-8", "replace"))
    return texts


def encode(
    docs: DataFrame, model: str, text: str = "text", keep_text: bool = True, decoded: str | None = None
) -> DataFrame:
    """Adds ``ids`` (little-endian 32-bit words) of every whole text; null counts as empty.

    With ``decoded`` a column of that name holds the text of the ids again. An empty text has no
    ids. Repeated rows are kept. Added columns get underscores before a name that is taken. An empty
    table gives an empty table.
    """
    at = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]
    fields = [docs.schema.fields[i] for i in kept]
    fields.append(T.StructField(free_name("ids", docs.columns), T.BinaryType()))
    if decoded:
        fields.append(T.StructField(free_name(decoded, docs.columns), T.StringType()))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            for own in by_size(batch, at):
                ids, counts = coder.encode(own.column(at).cast(pa.string()).to_pylist())
                columns = [*(own.column(i) for i in kept), binaries(ids.astype("<u4"), counts)]
                if decoded:
                    columns.append(pa.array(texts_of(load(model), ids, counts), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of the ids. Null ids give a null."""
    at = rows.columns.index(ids)
    name = free_name(text, rows.columns)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            for own in by_size(batch, at):
                column = own.column(at)
                raw = np.frombuffer(b"".join(column.fill_null(b"").to_pylist()), "<u4")
                counts = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) // 4
                texts = texts_of(m, raw, counts.astype(np.int64))
                found = pa.array(texts, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*own.columns, found], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
