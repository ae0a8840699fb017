"""Phrases that hold together, by weighted acyclic automata of n-grams.

Texts become shards of word numbers; the words of all shards are counted, and the frequent ones
numbered, in ranges of a hash of their letters. A shard then turns its sorted n-grams into count transducers, one
for each range of prefixes (the first two words); the transducers of a range are united with their
counts summed. Each shard hears which of its n-grams are frequent, so that at the next length only
stretches of frequent n-grams are left: a phrase is never more frequent than any part of it, so
nothing is lost. Counts of the parts of a phrase come from composing the parts with the united
transducers of their ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import partitions, stored
from riskweave.llm.pieces import LANES, PIECE_BITS, mix
from riskweave.llm.transducers import Distinct, Transducer, spread, union

#: Bytes of text in a shard (a longer stretch without a break is one shard), words between two
#: samples of prefixes, and bytes of n-grams that a range may hold.
SHARD_BYTES, STRIDE, RANGE_BYTES = 4 << 20, 199, 32 << 20
LONGEST, LEAST, FIRST = 5, 100, 2000

#: A-Z become a-z, breaks line feeds, tabs spaces.
BREAKS = [bytes([x]) for x in b".,;:!?\n\x0b\x0c\r"]
PLAIN = bytes(10 if bytes([x]) in BREAKS else 32 if x == 9 else x + 32 if 65 <= x <= 90 else x for x in range(256))


# --- shards ------------------------------------------------------------------------------------


class Words:
    """Words one after the other, and the place of each in the order of a hash of its letters. The
    order says where words meet, not which words are equal."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray):
        self.letters, self.sizes = letters, sizes
        self.ends = np.cumsum(sizes)
        self.begin = self.ends - sizes

    def spots(self) -> np.ndarray:
        if not len(self.sizes):
            return np.zeros(0, np.uint32)
        inner = np.arange(len(self.letters)) - np.repeat(self.begin, self.sizes)
        weighed = LANES[0][self.letters] * LANES[1][inner & 255]
        return (mix(np.add.reduceat(weighed, self.begin)) >> np.uint64(32)).astype(np.uint32)

    def take(self, order: np.ndarray) -> Words:
        return Words(self.letters[spread(self.begin[order], self.sizes[order])], self.sizes[order])

    def between(self, a: int, b: int) -> Words:
        return Words(self.letters[self.begin[a] : self.ends[b - 1]], self.sizes[a:b])

    def pack(self) -> bytes:
        head = np.array([len(self.sizes)], np.int64).tobytes()
        return head + self.sizes.astype(np.uint32).tobytes() + self.letters.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Words:
        (size,) = np.frombuffer(raw, np.int64, 1)
        sizes = np.frombuffer(raw, np.uint32, size, 8).astype(np.int64)
        return cls(np.frombuffer(raw, np.uint8, -1, 8 + 4 * int(size)), sizes)

    def arrow(self) -> pa.Array:
        offsets = np.concatenate([[0], self.ends]).astype(np.int64)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.letters))]
        return pa.Array.from_buffers(pa.large_binary(), len(self.sizes), buffers)


def numbered(body: bytes) -> tuple[Words, np.ndarray, np.ndarray]:
    """Different words, their counts, and the word numbers in order (from 1; 0 is a break)."""
    raw = np.frombuffer(body.translate(PLAIN) + b"\n", np.uint8)
    inside = (raw != 32) & (raw != 10)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = edge[0::2], edge[1::2]
    coded = Words(raw[inside], ends - starts).arrow().dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    held = coded.dictionary
    offsets = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, 8 * held.offset)
    letters = np.frombuffer(held.buffers()[2] or b"", np.uint8)[: offsets[-1] if len(held) else 0]
    words = Words(letters, np.diff(offsets))
    order = np.argsort(words.spots(), kind="stable")
    turned = np.empty(len(order), np.int64)
    turned[order] = np.arange(len(order))
    line = np.cumsum(raw == 10)[starts]
    turn = np.zeros(len(starts), np.int64)
    turn[1:] = line[1:] != line[:-1]
    out = np.zeros(len(starts) + int(turn.sum()), np.uint32)
    out[np.arange(len(starts)) + np.cumsum(turn)] = turned[numbers] + 1
    return words.take(order), np.bincount(turned[numbers], minlength=len(order)).astype(np.int64), out


def cut(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text in parts that end at breaks, so that no phrase is cut."""
    at = 0
    while len(text) - at > limit:
        end = max(text.rfind(x, at, at + limit) for x in BREAKS)
        if end < 0:
            end = min((x for x in (text.find(x, at + limit) for x in BREAKS) if x >= 0), default=len(text) - 1)
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


SHARDS = "shard long, lang string, n long, words binary, counts binary, numbers binary"


def shards(docs: DataFrame, lang: str, text: str, limit: int = SHARD_BYTES) -> DataFrame:
    known = F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")
    plain = docs.select(known, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << PIECE_BITS
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, size
            for name, parts in held.items():
                words, counts, numbers = numbered(b"\n".join(parts))
                if len(counts):
                    blobs = (words.pack(), counts.astype(np.uint32).tobytes(), numbers.tobytes())
                    columns = [pa.array([shard], pa.int64()), pa.array([name]), pa.array([int(counts.sum())], pa.int64())]
                    columns += [pa.array([x], pa.binary()) for x in blobs]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "n", "words", "counts", "numbers"])
                    shard += 1
            held.clear()
            size = 0

        for batch in batches:
            names, bodies = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
            for name, body in zip(names, bodies, strict=True):
                for part in cut(body, limit):
                    held.setdefault(name, []).append(part)
                    size += len(part) + 1
                    if size >= limit:
                        yield from flush()
        yield from flush()

    return stored(plain.mapInArrow(pack, SHARDS), "shards", "shard")


# --- the alphabet ------------------------------------------------------------------------------

SPELLED = "range int, shard long, lang string, words binary, counts binary"
ALPHABET = "range int, shard long, ranks binary, lang string, word string, f long, rank int"


def spot_ranges(words: Words, parts: int) -> list[tuple[int, int, int]]:
    """Range, from and to, of words in the order of their spots."""
    place = words.spots().astype(np.int64) * parts >> 32
    bounds = np.searchsorted(place, np.arange(parts + 1))
    return [(int(k), int(bounds[k]), int(bounds[k + 1])) for k in np.flatnonzero(np.diff(bounds))]


def alphabet(whole: DataFrame, parts: int, least: int) -> DataFrame:
    """Frequent words by range and rank in it (``shard`` null), and for each shard and range the
    rank of each of the shard's words there, from 1; 0 for a word that is not frequent."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, counts = Words.unpack(words), np.frombuffer(counts, np.uint32)
                out = spot_ranges(words, parts)
                columns = [
                    pa.array([k for k, _, _ in out], pa.int32()),
                    pa.array([shard] * len(out), pa.int64()),
                    pa.array([lang] * len(out), pa.string()),
                    pa.array([words.between(a, b).pack() for _, a, b in out], pa.binary()),
                    pa.array([counts[a:b].tobytes() for _, a, b in out], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "shard", "lang", "words", "counts"])

    def settle(rows: pa.Table) -> pa.Table:
        place = rows.column("range")[0].as_py()
        tongues, replies, known, base = rows.column("lang").to_pylist(), [], [], 0
        for lang in sorted(set(tongues)):
            own = rows.filter(pa.array([x == lang for x in tongues]))
            listed = [Words.unpack(x) for x in own.column("words").to_pylist()]
            both = Words(np.concatenate([x.letters for x in listed]), np.concatenate([x.sizes for x in listed]))
            coded = both.arrow().dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            totals = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(totals, at, np.concatenate([np.frombuffer(x, np.uint32) for x in own.column("counts").to_pylist()]))
            often = totals >= least
            ranks = np.where(often, base + np.cumsum(often), 0).astype(np.uint32)
            base += int(often.sum())
            found = coded.dictionary.filter(pa.array(often)).cast(pa.binary()).cast(pa.string())
            known.append((lang, found, totals[often], ranks[often].astype(np.int32)))
            each = np.split(ranks[at], np.cumsum([len(x.sizes) for x in listed])[:-1])
            for shard, told in zip(own.column("shard").to_pylist(), each, strict=True):
                if told.any():
                    replies.append((shard, told.tobytes()))
        named = sum(len(k[1]) for k in known)
        size = len(replies) + named

        def column(first: list, kind: pa.DataType, last: list) -> pa.ChunkedArray:
            head = pa.array(first if first is not None else [None] * len(replies), kind)
            return pa.chunked_array([head, *(last if last is not None else [pa.nulls(named, kind)])], kind)

        return pa.table(
            {
                "range": pa.array([place] * size, pa.int32()),
                "shard": column([r[0] for r in replies], pa.int64(), None),
                "ranks": column([r[1] for r in replies], pa.binary(), None),
                "lang": column(None, pa.string(), [pa.array([k[0]] * len(k[1]), pa.string()) for k in known]),
                "word": column(None, pa.string(), [k[1] for k in known]),
                "f": column(None, pa.int64(), [pa.array(k[2]) for k in known]),
                "rank": column(None, pa.int32(), [pa.array(k[3]) for k in known]),
            }
        )

    sent = whole.select("shard", "lang", "words", "counts").mapInArrow(send, SPELLED)
    return stored(sent.groupBy("range").applyInArrow(settle, ALPHABET), "alphabet")


# --- sequences of frequent words -----------------------------------------------------------------

CODED = "shard long, numbers binary"


def stretches(numbers: np.ndarray, alive: np.ndarray, width: int) -> np.ndarray:
    """What longer phrases can be in: where windows of ``width`` words that are ``alive`` begin at
    two or more places in a row. A 0 follows each stretch."""
    edge = np.diff(np.concatenate([[0], alive.astype(np.int8), [0]]))
    begin, sizes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = sizes - begin
    begin, sizes = begin[sizes > 1], sizes[sizes > 1] + width  # one place more, for the 0
    if not len(begin):
        return numbers[:0]
    out = numbers[np.minimum(spread(begin, sizes), len(numbers) - 1)]
    out[np.cumsum(sizes) - 1] = 0
    return out


class Grams:
    """The different n-grams of a shard in order, and where the windows begin."""

    def __init__(self, raw: bytes, length: int):
        self.numbers = np.frombuffer(raw, np.uint32)
        size = max(len(self.numbers) - length + 1, 0)
        whole = np.ones(size, bool)
        for d in range(length):
            whole &= self.numbers[d : d + size] != 0
        self.at = np.flatnonzero(whole)
        self.distinct = Distinct(np.stack([self.numbers[self.at + d] for d in range(length)], 1))


def ranges(rows: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int]]:
    """Range of prefixes, from and to, of rows in ascending order."""
    key = rows[:, 0].astype(np.int64) << 32
    if rows.shape[1] > 1:
        key |= rows[:, 1]
    bounds = np.concatenate([[0], np.searchsorted(key, cuts), [len(key)]])
    full = np.flatnonzero(np.diff(bounds))
    return [(int(b), int(bounds[b]), int(bounds[b + 1])) for b in full]


SENT = "range int, shard long, blob binary"
SETTLED = "range int, shard long, bits binary, united binary"


def settled(coded: DataFrame, length: int, cuts: np.ndarray, least: int) -> DataFrame:
    """For each range the transducer of frequent n-grams, and for each shard which of its own are."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                grams = Grams(raw, length)
                rows, counts = grams.distinct.rows, grams.distinct.counts()
                parts = [(k, Transducer.build(rows[a:b], counts[a:b]).pack()) for k, a, b in ranges(rows, cuts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in parts], pa.int32()),
                        pa.array([shard] * len(parts), pa.int64()),
                        pa.array([x for _, x in parts], pa.binary()),
                    ],
                    names=["range", "shard", "blob"],
                )

    def settle(rows: pa.Table) -> pa.Table:
        owners, place = rows.column("shard").to_pylist(), rows.column("range")[0].as_py()
        both, totals, sizes = union([Transducer.unpack(x) for x in rows.column("blob").to_pylist()], length)
        often = totals >= least
        flags, at, out = often[both.back], 0, []
        for shard, size in zip(owners, sizes, strict=True):
            own = flags[at : at + size]
            at += size
            if own.any():
                out.append((place, shard, np.packbits(own).tobytes(), None))
        if often.any():
            out.append((place, None, None, Transducer.build(both.rows[often], totals[often]).pack()))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = pa.int32(), pa.int64(), pa.binary(), pa.binary()
        names = ["range", "shard", "bits", "united"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return stored(coded.mapInArrow(send, SENT).groupBy("range").applyInArrow(settle, SETTLED), f"grams_{length}")


def narrowed(coded: DataFrame, known: DataFrame, length: int, cuts: np.ndarray) -> DataFrame:
    """The shards' stretches of frequent n-grams."""
    bits = known.where("bits IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("range", "bits")).alias("bits"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = (batch.column(n).to_pylist() for n in ("shard", "numbers", "bits"))
            for shard, raw, told in zip(*lists, strict=True):
                grams, heard = Grams(raw, length), {x["range"]: x["bits"] for x in told}
                often = np.zeros(len(grams.distinct), bool)
                for k, a, b in ranges(grams.distinct.rows, cuts):
                    if k in heard:
                        often[a:b] = np.unpackbits(np.frombuffer(heard[k], np.uint8), count=b - a)
                alive = np.zeros(len(grams.numbers), bool)
                alive[grams.at] = often[grams.distinct.back]
                left = stretches(grams.numbers, alive, length)
                if len(left):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int64()), pa.array([left.tobytes()], pa.binary())], names=["shard", "numbers"]
                    )

    return stored(coded.join(bits, "shard").mapInArrow(narrow, CODED), "coded", "shard")


# --- counts of parts -----------------------------------------------------------------------------

ASKED = "range int, cover boolean, length int, source long, blob binary"
HELD = "range int, length int, blob binary"
TOLD = "source long, cover boolean, length int, range int, numbers binary"
PARTS = "numbers array<long>, a long, cuts array<struct<k:int,l:long,r:long>>, covered boolean"


def _source(length: int, place: int) -> int:
    return length << 32 | place


def parts_of(rows: np.ndarray) -> dict[int, Distinct]:
    """The different proper prefixes and suffixes of phrases of one length, by their length."""
    length = rows.shape[1]
    return {n: Distinct(np.concatenate([rows[:, :n], rows[:, length - n :]])) for n in range(1, length)}


def with_parts(words: DataFrame, grams: dict[int, DataFrame], cuts: np.ndarray, within: int) -> DataFrame:
    """Frequent phrases with the counts of their parts, and whether a longer one covers them: its
    count is at least ``within`` hundredths of theirs."""

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.argsort(rows)
            rows, counts = rows[order].astype(np.uint32).reshape(-1, 1), counts[order]
            for k, a, b in ranges(rows, cuts):
                blob = Transducer.build(rows[a:b], counts[a:b]).pack()
                columns = [pa.array([k], pa.int32()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "length", "blob"])

    phrases = None
    for n, known in grams.items():
        own = known.where("united IS NOT NULL").select("range", F.lit(n).alias("length"), F.col("united").alias("blob"))
        phrases = own if phrases is None else phrases.unionByName(own)
    held = phrases.unionByName(words.select("number", "f").mapInArrow(lone, HELD))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, length, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, counts = Transducer.unpack(blob).rows()
                own, out = _source(length, place), []

                def to(part: Distinct, values: np.ndarray, cover: bool) -> None:
                    for k, a, b in ranges(part.rows, cuts):
                        blob = Transducer.build(part.rows[a:b], values[a:b]).pack()
                        out.append((k, cover, part.rows.shape[1], own, blob))  # noqa: B023

                for part in parts_of(rows).values():
                    to(part, np.zeros(len(part), np.int64), False)
                if length > 2:
                    inner = Distinct(np.concatenate([rows[:, :-1], rows[:, 1:]]))
                    to(inner, inner.reduced(np.concatenate([counts, counts]), np.maximum), True)
                kinds = pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.binary()
                names = ["range", "cover", "length", "source", "blob"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not known.num_rows:
            raise ValueError("a part of a frequent phrase is not frequent")
        place = known.column("range")[0].as_py()
        listed: dict[int, list[Transducer]] = {}
        for n, blob in zip(known.column("length").to_pylist(), known.column("blob").to_pylist(), strict=True):
            listed.setdefault(n, []).append(Transducer.unpack(blob))
        own: dict[int, Transducer] = {}
        for n, found in listed.items():
            if len(found) > 1:  # single words come in batches
                both, totals, _ = union(found, n)
                found = [Transducer.build(both.rows, totals)]
            own[n] = found[0]
        out, covers = [], {}
        lists = (asked.column(c).to_pylist() for c in ("cover", "length", "source", "blob"))
        for cover, n, source, blob in zip(*lists, strict=True):
            wanted = Transducer.unpack(blob)
            if cover:
                covers.setdefault(n, []).append(wanted)
            else:
                out.append((source, False, n, place, own[n].compose(wanted.rows()[0]).tobytes()))
        for n, found in covers.items():
            listed_rows = [x.rows() for x in found]
            inner = Distinct(np.concatenate([r for r, _ in listed_rows]))
            most = inner.reduced(np.concatenate([c for _, c in listed_rows]), np.maximum)
            rows, counts = own[n].rows()
            longer = Transducer.build(inner.rows, most).compose(rows)
            covered = (longer > 0) & (100 * longer.astype(object) >= within * counts.astype(object))
            out.append((_source(n, place), True, n, place, covered.astype(np.int64).tobytes()))
        columns = list(zip(*out, strict=True)) or [(), (), (), (), ()]
        kinds = pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()
        names = ["source", "cover", "length", "range", "numbers"]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})

    asked = phrases.select("range", "length", "blob").mapInArrow(ask, ASKED)
    told = stored(asked.groupBy("range").cogroup(held.groupBy("range")).applyInArrow(answer, TOLD), "parts")
    told = told.groupBy("source").agg(F.collect_list(F.struct("cover", "length", "range", "numbers")).alias("told"))
    source = F.shiftleft(F.col("length").cast("long"), 32).bitwiseOR(F.col("range").cast("long"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = (batch.column(n).to_pylist() for n in ("length", "blob", "told"))
            for length, blob, answers in zip(*lists, strict=True):
                rows, counts = Transducer.unpack(blob).rows()
                heard = {(x["cover"], x["length"], x["range"]): np.frombuffer(x["numbers"], np.int64) for x in answers}
                left, right = {}, {}
                for n, part in parts_of(rows).items():
                    found = np.concatenate([heard[False, n, k] for k, _, _ in ranges(part.rows, cuts)])[part.back]
                    left[n], right[length - n] = found[: len(rows)], found[len(rows) :]
                cover = next((v for (c, _, _), v in heard.items() if c), np.zeros(len(rows), np.int64))
                out = [
                    {
                        "numbers": rows[i].tolist(),
                        "a": int(counts[i]),
                        "cuts": [{"k": k, "l": int(left[k][i]), "r": int(right[k][i])} for k in range(1, length)],
                        "covered": bool(cover[i]),
                    }
                    for i in range(len(rows))
                ]
                cut_ = pa.struct([("k", pa.int32()), ("l", pa.int64()), ("r", pa.int64())])
                kinds = [("numbers", pa.list_(pa.int64())), ("a", pa.int64()), ("cuts", pa.list_(cut_)), ("covered", pa.bool_())]
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return phrases.withColumn("source", source).join(told, "source").mapInArrow(finish, PARTS)


# --- the operator ----------------------------------------------------------------------------------

RANKED = "lang string, rank int, phrase string, a long, l long, r long, n long, score long"


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    first: int = FIRST,
    within: int = 100,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The first phrases of each language by how far their parts hold together.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line ends, and those into
    words at spaces and tabs. ``n`` counts the words of a language, ``a`` a phrase of two to
    ``longest`` words within pieces (overlaps count). Phrases with ``a >= least`` are candidates. A
    candidate's score is the least ``floor(1000 * a * n / (l * r))`` over its cuts into parts found
    ``l`` and ``r`` times (ties to the earliest cut). A candidate inside a longer one with
    ``100 * f(longer) >= within * a`` is left out. Returns ``lang``, ``rank``, ``phrase``, ``a``,
    ``l``, ``r``, ``n`` and ``score`` of the first ``first`` of each language by score and ``a``
    descending and phrase ascending.

    A null language is ``und``, a null text is empty. Texts without words add nothing; repeated rows
    count each time. Long texts are read whole, in shards that end at breaks. Arithmetic is exact up
    to 38 digits and at most 2**31 - 2 different frequent words (an error beyond). Other columns
    are not read. A table without candidates gives an empty table.
    """
    spark = docs.sparkSession
    whole = shards(docs, lang, text, shard_bytes)
    spoken = whole.groupBy("lang").agg(F.sum("n").alias("n"))
    held = whole.agg(F.sum(F.octet_length("words") + F.octet_length("counts"))).first()[0] or 0
    parts = int(max(partitions(spark), -(-held // RANGE_BYTES)))
    known = alphabet(whole, parts, least)
    # Numbers are ranks after those of the ranges before: one row a range.
    sizes = {r[0]: r[1] for r in known.where("shard IS NULL").groupBy("range").count().collect()}
    begins = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(parts)])])
    if not sizes:
        return spark.createDataFrame([], RANKED)
    if begins[-1] >= 2**31 - 1:
        raise ValueError("more than 2**31 - 2 different frequent words")
    begin = spark.createDataFrame([(k, int(begins[k])) for k in sizes], "range int, begin long")
    words = known.where("shard IS NULL").join(begin, "range")
    words = words.select("lang", "word", "f", (F.col("begin") + F.col("rank")).alias("number"))
    named = known.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("range", "ranks")).alias("named"))

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, spelled, numbers, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, heard = Words.unpack(spelled), {x["range"]: x["ranks"] for x in told}
                table = np.zeros(len(own.sizes) + 1, np.uint32)
                for k, a, b in spot_ranges(own, parts):
                    if k in heard:
                        ranks = np.frombuffer(heard[k], np.uint32)
                        table[a + 1 : b + 1] = np.where(ranks > 0, ranks + np.uint32(begins[k]), 0)
                numbers = table[np.frombuffer(numbers, np.uint32)]
                left = stretches(numbers, numbers != 0, 1)
                if len(left):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int64()), pa.array([left.tobytes()], pa.binary())], names=["shard", "numbers"]
                    )

    told = whole.select("shard", "words", "numbers").join(named, "shard")
    coded = stored(told.mapInArrow(recode, CODED), "coded", "shard")
    cuts = prefix_cuts(coded)
    grams: dict[int, DataFrame] = {}
    for length in range(2, longest + 1):
        if length > 2:
            coded = narrowed(coded, grams[length - 1], length - 1, cuts)
        grams[length] = settled(coded, length, cuts, least)

    found = with_parts(words, grams, cuts, within).where("NOT covered")
    tongue = words.select(F.col("number").alias("head"), "lang").join(spoken, "lang")
    counted = found.withColumn("head", F.col("numbers")[0]).join(tongue, "head")
    score = F.expr(
        "transform(cuts, c -> struct((cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)))"
        " div (cast(c.l as decimal(19,0)) * cast(c.r as decimal(19,0))) AS score, c.k AS k, c.l AS l, c.r AS r))"
    )
    scored = counted.select("lang", "numbers", "a", "n", F.array_min(score).alias("cut"))
    by_score = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"))
    top = scored.withColumn("near", F.rank().over(by_score)).where(F.col("near") <= first)
    top = stored(top.withColumn("id", F.monotonically_increasing_id()), "top")
    letters = top.select("id", F.posexplode("numbers").alias("at", "number")).join(words.select("number", "word"), "number")
    spelt = letters.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = top.join(spelt, "id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def prefix_cuts(coded: DataFrame) -> np.ndarray:
    """Where ranges of prefixes begin, from every so many-th pair of words: as many as keep the pairs
    of a range small. The cuts decide where n-grams meet, not what is counted."""
    spark = coded.sparkSession
    held = coded.agg(F.sum(F.octet_length("numbers"))).first()[0] or 0

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("numbers").to_pylist():
                numbers = np.frombuffer(raw, np.uint32).astype(np.int64)
                key = (numbers[:-1] << 32 | numbers[1:])[(numbers[:-1] > 0) & (numbers[1:] > 0)]
                yield pa.RecordBatch.from_arrays([pa.array(key[::STRIDE])], names=["key"])

    parts = max(partitions(spark), -(-3 * held // RANGE_BYTES))
    keys = coded.select("numbers").mapInArrow(sample, "key long").repartitionByRange(int(parts), "key")
    least = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key")).collect()  # one row a range
    return np.array(sorted(r["key"] for r in least)[1:], np.int64)
