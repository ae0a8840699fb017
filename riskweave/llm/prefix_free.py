"""Removal of repeated byte strings by a prefix-free parse of the corpus.

A rolling hash triggers phrase bounds: a place is a bound where the hash of the eight bytes from
there is the least of some 64 places in a row (all of them, on ties). A bound depends on the 63
places before and behind it alone, and bounds are at most 64 apart, so that any string of 200 bytes
has one at an offset from 63 to 126 that nothing around the string can change. The first such bound
is the string's anchor; equal strings have it at one offset. Every string of an anchor holds the
phrases next to it (its *context*), and all of them together span one stretch (its *reach*).

Dictionary and parse are then put in one order across the corpus, by fingerprint, as only equality
up to 200 bytes matters: first the contexts, then the reaches within a context. A context found
once ends the matter for all its strings. A reach found twice settles all its strings at once.
Only strings of a context that has different reaches (where a repeat begins or ends) are compared
one by one, by 128 bits, and each different reach sends them once a piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskweave.llm.common import free_name, partitions
from riskweave.llm.pieces import (
    SENT,
    Distinct,
    Piece,
    answered,
    covered,
    cut,
    each_piece,
    exchange,
    grams,
    joint,
    mix,
    other_fields,
    sent,
    with_marks,
)

GRAM = 8


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def bounds(body: np.ndarray, width: int) -> np.ndarray:
    """Phrase bounds of a text."""
    if len(body) < GRAM + width - 1:
        return np.zeros(0, np.int64)
    a = body.astype(np.uint64)
    for step in (1, 2, 4):
        a = a[:-step] | (a[step:] << np.uint64(8 * step))
    grams = (mix(a) >> np.uint64(32)).astype(np.uint32)
    least = _slide(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint32)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == grams)


class Parse:
    """The anchors of one piece, with the strings that each stands for."""

    def __init__(self, piece: Piece, length: int):
        self.piece, self.length = piece, length
        width = (length - GRAM + 1) // 3
        lead = width - 1  # so far behind a string's start, no byte before it has a say in a bound
        own = bounds(piece.body, width)
        before = np.concatenate([[-(1 << 40)], own[:-1]]) if len(own) else own
        doc = np.searchsorted(piece.ends, own, "right")
        begin = np.concatenate([[0], piece.ends])[doc]
        end = np.concatenate([piece.ends, [0]])[doc] - 1  # the line feed is not the text's
        first = np.maximum(np.maximum(before - lead + 1, begin), own - lead - width)
        last = np.minimum(own - lead, end - length)
        full = first <= last
        self.anchor, self.first, self.last = own[full], first[full], last[full]
        self.lead, self.width = lead, width
        self.lanes = [grams(piece.body, 0)]

    def contexts(self) -> Distinct:
        """Fingerprints of the context and of the reach of every anchor."""
        a, windows = self.anchor, self.lanes[0]
        context = windows.at(a - self.lead, self.length - self.width)
        place = ((a - self.first) << 32 | (a - self.last)).astype(np.uint64)
        ends = joint(windows.at(self.first, self.length), windows.at(self.last, self.length))
        reach = mix(ends ^ mix(place))
        return Distinct(context, reach)

    def strings(self, chosen: np.ndarray) -> np.ndarray:
        """Starts of all strings of the chosen anchors."""
        first, count = self.first[chosen], (self.last - self.first + 1)[chosen]
        shift = np.cumsum(count) - count
        return np.repeat(first - shift, count) + np.arange(int(count.sum()))

    def compared(self, at: np.ndarray) -> Distinct:
        if len(self.lanes) == 1:
            self.lanes.append(grams(self.piece.body, 1))
        return Distinct(*[x.at(at, self.length) for x in self.lanes])


def judge_contexts(lanes: list[np.ndarray], several: np.ndarray) -> list[np.ndarray]:
    """For each (context, reach): whether it repeats as it is, and whether its strings are wanted."""
    order = np.lexsort(lanes[::-1])
    context, reach = lanes[0][order], lanes[1][order]
    new_context = np.ones(len(order), bool)
    new_context[1:] = context[1:] != context[:-1]
    new_reach = new_context.copy()
    new_reach[1:] |= reach[1:] != reach[:-1]
    in_context, in_reach = np.cumsum(new_context) - 1, np.cumsum(new_reach) - 1
    weight = 1 + several[order]
    settled = np.bincount(in_reach, weight)[in_reach] > 1
    mixed = np.bincount(in_context, new_reach)[in_context] > 1
    out = []
    for flag in (settled, mixed & new_reach):
        back = np.empty(len(order), bool)
        back[order] = flag
        out.append(back)
    return out


def remove_repeated_strings(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """Removes each byte that lies in a string of ``length`` bytes found at two places or more.

    Strings are judged on the input, anywhere in it, the same document included (overlaps count);
    they never cross documents. Returns the other columns and, with underscores put before a name
    that is taken: ``kept`` (binary: a cut may part a character), ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs) and ``spans`` (their start and end).

    A null text counts as empty; a text shorter than ``length`` keeps all. Repeated rows are
    documents of their own, so equal long rows lose all bytes. An empty table gives an empty table.
    """
    if length < 100:
        raise ValueError("length must be at least 100: shorter strings may lack an anchor's context")
    pieces, buckets = cut(docs, text), 4 * partitions(docs.sparkSession)
    others = other_fields(docs, text)

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in each_piece(batches):
            yield sent(piece, 0, Parse(piece, length).contexts(), buckets)

    contexts = exchange(pieces.mapInArrow(send_contexts, SENT), 2, judge_contexts)

    def send_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in each_piece(batches):
            parse = Parse(piece, length)
            _, wanted = answered(piece, 0, parse.contexts(), buckets, 2)
            yield sent(piece, 1, parse.compared(parse.strings(wanted)), buckets)

    strings = exchange(with_marks(pieces, contexts).mapInArrow(send_strings, SENT), 2)

    names = [f.name for f in others]
    added = {}
    for name, kind in (
        ("kept", T.BinaryType()),
        ("n_bytes", T.LongType()),
        ("n_removed", T.LongType()),
        ("n_spans", T.LongType()),
        ("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ):
        added[name] = T.StructField(free_name(name, names), kind)
    schema = T.StructType([*others, *added.values()])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in each_piece(batches):
            parse = Parse(piece, length)
            settled, wanted = answered(piece, 0, parse.contexts(), buckets, 2)
            at = parse.strings(wanted)
            (found,) = answered(piece, 1, parse.compared(at), buckets)
            at = at[found]
            gone = covered(
                np.concatenate([parse.first[settled], at]),
                np.concatenate([parse.last[settled], at]) + length,
                len(piece.body),
            )
            yield pa.RecordBatch.from_arrays(
                [*piece.carried(len(others)), *_cut_out(piece, gone)], names=schema.fieldNames()
            )

    return with_marks(pieces, contexts, strings).mapInArrow(finish, schema)


def _cut_out(piece: Piece, gone: np.ndarray) -> list[pa.Array]:
    ends = piece.ends
    kept = ~gone
    kept[ends - 1] = False
    raw = piece.body[kept].tobytes()
    at = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    starts, stops = edges[0::2], edges[1::2]  # the line feed between documents parts their runs
    begin = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(starts, np.concatenate([begin, ends[-1:]]))
    base = begin[np.searchsorted(ends, starts, "right")]
    pairs = np.stack([starts - base, stops - base], 1).ravel()
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(pairs) + 1, 2, dtype=np.int32)), pa.array(pairs))
    size = ends - begin - 1
    return [
        pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
        pa.array(size),
        pa.array(size - np.diff(at)),
        pa.array(np.diff(first).astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), inner),
    ]
