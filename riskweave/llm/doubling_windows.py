"""Substring dedup by level-wise doubling of repeated word windows."""

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
    Windows,
    Words,
    answered,
    covered,
    cut,
    each_piece,
    exchange,
    other_fields,
    sent,
    symbols,
    with_marks,
)

#: The first windows are at least this long: shorter ones repeat nearly everywhere.
FIRST = 6


def lengths(window: int) -> list[int]:
    """Window lengths, each at most twice the one before; the last is the wanted one."""
    out = [window]
    while out[0] >= 2 * FIRST:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Levels:
    """The candidates of one piece, length by length.

    A window can repeat at a length only if the two windows of the length before that cover it do.
    Only the last length decides; it is compared by 128 bits, the others by 64.
    """

    def __init__(self, piece: Piece, window: int):
        self.piece, self.chain = piece, lengths(window)
        self.words = Words(piece.body, piece.ends)
        self.left = self.words.left()
        self.windows = Windows(self.words.hashes)
        long_enough = np.repeat(self.words.counts >= window, self.words.counts)
        self.at = np.flatnonzero(long_enough & (self.left >= self.chain[0]))

    def rows(self, level: int) -> Distinct:
        length, at = self.chain[level], self.at
        lanes = [self.windows]
        if level + 1 == len(self.chain):
            lanes.append(Windows(symbols(self.words.ids, 1)))
        return Distinct(*[x.at(at, length) for x in lanes])

    def narrow(self, level: int, buckets: int) -> None:
        """Keeps what repeats at this level, then what may repeat at the next."""
        (found,) = answered(self.piece, level, self.rows(level), buckets)
        self.at = self.at[found]
        if level + 1 < len(self.chain):
            step = self.chain[level + 1] - self.chain[level]
            known = np.zeros(len(self.words) + 1, bool)
            known[self.at] = True
            fits = self.at[self.left[self.at] >= self.chain[level + 1]]
            self.at = fits[known[fits + step]]


def remove_repeated_windows(
    docs: DataFrame, text: str = "text", window: int = 35, rewrite: bool = True
) -> DataFrame:
    """Removes each word that lies in a window of ``window`` words found more than once.

    Windows are judged on the input, anywhere in it, the same document included; they never cross
    documents. Returns the other columns, the kept words joined by one space in ``text``, and
    ``n_words``, ``n_removed`` (underscores are put before a name that is taken). Words are longest
    runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.

    With ``rewrite`` off, a document that loses no word keeps its text as it is.

    A null, empty or blank text has no words and is returned as an empty text. A document shorter
    than the window keeps all. Repeated rows are documents of their own, so equal long rows lose
    their words in all copies. An empty table gives an empty table.
    """
    pieces, buckets = cut(docs, text), 4 * partitions(docs.sparkSession)
    others = other_fields(docs, text)
    last = len(lengths(window)) - 1
    marks: list[DataFrame] = []
    for level in range(last + 1):

        def send(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for piece in each_piece(batches):
                state = Levels(piece, window)
                for done in range(level):
                    state.narrow(done, buckets)
                yield sent(piece, level, state.rows(level), buckets)

        known = with_marks(pieces, *marks) if marks else pieces
        marks.append(exchange(known.mapInArrow(send, SENT), 2 if level == last else 1))

    names = [f.name for f in others] + [text]
    n_words, n_removed = free_name("n_words", names), free_name("n_removed", names)
    schema = T.StructType(
        [
            *others,
            T.StructField(text, T.StringType()),
            T.StructField(n_words, T.LongType()),
            T.StructField(n_removed, T.LongType()),
        ]
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in each_piece(batches):
            state = Levels(piece, window)
            for done in range(last + 1):
                state.narrow(done, buckets)
            gone = covered(state.at, state.at + window, len(state.words))
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[state.words.bounds], prepend=0)
            texts = joined(piece, state.words, ~gone)
            if not rewrite:
                raw, begin = piece.body.tobytes(), np.concatenate([[0], piece.ends[:-1]])
                spans = zip(begin, piece.ends, removed, texts, strict=True)
                texts = [t if n else raw[a : b - 1] for a, b, n, t in spans]
            texts = pa.array(texts, pa.binary()).cast(pa.string())
            columns = [
                *piece.carried(len(others)),
                texts,
                pa.array(state.words.counts.astype(np.int64)),
                pa.array(removed.astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return with_marks(pieces, *marks).mapInArrow(finish, schema)


def joined(piece: Piece, words: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one space."""
    body = piece.body.copy()
    starts, ends = words.starts[keep], words.ends[keep]
    body[ends] = 32  # a word ends before a blank, or before the line feed after its document
    taken = covered(starts, ends + 1, len(body))
    at = np.concatenate([[0], np.cumsum(taken)])[np.concatenate([[0], piece.ends])]
    raw = body[taken].tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]
