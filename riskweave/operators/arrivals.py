"""Activity of whole groups in one sorted pass, over two clocks (what had happened and had also
arrived) or over one.

A candidate sees the rows of earlier instants inside its span that arrived before it did. Rows of a
history group are ordered by time, by recipient and time, and by device and time; in each order the
span of a candidate is a range of places, and what is asked is how many places of the range hold an
arrival below the candidate's, or which is the first or last that does. Counts descend a bit matrix
of the arrival ranks (one level a bit), places descend a table of range minima. Each level is one
vector operation over all rows of many groups, so the work is rows times the logarithm of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskweave.functions.frames import HOUR, MINUTE
from riskweave.operators.history import ACTIVITY_SPAN, GROUP
from riskweave.operators.ranks import Ranks, codes
from riskweave.operators.rolling import BATCH_ROWS, time_lines

ROW_SPANS = {"n_activity": ACTIVITY_SPAN, "n_5m": 5 * MINUTE, "n_10m": 10 * MINUTE, "n_60m": HOUR}


class Minima:
    """Least rank of any range of places, and the first or last place with a rank below a bound."""

    def __init__(self, ranks: np.ndarray):
        self.rows = [ranks]
        width = 1
        while 2 * width <= len(ranks):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def any(self, first: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return self._walk(first, end, bound, ahead=True) < end

    def first(self, first: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first such place, or ``end``."""
        return np.minimum(self._walk(first, end, bound, ahead=True), np.maximum(end, first))

    def last(self, first: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last such place, or ``first - 1``."""
        return self._walk(first, end, bound, ahead=False) - 1

    def _walk(self, first: np.ndarray, end: np.ndarray, bound: np.ndarray, ahead: bool) -> np.ndarray:
        """Steps over blocks without such a place, from one side, largest block first."""
        at, stop = (first.copy(), end) if ahead else (np.maximum(end, first), first)
        for level in range(len(self.rows) - 1, -1, -1):
            width, row = 1 << level, self.rows[level]
            begin = at if ahead else at - width
            fits = (at + width <= stop) if ahead else (begin >= stop)
            least = row[np.clip(begin, 0, len(row) - 1)]
            at = np.where(fits & (least >= bound), at + (width if ahead else -width), at)
        return at


def known_activity(table: pa.Table, time: np.ndarray) -> dict[str, pa.Array]:
    """The activity columns of every row of whole groups that are sorted by time, whose times are
    also given on one line (see :func:`time_lines`)."""
    size = table.num_rows
    us = table.column("us").to_numpy().astype(np.int64)

    history = table.column("is_history").to_numpy(zero_copy_only=False).astype(bool)
    absent = table.column("available_us").is_null().to_numpy()
    arrived = table.column("available_us").fill_null(0).to_numpy().astype(np.int64)
    rank = np.searchsorted(np.sort(arrived), arrived)  # rows that arrived strictly earlier
    bound = np.where(absent, 0, rank)
    rank = np.where(absent | ~history, size, rank).astype(np.int32 if size < 1 << 31 else np.int64)

    devices, no_device = codes(table.column("device_id"))
    recipients, no_recipient = codes(table.column("recipient_id"))

    # By time; rows of one instant by device.
    order = np.lexsort([devices, time])
    by_time, device = time[order], devices[order]
    ranks, minima = Ranks(rank[order]), Minima(rank[order])
    end = np.searchsorted(by_time, time, "left")
    out = {
        name: ranks.below(np.searchsorted(by_time, time - span, "right"), end, bound) for name, span in ROW_SPANS.items()
    }
    begin = np.searchsorted(by_time, time - ACTIVITY_SPAN, "right")
    last = minima.last(begin, end, bound)
    found = last >= begin
    last = np.where(found, last, 0)
    instant = np.searchsorted(by_time, by_time[last], "left")
    lowest = np.minimum(minima.first(instant, last + 1, bound), max(size - 1, 0))
    single = found & (device[lowest] == device[last])
    out["last_us"] = _when(found, us[order][last])
    del ranks, minima  # the tables of one order at a time: a long group has large ones

    def within(codes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The order by code and time, and each row's range of places in its own code."""
        order = np.lexsort([time, codes])
        # Places of (code, time) pairs: ranks of times stand for the times.
        times = np.unique(time)
        pair = codes * (len(times) + 1)
        placed = (pair + np.searchsorted(times, time, "left"))[order]
        first = np.searchsorted(placed, pair + np.searchsorted(times, time - span, "right"), "left")
        return order, first, np.searchsorted(placed, pair + np.searchsorted(times, time, "left"), "left"), placed

    order_r, first_r, end_r, _ = within(recipients, ACTIVITY_SPAN)
    nobody = no_recipient
    _, first_hour, _, _ = within(recipients, HOUR)
    out["n_recipient_60m"] = np.where(nobody, 0, Ranks(rank[order_r]).below(first_hour, end_r, bound))
    at = Minima(rank[order_r]).first(first_r, end_r, bound)
    seen = (at < end_r) & ~nobody
    out["first_recipient_us"] = _when(seen, us[order_r][np.where(seen, at, 0)])

    order_d, first_d, end_d, _ = within(devices, ACTIVITY_SPAN)
    out["device_seen"] = _when(~no_device, Minima(rank[order_d]).any(first_d, end_d, bound))
    chosen = pc.take(table.column("device_id").combine_chunks(), pa.array(order[last]))
    out["last_device"] = pc.if_else(pa.array(single), chosen, pa.scalar(None, chosen.type))
    for name in (*ROW_SPANS, "n_recipient_60m"):
        out[name] = pa.array(out[name].astype(np.int32))
    return out


def prior_activity(table: pa.Table, time: np.ndarray) -> dict[str, pa.Array]:
    """The same columns over one clock: every history row of an earlier instant is seen. Recipients and
    devices that are null are equal to each other, as in a window's partition."""
    us = table.column("us").to_numpy().astype(np.int64)
    past = np.flatnonzero(table.column("is_history").to_numpy(zero_copy_only=False).astype(bool))
    earlier = time[past]
    end = np.searchsorted(earlier, time, "left")
    begin = np.searchsorted(earlier, time - ACTIVITY_SPAN, "right")
    out = {name: pa.array(end - np.searchsorted(earlier, time - span, "right")) for name, span in ROW_SPANS.items()}
    found = end > begin
    out["last_us"] = _when(found, us[past][end[found] - 1], found)

    def within(name: str, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The history in the order of value and time, and each row's range of places in its own value."""
        own, _ = codes(table.column(name))
        times = np.unique(earlier)
        pair = own * (len(times) + 1)
        placed = pair[past] + np.searchsorted(times, earlier)
        order = np.argsort(placed, kind="stable")
        ends = (pair + np.searchsorted(times, at, side) for at, side in ((time - span, "right"), (time, "left")))
        return order, *(np.searchsorted(placed[order], x) for x in ends)

    order, first, upto = within("recipient_id", ACTIVITY_SPAN)
    known = upto > first
    out["first_recipient_us"] = _when(known, us[past][order][first[known]], known)
    _, first, upto = within("recipient_id", HOUR)
    out["n_recipient_60m"] = pa.array(upto - first)
    _, first, upto = within("device_id", ACTIVITY_SPAN)
    out["device_seen"] = pa.array(upto > first)

    device, absent = codes(table.column("device_id"))
    starts = np.flatnonzero(np.diff(earlier, prepend=earlier[:1] - 1))
    instant = np.cumsum(np.diff(earlier, prepend=earlier[:1] - 1) > 0) - 1
    here = np.where(absent, -1, device)[past]
    low, high, row = (
        how.reduceat(x, starts) if len(starts) else x
        for how, x in (
            (np.minimum, np.where(here < 0, len(device), here)),
            (np.maximum, here),
            (np.maximum, np.where(here < 0, -1, past)),
        )
    )
    at = np.zeros(len(time), np.int64)
    at[found] = instant[end[found] - 1]
    single = found.copy()
    single[found] = (low == high)[at[found]]
    index = np.zeros(len(time), np.int64)
    index[single] = row[at[single]]
    out["last_device"] = table.column("device_id").combine_chunks().take(pa.array(index, mask=~single))
    return out


def _when(known: np.ndarray, values: np.ndarray, at: np.ndarray | None = None) -> pa.Array:
    """Values where they are known, of all rows or of the rows ``at``."""
    if at is not None:
        given, values = values, np.zeros(len(known), values.dtype)
        values[at] = given
    return pa.array(values, mask=~known)


COLUMNS = (
    *((name, T.IntegerType()) for name in (*ROW_SPANS, "n_recipient_60m")),
    ("first_recipient_us", T.LongType()),
    ("last_us", T.LongType()),
    ("device_seen", T.BooleanType()),
    ("last_device", None),  # as device_id
)


def with_arrived_activity(frame: DataFrame) -> DataFrame:
    """Adds the activity columns of a history frame that is already dealt by group.

    Candidates see the history rows of the 180 days before them (both ends open) with
    ``available_us`` below their own. A row without arrival is never seen and sees none. Recipients
    and devices that are null are equal to none; ``last_device`` is the one device of the latest
    instant seen, NULL where there are several. Repeated rows are rows of their own.
    """
    return _with_activity(frame, known_activity, COLUMNS)


def with_prior_activity(frame: DataFrame) -> DataFrame:
    """Adds the activity columns of a history frame that is already dealt by group, of all history rows
    of the 180 days before each candidate (both ends open), however many these are."""
    wide = [(name, T.LongType() if kind == T.IntegerType() else kind) for name, kind in COLUMNS]
    return _with_activity(frame, prior_activity, wide)


def _with_activity(frame: DataFrame, work: Callable, columns: Sequence[tuple[str, T.DataType | None]]) -> DataFrame:
    device = frame.schema["device_id"].dataType
    added = [T.StructField(n, device if k is None else k) for n, k in columns]
    schema = T.StructType([*frame.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, time in time_lines(batches, ACTIVITY_SPAN):
            found = work(table, time)
            for name, _ in columns:
                table = table.append_column(name, found[name])
            yield from table.combine_chunks().to_batches(max_chunksize=BATCH_ROWS)

    return frame.sortWithinPartitions(*GROUP, "us").mapInArrow(run, schema)
