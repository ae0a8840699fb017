"""Exact order statistics of rolling windows, in one sorted pass over each history group.

An observation becomes visible at ``seen_us``. A candidate sees those of earlier instants that were
visible by its own, and that are younger than the window. Both rules only move forward in time, so
every observation enters a sorted list once and leaves it once.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.frames import DAY
from riskweave.operators.history import GROUP
from riskweave.operators.ranks import Difference, codes

STATISTICS = T.StructType(
    [
        T.StructField("n_long", T.IntegerType()),
        T.StructField("n_short", T.IntegerType()),
        T.StructField("median2_long", T.LongType()),
        T.StructField("median2_short", T.LongType()),
        T.StructField("p95_long", T.LongType()),
        T.StructField("mad4_long", T.LongType()),
        T.StructField("sum_long", T.DecimalType(38, 0)),
        T.StructField("hour_counts", T.ArrayType(T.IntegerType())),
        T.StructField("n_known_recipient", T.LongType()),
    ]
)
#: What a frame may add whose zone and windows change from one candidate of a key to the next: the
#: local hours of each row by zone, and each candidate's zone and windows in days.
MOVING = ("zone_hours", "timezone", "long_days", "short_days")
NEEDED = ("us", "cents", "recipient_id", "local_hour", "seen_us", "is_history", "is_candidate")
KINDS = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.decimal128(38, 0), pa.list_(pa.int32()), pa.int64()]
#: Beyond so many rows a group is worked out by vector operations, whose cost a row does not grow with
#: what a window holds, as that of a sorted list does.
LONG_GROUP = 5_000
#: Rows of a batch that goes back to the JVM.
BATCH_ROWS = 10_000


def doubled_median(ordered: list[int]) -> int | None:
    n = len(ordered)
    return ordered[(n - 1) // 2] + ordered[n // 2] if n else None


def _nth_gap(ordered: list[int], median2: int, place: int) -> int:
    """The ``place``-th smallest ``|2v - median2|``: two sorted runs, searched from both sides."""
    middle = bisect_left(ordered, median2, key=lambda v: 2 * v)
    left, right = middle, len(ordered) - middle
    low, high = max(0, place + 1 - right), min(place + 1, left)
    while low < high:  # how many of the smallest lie left of the median
        take = (low + high) // 2
        other = place + 1 - take
        if other > 0 and median2 - 2 * ordered[middle - take - 1] < 2 * ordered[middle + other - 1] - median2:
            low = take + 1
        else:
            high = take
    other = place + 1 - low
    ends = [median2 - 2 * ordered[middle - low]] if low else []
    ends += [2 * ordered[middle + other - 1] - median2] if other else []
    return max(ends)


class Window:
    """Sorted amounts that are visible and young enough."""

    def __init__(self, span: int):
        self.span = span
        self.ordered: list[int] = []
        self.hours = [0] * 24
        self.recipients: Counter = Counter()
        self.total = 0
        self.leaving: list[tuple[int, int, int, object]] = []

    def enter(self, us: int, cents: int, hour: int, recipient: object) -> None:
        insort(self.ordered, cents)
        self.hours[hour] += 1
        self.recipients[recipient] += 1
        self.total += cents
        heapq.heappush(self.leaving, (us, cents, hour, id(recipient), recipient))

    def leave(self, now: int) -> None:
        while self.leaving and self.leaving[0][0] <= now - self.span:
            _, cents, hour, _, recipient = heapq.heappop(self.leaving)
            del self.ordered[bisect_left(self.ordered, cents)]
            self.hours[hour] -= 1
            self.recipients[recipient] -= 1
            self.total -= cents


def _statistics(rows: dict[str, list], long_span: int, short_span: int) -> list[tuple | None]:
    """Statistics of each candidate of one group whose rows are sorted by time."""
    entering = deque(
        sorted(
            (max(seen, us + 1), us, cents, hour, i)
            for i, (us, cents, hour, seen, history) in enumerate(
                zip(rows["us"], rows["cents"], rows["local_hour"], rows["seen_us"], rows["is_history"], strict=True)
            )
            if history and seen is not None
        )
    )
    recipients, moving = rows["recipient_id"], "zone_hours" in rows
    long, short = Window(long_span), Window(short_span)
    entered: list[tuple[int, int, int, int]] = []
    shape = None
    out: list[tuple | None] = []
    at, values = None, None
    for k, (us, recipient, candidate) in enumerate(zip(rows["us"], recipients, rows["is_candidate"], strict=True)):
        if not candidate:
            out.append(None)
            continue
        if us != at:
            if moving and (now := tuple(rows[c][k] for c in MOVING[1:])) != shape:
                # Another zone or other windows: both are filled anew with what is still young enough.
                shape = now
                long, short = Window(shape[1] * DAY), Window(shape[2] * DAY)
                entered = [x for x in entered if x[0] > us - long_span]
                for then, cents, hour, i in entered:
                    hour = dict(rows["zone_hours"][i])[shape[0]]
                    for window in (long, short):
                        if then > us - window.span:
                            window.enter(then, cents, hour, recipients[i])
            while entering and entering[0][0] <= us:
                _, then, cents, hour, i = entering.popleft()
                if moving:
                    entered.append((then, cents, hour, i))
                    hour = dict(rows["zone_hours"][i])[shape[0]]
                for window in (long, short):
                    if then > us - window.span:
                        window.enter(then, cents, hour, recipients[i])
            long.leave(us)
            short.leave(us)
            at, n = us, len(long.ordered)
            middle = doubled_median(long.ordered)
            values = (
                n,
                len(short.ordered),
                middle,
                doubled_median(short.ordered),
                long.ordered[(95 * n + 99) // 100 - 1] if n else None,
                _nth_gap(long.ordered, middle, (n - 1) // 2) + _nth_gap(long.ordered, middle, n // 2) if n else None,
                Decimal(long.total),
                list(long.hours),
            )
        out.append((*values, long.recipients[recipient]))
    return out


def _counts(groups: np.ndarray, times: np.ndarray, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the rows of each asked group have a time up to ``at``."""
    known = np.unique(times)
    width = len(known) + 1
    placed = np.sort(groups * width + np.searchsorted(known, times))
    upto = np.searchsorted(placed, asked * width + np.searchsorted(known, at, "right"))
    return upto - np.searchsorted(placed, asked * width)


def _middle_gaps(held: Difference, values: np.ndarray, median2: np.ndarray) -> np.ndarray:
    """The two middle gaps ``|2v - median2|`` of each moment together (one twice, where rows are odd):
    as in :func:`_nth_gap`, for all moments at once. Of no use where there are no rows."""
    n, size = held.n, len(held.n)
    left = held.below(np.searchsorted(2 * values, median2, "left"))
    taken = (n - 1) // 2 + 1
    low, high = np.maximum(0, taken - (n - left)), np.minimum(taken, left)

    def gap(place: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.abs(2 * values[held.nth(place, at)] - median2[at])

    at = np.flatnonzero(low < high)
    while len(at):
        take = (low[at] + high[at]) // 2
        nearer = gap(left[at] - take - 1, at) < gap(left[at] + taken[at] - take - 1, at)
        low[at] = np.where(nearer, take + 1, low[at])
        high[at] = np.where(nearer, high[at], take)
        at = at[low[at] < high[at]]
    first, second = np.full(size, -1), np.full(size, np.iinfo(np.int64).max)
    right = taken - low
    for known, place in ((low > 0, left - low), (right > 0, left + right - 1)):
        at = np.flatnonzero(known)
        first[at] = np.maximum(first[at], gap(place[at], at))
    for known, place in ((low < left, left - low - 1), (right < n - left, left + right)):
        at = np.flatnonzero(known & (n % 2 == 0))
        second[at] = np.minimum(second[at], gap(place[at], at))
    return first + np.where(n % 2 == 0, second, first)


def group_statistics(table: pa.Table, long_span: int, short_span: int) -> list[pa.Array]:
    """As :func:`_statistics`, for one group of any length: a window at a moment is what had entered
    less what had left, and its order statistics are found for all moments at once."""

    def whole(name: str) -> np.ndarray:
        return table.column(name).fill_null(0).to_numpy().astype(np.int64)

    us, seen = whole("us"), whole("seen_us")
    past, candidate = (table.column(c).to_numpy().astype(bool) for c in ("is_history", "is_candidate"))
    rows = np.flatnonzero(past & ~table.column("seen_us").is_null().to_numpy())
    if any(table.column(c).take(pa.array(rows)).null_count for c in ("cents", "local_hour")):
        raise ValueError("a row of the baseline has no amount or no hour")
    cents, hours, recipients = whole("cents"), whole("local_hour"), codes(table.column("recipient_id"))[0]
    values, ranks = np.unique(cents[rows], return_inverse=True)
    at, moment = np.unique(us[candidate], return_inverse=True)

    def window(span: int) -> tuple:
        """Rows that are ever visible in the order in which they enter and leave, and how many of them
        have at each moment."""
        enter, leave = np.maximum(seen[rows], us[rows] + 1), us[rows] + span
        kept = np.flatnonzero(enter < leave)
        come, go = kept[np.argsort(enter[kept], kind="stable")], kept[np.argsort(leave[kept], kind="stable")]
        n_come, n_gone = np.searchsorted(enter[come], at, "right"), np.searchsorted(leave[go], at, "right")
        return Difference(ranks[come], ranks[go], n_come, n_gone), rows[come], rows[go], enter[come], leave[go]

    def doubled(held: Difference) -> np.ndarray:
        """Twice the median where there are rows."""
        some = np.flatnonzero(held.n)
        out = np.zeros(len(at), np.int64)
        out[some] = values[held.nth((held.n[some] - 1) // 2, some)] + values[held.nth(held.n[some] // 2, some)]
        return out

    held = window(short_span)[0]
    n_short, short2 = held.n, doubled(held)
    held, come, go, enter, leave = window(long_span)
    n, some = held.n, np.flatnonzero(held.n)
    median2, p95 = doubled(held), np.zeros(len(at), np.int64)
    p95[some] = values[held.nth((95 * n[some] + 99) // 100 - 1, some)]
    mad4 = _middle_gaps(held, values, median2)

    def total(part: np.ndarray) -> np.ndarray:
        more, less = (np.concatenate([[0], np.cumsum(part[order])]) for order in (come, go))
        return more[held.n_came] - less[held.n_gone]

    high, low = total(cents >> 30), total(cents & (1 << 30) - 1)  # each fits, their sum may not
    by_hour = np.empty((len(at), 24), np.int32)
    for hour in range(24):
        entered, left = (np.flatnonzero(hours[order] == hour) for order in (come, go))
        by_hour[:, hour] = np.searchsorted(entered, held.n_came) - np.searchsorted(left, held.n_gone)
    asked, when = recipients[candidate], us[candidate]
    known = np.zeros(table.num_rows, np.int64)
    known[candidate] = _counts(recipients[come], enter, asked, when) - _counts(recipients[go], leave, asked, when)

    index = np.zeros(table.num_rows, np.int64)
    index[candidate] = moment
    index = pa.array(index, mask=~candidate)
    sums = [Decimal((h << 30) + x) for h, x in zip(high.tolist(), low.tolist(), strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * 24), pa.array(by_hour.ravel()))
    columns = [
        *(pa.array(x.astype(np.int32)) for x in (n, n_short)),
        *(pa.array(x, mask=k == 0) for x, k in ((median2, n), (short2, n_short), (p95, n), (mad4, n))),
        pa.array(sums, KINDS[6]),
        lists,
    ]
    return [*(x.take(index) for x in columns), pa.array(known, mask=~candidate)]


def group_bounds(table: pa.Table) -> np.ndarray:
    """Where groups begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in GROUP:
        column = table.column(name).cast(pa.string()).fill_null("\0").combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a group ends, from batches that are sorted by group."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        # What is held and may go on is one group: its last row stands for it.
        seam = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        last = int(group_bounds(pa.concat_tables([*seam, table]))[-1]) - len(seam)
        if last > 0 or (held and last == 0):
            yield pa.concat_tables([*held, table.slice(0, last)]).combine_chunks()
            held = [table.slice(last)]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held).combine_chunks()


#: Groups are laid end to end on one time line while it fits into 62 bits.
TIME_LINE = 1 << 62


def time_lines(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole groups that are sorted by time, where they begin, and their times on one line: each
    group begins more than ``span`` after the end of the one before."""

    def line(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        starts, us = group_bounds(table), table.column("us").to_numpy().astype(np.int64)
        low, high = us[starts], us[np.append(starts[1:], len(us)) - 1]
        offset = np.concatenate([[0], np.cumsum(high - low + span + 1)[:-1]]) - low
        return table, starts, us + np.repeat(offset, np.diff(np.append(starts, len(us))))

    for table in whole_groups(batches):
        starts, us = group_bounds(table), table.column("us").to_numpy().astype(np.int64)
        lengths = us[np.append(starts[1:], len(us)) - 1] - us[starts] + span + 1
        used, begin = 0, 0
        for start, own in zip(starts.tolist(), lengths.tolist(), strict=True):
            if used and used + own > TIME_LINE:
                yield line(table.slice(begin, start - begin).combine_chunks())
                begin, used = start, 0
            used += own
        yield line(table.slice(begin).combine_chunks())


def with_recent(frame: DataFrame, span: int, keep: int) -> DataFrame:
    """Adds ``recent``: the amounts of the last ``keep`` history rows of earlier instants inside the
    span, in order of time and id, and the row's own. One search a row, whatever the span holds."""
    schema = T.StructType([*frame.schema.fields, T.StructField("recent", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, time in time_lines(batches, span):
            past = np.flatnonzero(table.column("is_history").to_numpy(zero_copy_only=False))
            cents = table.column("cents").to_numpy().astype(np.int64)
            end = np.searchsorted(time[past], time, "left")
            first = np.maximum(np.searchsorted(time[past], time - span, "right"), end - keep)
            sizes = np.maximum(end - first, 0)
            upto = np.cumsum(sizes + 1)
            values = np.empty(int(upto[-1]), np.int64)
            values[upto - 1] = cents
            at = np.ones(len(values), bool)
            at[upto - 1] = False
            begin = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
            values[at] = cents[past[begin + np.arange(int(sizes.sum()))]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]).astype(np.int32)), pa.array(values))
            yield from table.append_column("recent", lists).combine_chunks().to_batches()

    by_id = frame.sortWithinPartitions(*GROUP, "us", F.col("transaction_id").cast("string"))
    return by_id.mapInArrow(run, schema)


def rolling_statistics(frame: DataFrame, long_span: int, short_span: int) -> DataFrame:
    """Adds :data:`STATISTICS` to the candidates of a history frame.

    The frame is already dealt by group, of any length. If it has the columns :data:`MOVING`, hours
    and windows are those of each candidate, ``long_span`` at most.
    """
    moving = MOVING[0] in frame.columns
    wanted = [*NEEDED, *(MOVING if moving else ())]
    schema = T.StructType([*frame.schema.fields, *STATISTICS.fields])

    def one_by_one(table: pa.Table) -> list[pa.Array]:
        starts = group_bounds(table)
        needed = table.select(wanted).to_pydict()
        found: list[tuple | None] = []
        for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
            found += _statistics({k: v[a:b] for k, v in needed.items()}, long_span, short_span)
        return [pa.array([None if row is None else row[k] for row in found], kind) for k, kind in enumerate(KINDS)]

    def finish(table: pa.Table, found: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        for field, values in zip(STATISTICS.fields, found, strict=True):
            table = table.append_column(field.name, values)
        yield from table.to_batches(max_chunksize=BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            done, starts = 0, group_bounds(table)
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                if not moving and b - a > LONG_GROUP:
                    if done < a:
                        yield from finish(part := table.slice(done, a - done), one_by_one(part))
                    yield from finish(part := table.slice(a, b - a), group_statistics(part, long_span, short_span))
                    done = b
            if done < table.num_rows:
                yield from finish(part := table.slice(done), one_by_one(part))

    return frame.sortWithinPartitions(*GROUP, "us").mapInArrow(run, schema)
