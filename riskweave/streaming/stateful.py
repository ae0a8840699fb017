"""Per-customer state over a transaction stream.

Every call to the state store crosses from Python to the JVM, so what a micro-batch costs is its
number of calls. The activity of a customer with few rows is one value, read and written once a
batch, and its rows are judged by searches in sorted lists. A longer history is cut into small entries: instants by hour, a recipient's instants by day,
and the two latest instants of each device. A micro-batch reads and writes only the entries that its
rows touch, so its cost does not depend on how long the history is. With ``expire`` an event-time
timer clears a customer 180 days after the last row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskweave.functions.frames import DAY, HOUR, KEYS, MINUTE
from riskweave.operators.history import HISTORY_LIMIT
from riskweave.operators.learning import TrustedWindow

SPAN = 180 * DAY
TTL_MS = 181 * 24 * 3_600_000
#: A customer with at most so many rows in the span is held as one value.
PACKED_ROWS = 1_000

ACTIVITY_SCHEMA = (
    "transaction_id {id}, customer_id {customer}, currency string, us bigint, late boolean, "
    "history_limit_exceeded boolean, transactions_last_5_min bigint, "
    "transactions_last_10_min bigint, transactions_last_hour bigint, "
    "activity_history_count bigint, recipient_transactions_last_hour bigint, "
    "first_recipient_us bigint, last_us bigint, last_device string, device_seen boolean"
)
VALUES = [x.split()[0] for x in ACTIVITY_SCHEMA.split(", ")[5:]]
#: What the processor reads of a row besides the key, and a row that it makes.
ACTIVITY_INPUT = ("transaction_id", "us", "recipient_id", "device_id")
ACTIVITY_ROW = Row(*(x.split()[0] for x in ACTIVITY_SCHEMA.split(", ")))
NO_VALUES = (None,) * len(VALUES)
GATE_SCHEMA = (
    "transaction_id {id}, customer_id {customer}, currency string, us bigint, reason string, "
    "n_trusted bigint, median2_trusted bigint"
)


class Entries:
    """A map state with what one call has read and changed of it. Where ``whole``, the state holds
    nothing and all there is is held here."""

    def __init__(self, state, whole: bool) -> None:
        self.state, self.whole, self.held, self.changed = state, whole, {}, set()

    def get(self, key: tuple):
        if key not in self.held:
            known = not self.whole and self.state.containsKey(key)
            self.held[key] = self.state.getValue(key) if known else None
        return self.held[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        self.held[key] = value
        self.changed.add(key)

    def list(self, key: tuple) -> list[int]:
        found = self.get(key)
        return list(found[0]) if found else []

    def insert(self, key: tuple, value: int) -> None:
        values = self.list(key)
        values.insert(bisect_right(values, value), value)
        self.put(key, (values,))

    def save(self) -> None:
        for key in self.changed:
            if self.held[key] is not None:
                self.state.updateValue(key, self.held[key])
            elif not self.whole and self.state.containsKey(key):
                self.state.removeKey(key)


def _two_latest(held: tuple | None, us: int, device: str) -> tuple:
    """The two latest instants as (us, least device, greatest device, us, least, greatest)."""
    pairs = [held[:3], held[3:]] if held else []
    pairs = [p for p in pairs if p[0] is not None]
    same = next((p for p in pairs if p[0] == us), None)
    if same:
        pairs[pairs.index(same)] = (us, min(same[1], device), max(same[2], device))
    else:
        pairs = sorted([*pairs, (us, device, device)], reverse=True)[:2]
    return (*pairs[0], *(pairs[1] if len(pairs) > 1 else (None, None, None)))


class Short:
    """What is known of a customer with few rows: all rows, and the greatest instant (``top``). Sorted
    instants, by recipient and by device, are made when the first row is evaluated."""

    def __init__(self, head: tuple | None) -> None:
        self.lowest, self.top, self.timer = head[1:4] if head else (None, None, None)
        self.rows: list[tuple] = list(zip(*head[6:9], strict=True)) if head else []
        self.times: list[int] | None = None

    def _add(self, us: int, recipient: int | None, device: str | None) -> None:
        insort(self.times, us)
        if recipient is not None:
            insort(self.recipients.setdefault(recipient, []), us)
        if device is not None:
            insort(self.devices.setdefault(device, []), us)
            if us in self.of_instant:
                least, most = self.of_instant[us]
                self.of_instant[us] = (min(least, device), max(most, device))
            else:
                self.of_instant[us] = (device, device)
                insort(self.instants, us)

    def keep(self, us: int, recipient: int | None, device: str | None) -> None:
        self.rows.append((us, recipient, device))
        if self.times is not None:
            self._add(us, recipient, device)

    def advance(self, us: int) -> None:
        bound = (us - SPAN) // HOUR
        self.lowest = bound if self.lowest is None else max(self.lowest, bound)
        self.top = us

    def evaluate(self, us: int, recipient: int | None, device: str | None, limit: int) -> tuple:
        if self.times is None:
            self.times, self.instants, self.recipients, self.devices, self.of_instant = [], [], {}, {}, {}
            for row in sorted(self.rows, key=itemgetter(0)):
                self._add(*row)
        times, low = self.times, us - SPAN
        now = bisect_left(times, us)
        n = now - bisect_right(times, low)
        known = self.recipients.get(recipient, ()) if recipient is not None else ()
        first = bisect_right(known, low)
        last, of_last = bisect_left(self.instants, us) - 1, None
        last = self.instants[last] if last >= 0 and self.instants[last] > low else None
        if last is not None:
            least, most = self.of_instant[last]
            of_last = least if least == most else None
        seen = self.devices.get(device, ()) if device is not None else ()
        before = bisect_left(seen, us) - 1
        return (
            n > limit,
            *(now - bisect_right(times, us - span) for span in (5 * MINUTE, 10 * MINUTE, HOUR)),
            n,
            bisect_left(known, us) - bisect_right(known, us - HOUR),
            known[first] if first < len(known) and known[first] < us else None,
            last,
            of_last,
            before >= 0 and seen[before] > low,
        )

    def save(self, state) -> None:
        _save_packed(state, self.rows, self.lowest, self.top, self.timer)


def _save_packed(state, rows: list[tuple], lowest: int, top: int, timer: int | None) -> None:
    live = [r for r in rows if r[0] // HOUR >= lowest]
    packed = [list(x) for x in zip(*live, strict=True)] or [[], [], []]
    state.update((len(live), lowest, top, timer, False, [], *packed, *[None] * 6))


class History:
    """What is known of one customer: ``total`` rows in hours from ``lowest`` on, the greatest
    instant (``top``), and the two latest instants with a device."""

    def __init__(self, states: tuple, head: tuple | None) -> None:
        self.total, self.lowest, self.top, self.timer, spilled = head[:5] if head else (0, None, None, None, False)
        self.rows: list[tuple] | None = None if spilled else []
        self.occupied: list[int] = list(head[5]) if spilled else []
        self.latest = tuple(head[9:]) if spilled and head[9] is not None else None
        self.maps = [Entries(x, not spilled) for x in states]
        self.hours, self.days, self.recipients, self.devices = self.maps
        if head and not spilled:
            self.total = 0
            for us, recipient, device in zip(*head[6:9], strict=True):
                self.keep(us, recipient, device)

    def keep(self, us: int, recipient: int | None, device: str | None) -> None:
        if self.rows is not None:
            self.rows.append((us, recipient, device))
        hour = (us // HOUR,)
        if not self.hours.get(hour):
            insort(self.occupied, us // HOUR)
        self.hours.insert(hour, us)
        self.total += 1
        if recipient is not None:
            if us // DAY not in self.recipients.list((recipient,)):
                self.recipients.insert((recipient,), us // DAY)
            self.days.insert((recipient, us // DAY), us)
        if device is not None:
            self.latest = _two_latest(self.latest, us, device)
            self.devices.put((device,), _two_latest(self.devices.get((device,)), us, device))

    def advance(self, us: int) -> None:
        """Hours that lie wholly before the span go."""
        bound = (us - SPAN) // HOUR
        gone = bisect_left(self.occupied, bound)
        for hour in self.occupied[:gone]:
            self.total -= len(self.hours.list((hour,)))
            self.hours.put((hour,), None)
        del self.occupied[:gone]
        self.lowest = bound if self.lowest is None else max(self.lowest, bound)
        self.top = us

    def evaluate(self, us: int, recipient: int | None, device: str | None, limit: int) -> tuple:
        total, latest, (hours, days, recipients, devices) = self.total, self.latest, self.maps
        low = us - SPAN
        now = hours.list((us // HOUR,))
        n = total - bisect_right(hours.list((low // HOUR,)), low) - (len(now) - bisect_left(now, us))
        recent = [*hours.list((us // HOUR - 1,)), *now]

        def within(instants: list[int], span: int) -> int:
            return bisect_left(instants, us) - bisect_right(instants, us - span)

        first, n_recipient = None, 0
        if recipient is not None:
            own = (recipient,)
            known = recipients.list(own)
            gone = [d for d in known if d < low // DAY]
            for day in gone:
                days.put((recipient, day), None)
            if gone:
                known = known[len(gone) :]
                recipients.put(own, (known,))
            for day in known:
                instants = days.list((recipient, day))
                place = bisect_right(instants, low)
                if place < len(instants):
                    first = instants[place] if instants[place] < us else None
                    break
            both = [t for d in sorted({(us - HOUR) // DAY, us // DAY}) for t in days.list((recipient, d))]
            n_recipient = within(both, HOUR)
        last, of_last = None, None
        for at, least, most in (latest[:3], latest[3:]) if latest else ():
            if at is not None and at < us:
                if at > low:
                    last, of_last = at, least if least == most else None
                break
        seen = devices.get((device,)) if device is not None else None
        before = next((t for t in (seen[0], seen[3]) if t is not None and t < us), None) if seen else None
        return (
            n > limit,
            *(within(recent, span) for span in (5 * MINUTE, 10 * MINUTE, HOUR)),
            n,
            n_recipient,
            first,
            last,
            of_last,
            before is not None and before > low,
        )

    def save(self, state) -> None:
        if self.rows is not None and self.total <= PACKED_ROWS:
            _save_packed(state, self.rows, self.lowest, self.top, self.timer)
            return
        for entries in self.maps:
            entries.save()
        state.update((self.total, self.lowest, self.top, self.timer, True, self.occupied, [], [], [], *(self.latest or [None] * 6)))


class ActivityProcessor(StatefulProcessor):
    """Activity features at arrival. A late row is marked and has no values; it changes no earlier
    result, and later rows see it. A row with more than ``limit`` prior rows is marked and has its
    values: what is held of a customer is never cut, and a longer history costs no more a row."""

    def __init__(self, limit: int = HISTORY_LIMIT, expire: bool = False) -> None:
        self.limit, self.expire = limit, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        two = "us bigint, low string, high string, us2 bigint, low2 string, high2 string"
        self.head = handle.getValueState(
            "head",
            "total bigint, lowest bigint, top bigint, timer bigint, spilled boolean, hours array<bigint>, "
            f"instants array<bigint>, recipients array<bigint>, devices array<string>, {two}",
        )
        self.maps = (
            handle.getMapState("hours", "hour bigint", "instants array<bigint>"),
            handle.getMapState("days", "recipient bigint, day bigint", "instants array<bigint>"),
            handle.getMapState("recipients", "recipient bigint", "days array<bigint>"),
            handle.getMapState("devices", "device string", two),
        )

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        names = rows[0].__fields__
        # By place: a field by name is looked up anew each time.
        values = map(itemgetter(*(names.index(n) for n in ACTIVITY_INPUT)), rows)
        head = self.head.get()
        few = not (head and head[4]) and len(rows) + (len(head[6]) if head else 0) <= PACKED_ROWS
        past = Short(head) if few else History(self.maps, head)
        for transaction, us, recipient, device in sorted(values, key=lambda r: (r[1], str(r[0]))):
            late = past.top is not None and us < past.top
            found = NO_VALUES
            if not late:
                past.advance(us)
                found = past.evaluate(us, recipient, device, self.limit)
            yield ACTIVITY_ROW(transaction, key[0], key[1], us, late, *found)
            if us // HOUR >= past.lowest:
                past.keep(us, recipient, device)
        if self.expire:
            if past.timer is not None:
                self.handle.deleteTimer(past.timer)
            past.timer = past.top // 1000 + TTL_MS
            self.handle.registerTimer(past.timer)
        past.save(self.head)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.head, *self.maps):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class GateProcessor(StatefulProcessor):
    """The profile-update gate over a stream of reviewed transactions, in time order per key.

    Rows may carry ``evaluable``, as in the batch fold; a row that could not be evaluated counts as
    unverified.
    """

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One value: two calls a key, and one column family of the store.
        self.held = handle.getValueState(
            "held", "seen bigint, us array<bigint>, cents array<bigint>", ttlDurationMs=self.ttl_ms
        )

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        window = TrustedWindow()
        seen, *trusted = self.held.get() or (None, [], [])
        for us, cents in sorted(zip(*trusted, strict=True)):
            window.admit(us, cents)
        for row in sorted(rows, key=lambda r: (r.us, str(r.transaction_id))):
            if seen is not None and row.us < seen and not row.is_seed:
                # An older row would need the past replayed; it never changes the profile.
                reason, n, median2 = "LATE_REVIEW_REQUIRES_REPLAY", len(window.ordered), None
            else:
                verdict = row.verdict if getattr(row, "evaluable", True) else None
                reason, n, median2 = window.decide(row.us, row.cents, verdict)
            if row.is_seed:
                reason = "TRUSTED_REVIEWED_BOOTSTRAP"
            if reason in ("TRUSTED_REVIEWED_BOOTSTRAP", "CONFIRMED_ORDINARY_ACTIVITY"):
                window.admit(row.us, row.cents)
                seen = row.us if seen is None else max(seen, row.us)
            yield Row(
                transaction_id=row.transaction_id,
                customer_id=key[0],
                currency=key[1],
                us=row.us,
                reason=reason,
                n_trusted=n,
                median2_trusted=median2,
            )
        if seen is not None:
            self.held.update((seen, [us for us, _ in window.queue], [cents for _, cents in window.queue]))

    def close(self) -> None:
        pass


def _apply(stream: DataFrame, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    types = dict(stream.dtypes)
    return stream.groupBy(*KEYS).transformWithState(
        statefulProcessor=processor,
        outputStructType=schema.format(id=types["transaction_id"], customer=types["customer_id"]),
        outputMode="Append",
        timeMode=mode,
    )


def live_activity(
    stream: DataFrame, limit: int = HISTORY_LIMIT, expire: bool = False
) -> DataFrame:
    """Activity features at arrival. With ``expire`` the stream needs a watermark."""
    if not expire:  # each column of a row costs Python time
        stream = stream.select(*KEYS, *ACTIVITY_INPUT)
    return _apply(stream, ActivityProcessor(limit, expire), ACTIVITY_SCHEMA, "EventTime" if expire else "None")


def live_gate(stream: DataFrame, expire: bool = False) -> DataFrame:
    """The gate. Expiry uses processing time, which never ends by itself, so a run over what is
    available now leaves it off."""
    processor = GateProcessor(TTL_MS if expire else None)
    return _apply(stream, processor, GATE_SCHEMA, "ProcessingTime" if expire else "None")
