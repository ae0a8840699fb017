"""The two-clock replay against its definition, and what it costs."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from riskweave.functions.frames import DAY, HOUR, MINUTE
from riskweave.operators import datasets
from riskweave.operators.arrivals import Minima, Ranks, known_activity, with_arrived_activity
from riskweave.operators.history import candidates, history_frame
from riskweave.operators.rolling import with_recent

SPAN = 180 * DAY
SCHEMA = (
    "transaction_id bigint, customer_id bigint, currency string, us bigint, cents bigint, "
    "recipient_id bigint, device_id string, admitted_us bigint, timezone string, "
    "available_us bigint, label_available_us bigint, label int"
)


def rows_of(seed, n, keys=4, step=HOUR):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        us = r.choice([r.randrange(0, 40), r.randrange(0, 40), 200 * 24, 181 * 24]) * step + r.choice([0, 0, MINUTE * 5, 1])
        delay = r.choice([0, 0, 0, 1, MINUTE, HOUR, 30 * HOUR, 100 * DAY])
        av = None if r.random() < 0.05 else us + delay
        to = r.choice([1, 2, 3, None])
        device = r.choice(["a", "b", "c", None])
        rows.append((i, r.randrange(keys), "KZT", us, 100 * i, to, device, us, "UTC", av, us + DAY, 0))
    return rows


def brute(rows):
    out = {}
    for t, c, _, us, _, to, device, _, _, av, *_ in rows:
        seen = [p for p in rows if p[1] == c and us - SPAN < p[3] < us and None not in (p[9], av) and p[9] < av]
        last = max((p[3] for p in seen), default=None)
        at_last = {p[6] for p in seen if p[3] == last}
        same = [p for p in seen if to is not None and p[5] == to]
        out[t] = (
            *(sum(p[3] > us - span for p in seen) for span in (SPAN, 5 * MINUTE, 10 * MINUTE, HOUR)),
            sum(p[3] > us - HOUR for p in same),
            min((p[3] for p in same), default=None),
            last,
            None if device is None else any(p[6] == device for p in seen),
            next(iter(at_last)) if len(at_last) == 1 else None,
        )
    return out


NAMES = (
    "n_activity n_5m n_10m n_60m n_recipient_60m first_recipient_us last_us device_seen last_device"
).split()


@pytest.mark.parametrize("seed, n, keys", [(1, 400, 4), (2, 300, 1), (3, 60, 40)])
def test_activity_is_that_of_the_definition(spark, seed, n, keys):
    rows = rows_of(seed, n, keys)
    found = candidates(with_arrived_activity(datasets.replay_frame(spark.createDataFrame(rows, SCHEMA))))
    assert {r.transaction_id: tuple(r[x] for x in NAMES) for r in found.collect()} == brute(rows)


@pytest.mark.parametrize("limit", [3, 10])
def test_long_keys_see_up_to_the_limit(spark, limit):
    """Values are right where the limit holds, and more than the limit is seen as such."""
    rows = rows_of(7, 300, 2)
    frame = datasets.replay_frame(spark.createDataFrame(rows, SCHEMA), limit)
    want = brute(rows)
    found = candidates(with_arrived_activity(frame)).collect()
    assert len(found) == len(rows)
    for r in found:
        if want[r.transaction_id][0] <= limit:
            assert tuple(r[x] for x in NAMES) == want[r.transaction_id]
        else:
            assert r.n_activity > limit


def test_a_late_row_does_not_deepen_other_keys(spark):
    rows = [(i, i % 2, "KZT", i * HOUR, 1, 1, "a", None, "UTC", i * HOUR + 5, i * HOUR, 0) for i in range(200)]
    rows.append((200, 0, "KZT", 10 * HOUR, 1, 1, "a", None, "UTC", 10 * HOUR + 100 * DAY, 0, 0))
    room = {r.customer_id: r.room for r in datasets.in_flight(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert room == {0: 1, 1: 0}
    frame = datasets.replay_frame(spark.createDataFrame(rows, SCHEMA), 10)
    sizes = {(r.customer_id, r.chunk): r["count"] for r in frame.groupBy("customer_id", "chunk").count().collect()}
    assert max(n for (c, _), n in sizes.items() if c == 1) <= 2 * 11
    assert max(n for (c, _), n in sizes.items() if c == 0) <= 2 * 12 + 1


def test_no_list_of_the_history_in_the_plan(spark):
    frame = with_arrived_activity(history_frame(spark.createDataFrame(rows_of(1, 5), SCHEMA), refuse=False))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_cost_is_not_quadratic():
    def seconds(n):
        r = np.random.default_rng(n)
        us = np.sort(r.integers(0, 100 * DAY, n))
        table = pa.table(
            {
                "us": us,
                "available_us": us + r.integers(0, 30 * DAY, n),
                "is_history": np.ones(n, bool),
                "device_id": r.integers(0, 5, n),
                "recipient_id": r.integers(0, 50, n),
            }
        )
        best = []
        for _ in range(3):
            begun = time.perf_counter()
            known_activity(table, us)
            best.append(time.perf_counter() - begun)
        return min(best)

    assert seconds(80_000) < 3 * seconds(40_000)


@pytest.mark.parametrize("keep, span", [(3, 24 * HOUR), (1, HOUR), (5, 100 * HOUR)])
def test_recent_amounts_are_those_of_the_definition(spark, keep, span):
    rows = [(*x[:4], x[0] * 7 + 1, *x[5:]) for x in rows_of(11, 200, 3)]
    frame = history_frame(spark.createDataFrame(rows, SCHEMA), refuse=False)
    found = candidates(with_recent(frame, span, keep)).collect()
    for x in found:
        prior = sorted((p[3], str(p[0]), p[4]) for p in rows if p[1] == x.customer_id and x.us - span < p[3] < x.us)
        assert x.recent == [*(p[2] for p in prior[-keep:]), x.cents]


def test_counts_and_places_of_ranges():
    r = np.random.default_rng(5)
    for size in (1, 2, 7, 64, 100):
        ranks = r.integers(0, size + 2, size)
        first, bound = r.integers(0, size + 1, 50), r.integers(0, size + 4, 50)
        end = np.minimum(first + r.integers(0, size + 1, 50), size)
        below, table = Ranks(ranks).below(first, end, bound), Minima(ranks)
        for k, (a, b, x) in enumerate(zip(first, end, bound, strict=True)):
            hits = [i for i in range(a, b) if ranks[i] < x]
            assert below[k] == len(hits)
            assert table.first(first, end, bound)[k] == (hits[0] if hits else b)
            assert table.last(first, end, bound)[k] == (hits[-1] if hits else a - 1)
            assert table.any(first, end, bound)[k] == bool(hits)
