"""Histories beyond the limit, where no row may be missing."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from riskweave.functions.frames import DAY, HOUR, MINUTE
from riskweave.operators import datasets, history, rolling
from riskweave.operators.arrivals import known_activity
from riskweave.plans import datasets as plans
from riskweave.plans import catalog, streams
from riskweave.streaming import replay, stateful
from test_arrivals import SCHEMA, SPAN, rows_of
from test_streaming import _Held


def group(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 150))
    us = np.sort(r.integers(0, int(r.choice([3 * HOUR, 30 * DAY, 400 * DAY])), n))
    us -= us % int(r.choice([1, DAY // 3]))
    seen = us + r.integers(0, 4, n) * r.choice([0, HOUR, DAY, 40 * DAY], n)
    return pa.table(
        {
            "us": us,
            "cents": r.integers(1, int(r.choice([5, 90_000, 10**18])), n),
            "recipient_id": pa.array(r.integers(0, 5, n), mask=r.random(n) < 0.1),
            "local_hour": r.integers(0, 24, n).astype(np.int32),
            "seen_us": pa.array(seen, mask=r.random(n) < 0.3),
            "is_history": r.random(n) < 0.9,
            "is_candidate": r.random(n) < 0.9,
        }
    )


def test_a_long_group_has_the_statistics_of_a_sorted_list():
    for seed in range(60):
        table = group(seed)
        want = rolling._statistics(table.to_pydict(), 60 * DAY, 9 * DAY)
        found = [x.to_pylist() for x in rolling.group_statistics(table, 60 * DAY, 9 * DAY)]
        assert [None if row is None else tuple(row) for row in want] == [
            None if row[0] is None else row for row in zip(*found, strict=True)
        ]


def test_groups_that_end_with_or_inside_a_batch():
    sizes = [3, 1, 7, 2, 2, 5]
    keys = np.repeat(np.arange(len(sizes)), sizes)
    table = pa.table({"customer_id": keys, "currency": ["KZT"] * 20, "chunk": [0] * 20, "row": np.arange(20)})
    for width in (1, 2, 3, 4, 20):
        found = list(rolling.whole_groups(iter(table.to_batches(max_chunksize=width))))
        assert [x for t in found for x in t.column("row").to_pylist()] == list(range(20))
        assert all(len(set(t.column("customer_id").to_pylist()) & set(u.column("customer_id").to_pylist())) == 0 for t, u in zip(found, found[1:]))


@pytest.mark.parametrize("long_group", [0, 5_000])
def test_whole_vectors_do_not_depend_on_the_limit(spark, monkeypatch, long_group):
    """Rows over more than one slot of 180 days; beyond a low limit the values of a high one."""
    monkeypatch.setattr(rolling, "LONG_GROUP", long_group)
    rows = spark.createDataFrame(rows_of(21, 400, 3, DAY // 4), SCHEMA)
    frame = datasets.replay_frame(rows, 7, whole=True)
    assert frame.agg(F.max("chunk")).first()[0] > 0 and frame.filter("is_candidate").count() == 400
    high = datasets.prepare(rows).drop("history_limit_exceeded")
    whole = datasets.prepare(rows, 7, whole=True)
    assert whole.filter("history_limit_exceeded").count() > 100
    assert whole.filter("history_limit_exceeded AND activity_history_count > 7").count() > 100
    assert datasets.changed_rows(whole.drop("history_limit_exceeded"), high).isEmpty()


def busy_customer(path, n=12_600):
    """Events of which one customer has more than the limit in one currency, and some of others."""
    r = np.random.default_rng(3)
    us = 1_704_067_200_000_000 + np.sort(r.integers(0, 28 * DAY, n))
    k = r.integers(0, 100, n)
    user = np.where(np.arange(n) % 20 == 0, 3 + np.arange(n) % 40, 2)
    k = np.where(user == 2, k - (k % 5 == 4), k)  # all of it in one currency
    kinds = np.array(["view", "click", "signup", "purchase", "error"])
    events = {
        "event_id": np.arange(n),
        "ts": pa.array(us, pa.timestamp("us")),
        "user_id": user,
        "event_type": kinds[r.integers(0, 5, n)],
        "value": r.integers(1, 50_000, n) / 100,
        "props": [f'{{"k": {x}}}' for x in k],
    }
    pq.write_table(pa.table(events), f"{path}/events.parquet")
    customers = {
        "c_custkey": np.arange(1, 60),
        "c_name": [f"c{i}" for i in range(1, 60)],
        "c_nationkey": pa.array(np.arange(1, 60) % 25, pa.int32()),
        "c_acctbal": np.zeros(59),
        "c_mktsegment": ["MACHINERY" if i == 3 else "BUILDING" for i in range(1, 60)],
    }
    pq.write_table(pa.table(customers), f"{path}/customer.parquet")


def twin(path, sql):
    connection = duckdb.connect()
    for name in ("events", "customer"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return connection.execute(sql).fetchall()


def test_no_event_of_a_busy_customer_is_missing_in_the_experiment(spark, tmp_path):
    busy_customer(tmp_path)
    found = plans._prepared_split(spark, str(tmp_path)).select("transaction_id", "split", "activity_history_count")
    found = sorted(tuple(x) for x in found.collect())
    sql = f"WITH {plans.SPLIT}, {plans.KNOWN} SELECT transaction_id, split, na::DOUBLE FROM sp JOIN known USING (transaction_id) WHERE split IS NOT NULL ORDER BY 1"
    assert max(x[2] for x in found) > history.HISTORY_LIMIT
    assert found == twin(tmp_path, sql)


def test_tables_of_ranks_are_small():
    """A group is as large as its key: bits and minima in 32 bits, one order at a time."""
    import tracemalloc

    n = 200_000
    r = np.random.default_rng(1)
    us = np.sort(r.integers(0, 30 * DAY, n))
    table = pa.table({"us": us, "available_us": us + 5, "is_history": np.ones(n, bool), "device_id": r.integers(0, 5, n), "recipient_id": r.integers(0, 50, n)})
    tracemalloc.start()
    known_activity(table, us)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 450 * n


def activity_of(rows):
    """Values of each row from their definitions; nulls are equal to each other."""
    out = {}
    for t, c, _, us, _, to, device, *_ in rows:
        seen = [p for p in rows if p[1] == c and us - SPAN < p[3] < us]
        last = max((p[3] for p in seen), default=None)
        at_last = {p[6] for p in seen if p[3] == last} - {None}
        same = [p[3] for p in seen if p[5] == to]
        out[t] = (
            *(sum(p[3] > us - span for p in seen) for span in (5 * MINUTE, 10 * MINUTE, HOUR)),
            len(seen),
            sum(x > us - HOUR for x in same),
            min(same, default=None),
            last,
            at_last.pop() if len(at_last) == 1 else None,
            any(p[6] == device for p in seen),
        )
    return out


@pytest.mark.parametrize("limit", [5, 10_000])
def test_replayed_values_beyond_the_limit(spark, limit):
    rows = rows_of(31, 400, 3, MINUTE) + [(400 + x[0], *x[1:]) for x in rows_of(32, 200, 2, HOUR * 5)]
    found = {x.transaction_id: tuple(x[n] for n in stateful.VALUES) for x in replay.activity(spark.createDataFrame(rows, SCHEMA), limit).collect()}
    assert found == {t: (x[3] > limit, *x) for t, x in activity_of(rows).items()}


@pytest.mark.parametrize("packed", [0, 1_000])
def test_live_values_beyond_the_limit(monkeypatch, packed):
    from pyspark.sql import Row

    monkeypatch.setattr(stateful, "PACKED_ROWS", packed)
    names = ("transaction_id", "us", "recipient_id", "device_id")
    rows = [x for x in sorted(rows_of(41, 120, 1), key=lambda x: (x[3], str(x[0]))) if x[5] is not None and x[6] is not None]
    processor = stateful.ActivityProcessor(limit=6)
    processor.head, processor.maps = _Held(), tuple(_Held() for _ in range(4))
    found = {}
    for i in range(0, len(rows), 25):
        batch = [Row(**dict(zip(names, (x[0], x[3], x[5], x[6]), strict=True))) for x in rows[i : i + 25]]
        for x in processor.handleInputRows((1, "KZT"), iter(batch), None):
            found[x.transaction_id] = None if x.late else tuple(x[n] for n in stateful.VALUES)
    want = {t: (x[3] > 6, *x) for t, x in activity_of(rows).items()}
    assert sum(x is not None and x[0] for x in found.values()) > 40
    assert {t: x for t, x in found.items() if x} == {t: want[t] for t, x in found.items() if x}


def test_late_replay_of_a_busy_customer(spark, tmp_path):
    busy_customer(tmp_path)
    rows = streams.late_replay(spark, str(tmp_path))
    found = rows.collect()
    assert sum(x.history_limit_exceeded for x in found) > 1_000
    sql = f"SELECT {', '.join(rows.columns)} FROM ({catalog.oracles()['q_late_replay']}) ORDER BY transaction_id"
    assert sorted(tuple(x) for x in found) == twin(tmp_path, sql)
