"""Bounded history groups: long keys must give what short keys give, refusals included."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import TX_SCHEMA
from riskweave.functions.frames import DAY, HOUR, MINUTE
from riskweave.operators import features, history, profiles, sequence
from riskweave.schemas import FEATURE_NAMES

SPAN = 180 * DAY


def rows_of(seed, n, spread, customers=3, ties=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        us = 1_700_000_000_000_000 + rng.randrange(spread)
        if ties:
            us -= us % (spread // 12)
        customer = 1 if rng.random() < 0.6 else rng.randrange(2, customers + 2)
        cents = rng.randrange(1, 90_000)
        admitted = us if rng.random() < 0.7 else None
        out.append(
            (i, customer, "KZT", us, cents, rng.randrange(6), rng.choice("abc"), admitted, "UTC")
        )
    return out


def brute(rows, limit):
    """Activity features straight from their definitions."""
    result = {}
    for ident, customer, currency, us, _, recipient, device, _, _ in rows:
        prior = [r for r in rows if r[1:3] == (customer, currency) and us - SPAN < r[3] < us]
        if len(prior) > limit:
            result[ident] = None
            continue
        last = max((r[3] for r in prior), default=None)
        devices = {r[6] for r in prior if r[3] == last}
        same = [r[3] for r in prior if r[5] == recipient]
        result[ident] = (
            sum(r[3] > us - 5 * MINUTE for r in prior),
            sum(r[3] > us - HOUR for r in prior),
            len(prior),
            sum(s > us - HOUR for s in same),
            (us - min(same)) / DAY if same else 0.0,
            float(len(devices) == 1 and device not in devices),
            float(len(devices) != 1),
            float(bool(prior) and all(r[6] != device for r in prior)),
        )
    return result


NAMES = (
    "transactions_last_5_min",
    "transactions_last_hour",
    "activity_history_count",
    "recipient_transactions_last_hour",
    "recipient_observed_age_days",
    "device_changed",
    "device_change_missing",
    "device_not_seen_before",
)


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("limit", [4, 17, 10_000])
def test_chunks_match_definition(spark, ties, limit):
    rows = rows_of(7, 220, 400 * DAY, ties=ties)
    frame = features.behavior_v1(spark.createDataFrame(rows, TX_SCHEMA), limit=limit)
    expected = brute(rows, limit)
    got = {r.transaction_id: r for r in frame.collect()}
    assert set(got) == set(expected)
    for ident, values in expected.items():
        row = got[ident]
        assert row.history_limit_exceeded is (values is None)
        if values is None:
            assert all(row[name] is None for name in FEATURE_NAMES)
        else:
            assert tuple(row[name] for name in NAMES) == values


def test_short_spans_in_long_keys(spark):
    rows = rows_of(11, 300, 3 * HOUR)
    frame = features.behavior_v1(spark.createDataFrame(rows, TX_SCHEMA), limit=60)
    expected = brute(rows, 60)
    for row in frame.collect():
        if expected[row.transaction_id] is not None:
            assert tuple(row[n] for n in NAMES) == expected[row.transaction_id]


def test_baselines_do_not_depend_on_chunks(spark):
    rows = spark.createDataFrame(rows_of(3, 260, 900 * DAY), TX_SCHEMA)
    whole = features.behavior_v1(rows, limit=10_000)
    chunked = features.behavior_v1(rows, limit=70)
    assert chunked.filter("history_limit_exceeded").count() < 260
    kept = chunked.filter("NOT history_limit_exceeded")
    assert kept.exceptAll(whole).isEmpty()


def test_sequence_does_not_depend_on_chunks(spark):
    rows = spark.createDataFrame(rows_of(5, 260, 300 * DAY), TX_SCHEMA)
    whole = sequence.sequence_rows(sequence.sequence_v1(rows))
    chunked = sequence.sequence_rows(sequence.sequence_v1(rows, limit=120))
    assert not chunked.isEmpty()
    assert chunked.exceptAll(whole).isEmpty()


def test_no_group_grows_with_its_key(spark):
    limit = 9
    rows = spark.createDataFrame(rows_of(13, 400, 30 * DAY), TX_SCHEMA)
    frame = history.history_frame(rows, limit)
    assert frame.filter("is_candidate").count() == 400
    largest = frame.filter("is_history").groupBy(*history.GROUP).count().agg(F.max("count"))
    assert largest.first()[0] <= 2 * (limit + 1)


def test_many_long_keys_need_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(history, "BROADCAST_KEYS", 1)
    rows = rows_of(17, 220, 400 * DAY)
    frame = features.velocity(spark.createDataFrame(rows, TX_SCHEMA), limit=9)
    expected = brute(rows, 9)
    for row in frame.collect():
        values = expected[row.transaction_id]
        assert row.history_limit_exceeded is (values is None)
        if values:
            assert row.activity_history_count == values[2]


def test_partitioning_does_not_matter(spark):
    rows = spark.createDataFrame(rows_of(19, 200, 60 * DAY), TX_SCHEMA)
    one = features.behavior_v1(rows.coalesce(1))
    seven = features.behavior_v1(rows.repartition(7))
    assert one.exceptAll(seven).isEmpty()


def test_statistics_of_long_keys(spark):
    rows = spark.createDataFrame(rows_of(23, 300, 30 * DAY), TX_SCHEMA)
    arrays = profiles.amount_statistics(rows)
    histogram = profiles.amount_statistics(rows, limit=1)
    assert arrays.exceptAll(histogram.select(*arrays.columns)).isEmpty()
    windows = {"long": 180, "short": 9}
    as_of = 1_700_000_000_000_000 + 30 * DAY
    left = profiles.window_statistics(rows, as_of, windows)
    right = profiles.window_statistics(rows, as_of, windows, limit=1)
    assert left.exceptAll(right.select(*left.columns)).isEmpty()


def test_later_admissions_do_not_count(spark):
    """One row admitted on day 0, five on day 100: a candidate of day 10 sees one."""
    base = 1_700_000_000_000_000
    early = [(i, 1, "KZT", base + i * DAY, 100 + i, 1, "phone", None, "UTC") for i in range(6)]
    rows = [r[:7] + (base if r[0] == 0 else base + 100 * DAY, "UTC") for r in early]
    rows.append((9, 1, "KZT", base + 10 * DAY, 500, 1, "phone", None, "UTC"))
    found = features.behavior_v1(spark.createDataFrame(rows, TX_SCHEMA)).filter("transaction_id = 9")
    row = found.first()
    assert (row.long_history_count, row.baseline_insufficient) == (1, 1)


def test_no_value_from_a_cut_history(spark):
    rows = spark.createDataFrame(rows_of(29, 120, 20 * DAY), TX_SCHEMA)
    frame = features.with_velocity(features.with_device_recency(features.activity_frame(rows, 10)))
    frame = features.with_last_device(features.with_recipient_history(frame))
    found = features.candidates(features.with_baseline(frame.withColumn("profile_since", F.lit(0))))
    beyond = found.filter("history_limit_exceeded")
    assert beyond.count() > 50
    for name in ("n_60m", "first_recipient_us", "last_device", "device_seen", "n_long", "median2_long", "sum_long"):
        assert beyond.filter(F.col(name).isNotNull()).isEmpty(), name


def test_rolling_statistics_by_definition(spark):
    import statistics

    rows = rows_of(31, 200, 250 * DAY)
    rows = [(*r[:7], None if i % 4 == 0 else r[3] + (i % 7) * DAY, r[8]) for i, r in enumerate(rows)]
    frame = features.with_baseline(features.baseline_frame(spark.createDataFrame(rows, TX_SCHEMA)), 60, 9)
    for row in features.candidates(frame).collect():
        held = [
            r[4]
            for r in rows
            if r[1:3] == (row.customer_id, row.currency)
            and row.us - 60 * DAY < r[3] < row.us
            and r[7] is not None
            and r[7] <= row.us
        ]
        if not row.profile_missing:
            assert row.n_long == len(held)
            if held:
                middle = statistics.median(held)
                assert row.median2_long == 2 * middle
                assert row.mad4_long == 4 * statistics.median(abs(v - middle) for v in held)
                assert row.p95_long == sorted(held)[(95 * len(held) + 99) // 100 - 1]
                assert row.sum_long == sum(held)
