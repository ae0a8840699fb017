"""Authored cases with known answers."""

import math
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import NOW, TX_SCHEMA, micros
from riskweave.functions.text import general6
from riskweave.operators import (
    cases,
    datasets,
    features,
    learning,
    metrics,
    profiles,
    risk,
    rules,
    sequence,
)
from riskweave.schemas import CASE_MOVES, CASE_STATES, FEATURE_NAMES

MIN = timedelta(minutes=1)
DAY = timedelta(days=1)


def vector_of(spark, ledger, ident, **options):
    frame = features.behavior_v1(ledger.frame(spark), **options)
    return frame.filter(F.col("transaction_id") == ident).first()


def baseline_only(spark, ledger, ident):
    frame = features.candidates(features.with_baseline(features.baseline_frame(ledger.frame(spark))))
    return frame.filter(F.col("transaction_id") == ident).first()


def test_base_profile(spark, ledger):
    ledger.baseline()
    stats = profiles.amount_statistics(ledger.frame(spark)).first()
    assert (stats.n, stats.median2, stats.mad4) == (20, 6_000_000, 2_000_000)
    assert (stats.p95, stats.sum_cents) == (5_000_000, 64_000_000)
    hours = profiles.hour_view(ledger.frame(spark)).first()
    assert hours.typical_hours == [12] and hours.observed_hours == [12]


def test_all_features(spark, ledger):
    ledger.baseline()
    for minutes, recipient in ((4, 1), (5, 1), (9, 2), (10, 1), (59, 1), (60, 1), (14_400, 1)):
        ledger.add(NOW - minutes * MIN, recipient=recipient, device="old")
    me = ledger.add(NOW, 3_000_000, recipient=1, device="new")
    row = vector_of(spark, ledger, me)
    assert row.amount == 30000.0
    assert (row.transactions_last_5_min, row.transactions_last_10_min) == (1, 3)
    assert (row.transactions_last_hour, row.recipient_transactions_last_hour) == (5, 4)
    assert row.amount_vs_customer_median == 1.0 and row.amount_vs_customer_mean == 0.9375
    assert row.amount_vs_p95 == 0.6 and row.robust_amount_deviation == 0.0
    assert (row.long_history_count, row.short_history_count) == (20, 20)
    assert row.device_changed == 1.0 and row.device_not_seen_before == 1.0
    assert row.unusual_hour == 0.0 and row.typical_hours_missing == 0.0
    assert row.days_since_last_transfer == 4 / 1440
    assert row.new_recipient == 0.0 and row.short_term_vs_long_term_amount_ratio == 1.0


@pytest.mark.parametrize("count", [0, 1, 4])
def test_cold_profile(spark, ledger, count):
    ledger.baseline(count)
    me = ledger.add(NOW)
    row = vector_of(spark, ledger, me)
    assert row.profile_missing == float(count == 0)
    assert row.baseline_insufficient == 1.0 and row.typical_hours_missing == 1.0
    assert row.long_history_count == count
    assert row.amount_vs_customer_median == 0.0 and row.new_recipient == 0.0


def test_zero_mad(spark, ledger):
    for i in range(20):
        ledger.add(NOW - (i + 1) * DAY, 3_000_000, admitted=True)
    me = ledger.add(NOW, 50_000_000)
    row = vector_of(spark, ledger, me)
    assert row.robust_amount_deviation == 47_000_000.0
    assert row.mad_zero == 1.0 and row.mad_floor_applied == 1.0


def test_circular_hour(spark, ledger):
    for i in range(20):
        ledger.add(NOW - (40 + i) * DAY, admitted=True)
    me = ledger.add(NOW + timedelta(hours=11))
    row = vector_of(spark, ledger, me)
    assert row.hour_deviation == 11.0 and row.unusual_hour == 1.0
    assert row.short_baseline_insufficient == 1.0


def test_tied_devices(spark, ledger):
    ledger.add(NOW - MIN, device="a")
    ledger.add(NOW - MIN, device="b")
    me = ledger.add(NOW, device="a")
    row = vector_of(spark, ledger, me)
    assert row.device_change_missing == 1.0 and row.device_changed == 0.0
    assert row.device_not_seen_before == 0.0


def test_activity_bounds(spark, ledger):
    at = micros(NOW)
    day, minute = 86_400_000_000, 60_000_000
    for offset in (
        181 * day, 180 * day, 180 * day - 1, 60 * minute, 10 * minute, 5 * minute, minute, 0, -minute
    ):
        ledger.add(NOW, us=at - offset)
    ledger.add(NOW - MIN, currency="USD")
    ledger.add(NOW - MIN, customer=2)
    me = ledger.add(NOW)
    row = vector_of(spark, ledger, me)
    assert row.activity_history_count == 5
    assert (row.transactions_last_5_min, row.transactions_last_10_min) == (1, 2)
    assert row.transactions_last_hour == 3


def test_repeated_local_hour(spark, ledger):
    for hour in (5, 6):
        ledger.add(datetime(2025, 11, 2, hour, 30, tzinfo=UTC), zone="America/New_York")
    row = profiles.hour_histogram(ledger.frame(spark)).first()
    assert row.h01 == 2


def outcomes(spark, ledger, ident, policy=sequence.SequencePolicy()):
    rows = sequence.sequence_rows(sequence.sequence_v1(ledger.frame(spark), policy))
    return {r.code: r for r in rows.filter(F.col("transaction_id") == ident).collect()}


def test_low_and_slow(spark, ledger):
    ledger.baseline()
    for minutes, cents in ((30, 1_000_000), (20, 1_500_000), (10, 2_000_000)):
        ledger.add(NOW - minutes * MIN, cents)
    me = ledger.add(NOW, 2_500_000)
    found = outcomes(spark, ledger, me)["CUMULATIVE_LOW_VALUE_SEQUENCE"]
    assert found.status == "MATCHED" and found.observed_cents == 7_000_000
    ruled = rules.rule_rows(rules.rules_v1(features.behavior_v1(ledger.frame(spark))))
    amount = ruled.filter(f"transaction_id = {me} AND code = 'AMOUNT_ANOMALY'").first()
    assert amount.status == "NOT_MATCHED"


def test_escalation(spark, ledger):
    ledger.baseline()
    for minutes, cents in ((30, 1_000_000), (20, 2_000_000), (10, 3_000_000)):
        ledger.add(NOW - minutes * MIN, cents)
    me = ledger.add(NOW, 4_000_000)
    found = outcomes(spark, ledger, me)
    assert found["GRADUAL_AMOUNT_ESCALATION"].status == "MATCHED"
    assert found["GRADUAL_AMOUNT_ESCALATION"].growth_ratio == 4.0
    assert found["CUMULATIVE_AMOUNT_EXPOSURE"].status == "NOT_MATCHED"


def test_day_bound(spark, ledger):
    for i in range(20):
        ledger.add(NOW - (i + 2) * DAY, admitted=True)
    ledger.add(NOW, 4_000_000, us=micros(NOW) - 86_400_000_000)
    ledger.add(NOW, 4_000_000, us=micros(NOW) - 86_400_000_000 + 1)
    me = ledger.add(NOW, 2_500_000)
    found = outcomes(spark, ledger, me)["CUMULATIVE_AMOUNT_EXPOSURE"]
    assert found.observed_count == 2 and found.observed_cents == 6_500_000


def test_unverified_profile_is_not_evaluated(spark, ledger):
    ledger.baseline()
    me = ledger.add(NOW)
    tx = ledger.frame(spark).withColumn("profile_verified", F.lit(False))
    rows = sequence.sequence_rows(sequence.sequence_v1(tx)).filter(f"transaction_id = {me}")
    assert {(r.status, r.missing) for r in rows.collect()} == {
        ("NOT_EVALUATED", "profile_workflow_unverified")
    }


GATE = "transaction_id bigint, customer_id bigint, currency string, us bigint, cents bigint, verdict string, is_seed boolean"


def fold(spark, events, limit=10_000):
    rows = []
    for i in range(20):
        cents = (2_000_000, 2_500_000, 3_000_000, 3_500_000, 5_000_000)[i % 5]
        rows.append((1000 + i, 1, "KZT", micros(NOW - (i + 1) * DAY), cents, "LEGITIMATE", True))
    for i, (moment, cents, verdict) in enumerate(events):
        rows.append((i, 1, "KZT", micros(moment), cents, verdict, False))
    folded = learning.gate_fold(spark.createDataFrame(rows, GATE), limit).filter("transaction_id < 1000")
    return {r.transaction_id: r for r in folded.collect()}


def test_gate_outlier_and_bound(spark):
    got = fold(
        spark,
        [
            (NOW + DAY, 800_000_000, "LEGITIMATE"),
            (NOW + 2 * DAY, 50_000_000, "CONFIRMED_FRAUD"),
            (NOW + 3 * DAY, 30_000_000, "LEGITIMATE"),
            (NOW + 4 * DAY, 29_999_999, "LEGITIMATE"),
            (NOW + 5 * DAY, 3_000_000, None),
        ],
    )
    assert [got[i].action for i in range(5)] == [
        "QUARANTINE", "REJECT_FROM_PROFILE", "QUARANTINE", "ACCEPT", "QUARANTINE"
    ]
    assert got[2].reason == "EXCEPTIONAL_LEGITIMATE_AMOUNT" and got[4].reason == "UNVERIFIED"
    assert got[3].median2_trusted == 6_000_000 and got[3].version_after == 2


def test_gate_drift(spark):
    events = [(NOW + (d + 1) * DAY, 3_000_000 + 150_000 * d, "LEGITIMATE") for d in range(60)]
    got = fold(spark, events)
    assert {r.action for r in got.values()} == {"ACCEPT"}
    assert got[59].version_after == 61 and got[59].n_trusted == 79


def test_long_key_fold_equals_sorted_fold(spark):
    """A long key with sparse activity: every row is evaluable, and the fixed point is the fold."""
    rows, start = [], NOW - 4000 * DAY
    for i in range(120):
        cents = 3_000_000 if i % 7 else 60_000_000
        verdict = None if i % 11 == 5 else "CONFIRMED_FRAUD" if i % 13 == 6 else "LEGITIMATE"
        rows.append((i, 1, "KZT", micros(start + i * 6 * DAY), cents * (1 + i // 9), verdict, i < 5))
    frame = spark.createDataFrame(rows, GATE)
    left, right = learning.gate_fold(frame), learning.gate_fold(frame, limit=40)
    assert left.exceptAll(right.select(*left.columns)).isEmpty()


def test_score_bands(spark):
    values = []
    for edge in (0.35, 0.65, 0.85):
        values += [math.nextafter(edge, 0), edge, math.nextafter(edge, 1)]
    rows = spark.createDataFrame([(v,) for v in values], "score double")
    got = [r[0] for r in rows.select(risk.level(F.col("score"))).collect()]
    assert got == ["LOW"] + ["MEDIUM"] * 3 + ["HIGH"] * 3 + ["CRITICAL"] * 2


def test_partial_evidence_abstains(spark, ledger):
    for i in range(20):
        ledger.add(NOW - (i + 1) * DAY, admitted=True)
    ledger.rows = [(*r[:3], r[3] - 181 * 86_400_000_000, *r[4:7], r[3] - 181 * 86_400_000_000, r[8]) for r in ledger.rows]
    me = ledger.add(NOW, 800_000_000)
    row = risk.risk(rules.rules_v1(features.behavior_v1(ledger.frame(spark)))).filter(
        f"transaction_id = {me}"
    ).first()
    assert row.score is None and row.level is None and row.status == "INSUFFICIENT_EVIDENCE"
    assert "HIGH_VELOCITY" in row.unavailable_rules and "DEVICE_CHANGED" in row.unavailable_rules


def test_policies_refuse_bad_values():
    for build in (
        lambda: rules.RulePolicy(1.0),
        lambda: rules.RulePolicy(prior_transfers_5_min=0),
        lambda: risk.RiskPolicy("other"),
        lambda: risk.RiskPolicy(rule_weights=(0.5, 0.5, 0.1, 0.1, 0.1)),
        lambda: risk.DecisionPolicy(0.7, 0.6, 0.9),
        lambda: sequence.SequencePolicy(escalation_growth_ratio=Decimal("1")),
    ):
        with pytest.raises(ValueError):
            build()


def test_transition_matrix(spark):
    rows = [
        (i, 1, a, b, 10, "x") for i, (a, b) in enumerate((a, b) for a in CASE_STATES for b in CASE_STATES)
    ]
    moves = spark.createDataFrame(
        rows, "case_id int, sequence int, previous string, target string, at_us bigint, actor string"
    )
    opened = moves.select("case_id", F.lit(0).cast("bigint").alias("created_us"))
    checked = cases.check_transitions(moves, opened)
    legal = checked.filter("NOT array_contains(violations, 'illegal_move')")
    assert {(r.previous, r.target) for r in legal.collect()} == set(CASE_MOVES)


def test_confusion_and_threshold(spark):
    scored = spark.createDataFrame(
        [(0, 0.1), (0, 0.6), (1, 0.4), (1, 0.9)], "label int, score double"
    )
    row = metrics.confusion(scored, 0.5).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (1, 1, 1, 1)
    best = metrics.best_threshold(metrics.threshold_grid(scored)).first()
    assert best.threshold == 0.4
    ranked = metrics.ranking(scored).first()
    assert ranked.roc_auc == 0.75
    assert abs(ranked.average_precision - (0.5 + 0.5 * 2 / 3)) < 1e-12


def test_many_scores_match_few(spark):
    rows = spark.range(3000).selectExpr("(id * 7919 % 1000) / 1000D AS score", "int(id % 3 = 0) AS label")
    few, many = metrics.cumulative(rows, slots=2), metrics.cumulative(rows, slots=50)
    assert few.exceptAll(many.select(*few.columns)).isEmpty()


def test_late_arrival_is_not_known(spark, ledger):
    ledger.add(NOW - 10 * MIN)
    ledger.add(NOW - 5 * MIN)
    me = ledger.add(NOW)
    late = F.when(F.col("transaction_id") == 2, 60_000_000 * 20).otherwise(0)
    labeled = ledger.frame(spark).withColumns(
        {"available_us": F.col("us") + late, "label_available_us": F.col("us"), "label": F.lit(0)}
    )
    row = datasets.prepare(labeled).filter(f"transaction_id = {me}").first()
    assert row.activity_history_count == 1.0


def test_first_occurrence(spark):
    rows = spark.createDataFrame(
        [(129600.0, 2, 1.0, 0.0), (2.0, 3, 2.0, 1.0), (2.0, 4, 2.0, 0.0), (4.0, 5, 3.0, 0.0)],
        "Time double, source_row int, V1 double, Class double",
    )
    rows = rows.withColumn("V1", F.when(F.col("source_row") == 2, 2.0).otherwise(F.col("V1")))
    kept = datasets.first_feature_occurrence(rows, ("V1",), "Time", "source_row")
    assert sorted(r.source_row for r in kept.collect()) == [3, 5]


def test_six_digits(spark):
    values = [0.0, 1.5, 4.453125, -10.04375, 12345.65, 123456.5, 1e-5, 1234567.0, 0.1, 2 / 3, 1e10]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in rows.select(general6(F.col("v"))).collect()]
    assert got == [f"{v:.6g}" for v in values]


def test_contract_names():
    assert len(FEATURE_NAMES) == 29 and set(FEATURE_NAMES) == set(features.FEATURES)
    assert TX_SCHEMA
