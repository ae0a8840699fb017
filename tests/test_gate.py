"""Values do not depend on how a key is cut: the gate in slices, the windows of revisions."""

import random

import pytest

from riskweave.functions.frames import DAY
from riskweave.operators import learning, profiles

GATE = (
    "transaction_id bigint, customer_id bigint, currency string, us bigint, cents bigint, "
    "verdict string, is_seed boolean, evaluable boolean"
)


def reviewed(seed, n, keys, step):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        verdict = r.choice(["LEGITIMATE"] * 4 + ["CONFIRMED_FRAUD", None])
        cents = r.choice([3_000, 3_100, 2_900, 29_000, 31_000, 40_000]) + r.randrange(50)
        seeded = i < 5 * keys
        rows.append((i, i % keys, "KZT", r.randrange(n) * step, cents, verdict, seeded, r.random() < 0.9))
    return rows


@pytest.mark.parametrize("seed, n, keys, step", [(1, 300, 1, DAY // 4), (2, 200, 3, 2 * DAY), (3, 120, 2, 9 * DAY)])
def test_fold_is_the_same_for_any_limit(spark, seed, n, keys, step):
    rows = spark.createDataFrame(reviewed(seed, n, keys, step), GATE)
    whole = {r.transaction_id: tuple(r) for r in learning.gate_fold(rows, 1_000).collect()}
    assert len({x[4] for x in whole.values()}) >= 4
    for limit in (10, 37):
        cut = learning.gate_fold(rows, limit)
        assert {r.transaction_id: tuple(r) for r in cut.collect()} == whole


def test_counts_beyond_the_limit_are_whole(spark):
    rows = [(i, 1, "KZT", i * DAY // 2, 1_000 + i, "LEGITIMATE", i < 5, True) for i in range(300)]
    folded = learning.gate_fold(spark.createDataFrame(rows, GATE), 10)
    assert {r.transaction_id: r.n_trusted for r in folded.collect()}[299] == 299


OBSERVED = "customer_id bigint, currency string, us bigint, cents bigint, admitted_version bigint"


def summary(rows, limit, days=180):
    out = {}
    for c, _, us, _, v in rows:
        window = [p for p in rows if p[0] == c and us - days * DAY < p[2] <= us]
        prior = sum((p[2], p[4]) < (us, v) for p in window)
        a = sorted(p[3] for p in window if p[4] <= v)
        values = (None, None) if prior > limit else (len(a), a[(len(a) - 1) // 2] + a[len(a) // 2])
        out[c, v] = (us, prior > limit, *values)
    return out


@pytest.mark.parametrize("limit", [5, 12, 1_000])
@pytest.mark.parametrize("shuffled", [False, True])
def test_windows_of_revisions(spark, limit, shuffled):
    """Versions follow time as a rule; where they do not, each still holds what its number says."""
    r = random.Random(limit)
    rows = []
    for c in range(3):
        times = sorted(r.randrange(60) * 7 * DAY for _ in range(60))
        versions = list(range(1, 61))
        if shuffled:
            r.shuffle(versions)
        rows += [(c, "KZT", t, r.randrange(1_000), v) for t, v in zip(times, versions, strict=True)]
    found = profiles.revision_summary(spark.createDataFrame(rows, OBSERVED), limit=limit).collect()
    got = {(x.customer_id, x.version): (x.as_of_us, x.history_limit_exceeded, x.n_long, x.median2) for x in found}
    assert got == summary(rows, limit)


def test_a_cut_window_has_no_value(spark):
    rows = [(1, "KZT", i * DAY // 2, i, i + 1) for i in range(300)]
    found = profiles.revision_summary(spark.createDataFrame(rows, OBSERVED), limit=10).collect()
    assert {(x.history_limit_exceeded, x.n_long) for x in found if x.version > 11} == {(True, None)}
    assert {x.n_long for x in found if x.version <= 11} == set(range(1, 12))
