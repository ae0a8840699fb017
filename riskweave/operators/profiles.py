"""Behaviour profiles: exact window statistics, revisions, and baseline status."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import amounts
from riskweave.functions.frames import DAY, HOUR, KEYS, add, local_hour
from riskweave.operators.features import MINIMUM_HISTORY, typical_hours
from riskweave.operators.history import GROUP, HISTORY_LIMIT, candidates, history_frame
from riskweave.operators.history import split_by_length
from riskweave.operators.rolling import doubled_median, group_bounds, whole_groups

KEY_LIST = list(KEYS)


# --- exact order statistics ---------------------------------------------------------------------


def _from_arrays(rows: DataFrame) -> DataFrame:
    """Keys of bounded size: one sorted array per key."""
    ordered = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("cents").cast("decimal(18,0)")).alias("sum_cents"),
        F.sort_array(F.collect_list("cents")).alias("_all"),
    )
    ordered = add(ordered, median2=amounts.median2("_all"), p95=amounts.p95("_all"))
    return add(ordered, mad4=amounts.mad4("_all", "median2")).drop("_all")


def _ranked(histogram: DataFrame) -> DataFrame:
    """Adds to (keys, v, n) the cumulative count ``upto`` and the key's ``total``.

    Two levels, as a long key has many values: totals of value slots first, then inside each slot.
    """
    slotted = histogram.withColumn("slot", F.shiftright("v", 16))
    by_slot = Window.partitionBy(*KEYS).orderBy("slot")
    slots = (
        slotted.groupBy(*KEYS, "slot")
        .agg(F.sum("n").alias("slot_n"))
        .select(
            *KEYS,
            "slot",
            (F.sum("slot_n").over(by_slot) - F.col("slot_n")).alias("below"),
            F.sum("slot_n").over(Window.partitionBy(*KEYS)).alias("total"),
        )
    )
    inside = Window.partitionBy(*KEYS, "slot").orderBy("v")
    return slotted.join(slots, [*KEYS, "slot"]).withColumn(
        "upto", F.col("below") + F.sum("n").over(inside)
    )


def _value_at(rank: str) -> str:
    return f"max(CASE WHEN upto - n < {rank} AND {rank} <= upto THEN v END)"


def _median2_at() -> str:
    return f"{_value_at('((total + 1) div 2)')} + {_value_at('(total div 2 + 1)')}"


def _from_histogram(rows: DataFrame) -> DataFrame:
    """Keys of any size: counts per distinct amount, which combine before the shuffle."""
    histogram = rows.groupBy(*KEYS, F.col("cents").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = _ranked(histogram)
    stats = ranked.groupBy(*KEYS).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("v").cast("decimal(18,0)") * F.col("n")).cast("decimal(28,0)").alias(
            "sum_cents"
        ),
        F.expr(_median2_at()).alias("median2"),
        F.expr(_value_at(amounts.nearest_rank("total"))).alias("p95"),
    )
    gaps = (
        histogram.join(stats.select(*KEYS, "median2"), KEY_LIST)
        .groupBy(*KEYS, F.abs(F.col("v") * 2 - F.col("median2")).alias("v"))
        .agg(F.sum("n").alias("n"))
    )
    spread = _ranked(gaps).groupBy(*KEYS).agg(F.expr(_median2_at()).alias("mad4"))
    return stats.join(spread, KEY_LIST)


def amount_statistics(rows: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Per key: n, sum_cents, doubled median, quadrupled MAD and nearest-rank p95, all exact."""
    short, long = split_by_length(rows, limit)
    result = _from_arrays(short)
    if long is None:
        return result
    return result.unionByName(_from_histogram(long).select(*result.columns))


def window_statistics(
    observations: DataFrame, as_of_us: int, windows: dict[str, int], limit: int = HISTORY_LIMIT
) -> DataFrame:
    """Exact statistics of several windows ending at one cutoff, as ``<name>_<statistic>`` columns.

    Keys of bounded size are gathered once for all windows, in one shuffle.
    """
    rows = in_window(observations, as_of_us, max(windows.values()))
    short, long = split_by_length(rows, limit)
    aggregates = []
    for name, days in windows.items():
        inside = f"CASE WHEN us > {as_of_us - days * DAY} THEN cents END"
        aggregates += [
            F.expr(f"count({inside})").alias(f"{name}_n"),
            F.expr(f"sum(CAST({inside} AS DECIMAL(18, 0)))").alias(f"{name}_sum_cents"),
            F.expr(f"sort_array(collect_list({inside}))").alias(f"_{name}"),
        ]
    result = short.groupBy(*KEYS).agg(*aggregates)
    for name in windows:
        column = f"_{name}"
        result = add(
            result,
            **{f"{name}_median2": amounts.median2(column), f"{name}_p95": amounts.p95(column)},
        )
        result = add(result, **{f"{name}_mad4": amounts.mad4(column, f"{name}_median2")})
    result = result.drop(*(f"_{name}" for name in windows))
    if long is None:
        return result
    parts = []
    for name, days in windows.items():
        stats = _from_histogram(in_window(long.drop("key_rows"), as_of_us, days))
        renamed = [F.col(c).alias(f"{name}_{c}") for c in stats.columns if c not in KEYS]
        parts.append(stats.select(*KEYS, *renamed))
    joined = reduce(lambda left, right: left.join(right, KEY_LIST, "full"), parts)
    joined = joined.fillna(0, subset=[f"{name}_n" for name in windows])
    return result.unionByName(joined.select(*result.columns))


# --- descriptive windows ------------------------------------------------------------------------


def in_window(observations: DataFrame, as_of_us: int, days: int) -> DataFrame:
    """Observations strictly before the cutoff and inside its window; nothing is deleted."""
    us = F.col("us")
    return observations.filter((us < as_of_us) & (us > as_of_us - days * DAY))


def hour_histogram(rows: DataFrame) -> DataFrame:
    """24 local-hour counts per key, in one partial aggregation."""
    hours = add(rows, _hour=local_hour("us", "timezone"))
    return hours.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(F.col("_hour") == h).alias(f"h{h:02d}") for h in range(24)),
    )


def hour_view(rows: DataFrame) -> DataFrame:
    """Hour counts as an array, observed hours, and hours frequent enough to be typical."""
    counted = hour_histogram(rows).select(
        *KEYS, "n", F.array(*(f"h{h:02d}" for h in range(24))).alias("hour_counts")
    )
    return add(
        counted,
        typical_hours=typical_hours("hour_counts", "n"),
        observed_hours="filter(sequence(0, 23), h -> get(hour_counts, h) > 0)",
    )


def known_recipients(rows: DataFrame) -> DataFrame:
    """Distinct recipients, one row each, so that a customer with millions stays spread out."""
    return rows.select(*KEYS, "recipient_id").distinct()


def behavior_window(
    observations: DataFrame, as_of_us: int, days: int, limit: int = HISTORY_LIMIT
) -> DataFrame:
    """Amounts, rate, hours and number of known recipients of one window, per key."""
    rows = in_window(observations, as_of_us, days)
    recipients = (
        known_recipients(rows).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("known_recipients"))
    )
    return (
        amount_statistics(rows, limit)
        .join(hour_view(rows).drop("n"), KEY_LIST)
        .join(recipients, KEY_LIST)
        .withColumn("per_day", F.col("n") / F.lit(float(days)))
        .withColumn("days", F.lit(days))
    )


def baseline_status(n: str, version: str) -> str:
    return (
        f"CASE WHEN {version} IS NULL THEN 'UNINITIALIZED' WHEN coalesce({n}, 0) = 0 THEN 'EMPTY' "
        f"WHEN {n} < {MINIMUM_HISTORY} THEN 'INSUFFICIENT_HISTORY' ELSE 'SUFFICIENT_HISTORY' END"
    )


# --- revisions ----------------------------------------------------------------------------------


def revision(revisions: DataFrame, version: int | None = None) -> DataFrame:
    """The latest revision per key, or the pinned one. The maximum combines before the shuffle."""
    if version is not None:
        return revisions.filter(F.col("version") == version)
    rest = [c for c in revisions.columns if c not in (*KEYS, "version")]
    newest = revisions.groupBy(*KEYS).agg(F.max(F.struct("version", *rest)).alias("r"))
    return newest.select(*KEYS, "r.*")


def hydrate(selected: DataFrame, observations: DataFrame, days: int = 180) -> DataFrame:
    """Observations that belong to the selected revisions."""
    head = selected.select(*KEYS, "version", "as_of_us")
    joined = observations.join(head, KEY_LIST)
    return joined.filter(
        (F.col("admitted_version") <= F.col("version"))
        & (F.col("us") <= F.col("as_of_us"))
        & (F.col("us") > F.col("as_of_us") - days * DAY)
    )


def profile_view(
    customers: DataFrame,
    revisions: DataFrame,
    observations: DataFrame,
    as_of_us: int,
    *,
    version: int | None = None,
    currency: str = "KZT",
    long_days: int = 180,
    short_days: int = 30,
) -> DataFrame:
    """One row per customer: revision read, status and both windows at a cutoff.

    A cutoff before the revision's own time cannot be answered and is marked ``unavailable``.
    """
    head = revision(revisions, version)
    visible = (
        observations.join(head.select(*KEYS, "version", "as_of_us"), KEY_LIST)
        .filter("admitted_version <= version")
        .drop("version", "as_of_us")
    )
    stats = window_statistics(visible, as_of_us, {"long": long_days, "short": short_days})
    view = (
        customers.withColumn("currency", F.lit(currency))
        .join(head.select(*KEYS, "version", "as_of_us"), KEY_LIST, "left")
        .join(stats, KEY_LIST, "left")
    )
    view = view.fillna(0, subset=["long_n", "short_n"])
    unavailable = F.coalesce(F.col("as_of_us") > as_of_us, F.lit(False))
    return add(view, status=baseline_status("long_n", "version")).withColumn(
        "unavailable", unavailable
    )


def _revision_windows(rows: dict[str, list], span: int) -> list[tuple[int, int, int | None]]:
    """Per row of one group: rows of any version in its window before it, then how many rows of its
    window its version holds, and their doubled median.

    Rows are sorted by time and version. Versions are taken up in order; the window moves over the
    rows held so far, which are kept by time, forward as a rule and back where versions and times
    disagree.
    """
    us, versions, cents = rows["us"], rows["admitted_version"], rows["cents"]
    out: list[tuple[int, int, int | None]] = [(0, 0, None)] * len(us)
    earlier = 0
    held: list[tuple[int, int]] = []
    low = high = 0
    ordered: list[int] = []
    for _, same in groupby(sorted(range(len(us)), key=versions.__getitem__), key=versions.__getitem__):
        same = list(same)
        for i in same:
            at = bisect_left(held, (us[i], i))
            held.insert(at, (us[i], i))
            if at < low:
                low, high = low + 1, high + 1
            elif at < high:
                high += 1
                insort(ordered, cents[i])
        for i in same:
            now = us[i]
            while high < len(held) and held[high][0] <= now:
                insort(ordered, cents[held[high][1]])
                high += 1
            while low < high and held[low][0] <= now - span:
                del ordered[bisect_left(ordered, cents[held[low][1]])]
                low += 1
            while low > 0 and held[low - 1][0] > now - span:
                low -= 1
                insort(ordered, cents[held[low][1]])
            while high > low and held[high - 1][0] > now:
                high -= 1
                del ordered[bisect_left(ordered, cents[held[high][1]])]
            out[i] = (0, len(ordered), doubled_median(ordered))
    for i, now in enumerate(us):
        while us[earlier] <= now - span:
            earlier += 1
        out[i] = (i - earlier, *out[i][1:])
    return out


def revision_summary(
    observations: DataFrame, days: int = 180, limit: int = HISTORY_LIMIT
) -> DataFrame:
    """Count and doubled median of the long window of every revision, at its own time.

    An admission needs an evaluated transaction, whose history is bounded. A revision with more than
    ``limit`` rows of any version before it in its window is refused (``history_limit_exceeded``)
    and has no values.
    """
    order = F.lpad(F.col("admitted_version").cast("string"), 20, "0")  # places rows of one instant
    needed = observations.select(
        order.alias("transaction_id"), *KEYS, "us", "cents", F.col("admitted_version").cast("bigint")
    )
    frame = history_frame(needed, limit, refuse=False, instants=False).drop("history_limit_exceeded")
    ordered = frame.sortWithinPartitions(*GROUP, "us", "transaction_id")
    schema = ", ".join(f"{c} {k}" for c, k in frame.dtypes) + ", _prior bigint, _n int, _median2 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            starts = group_bounds(table)
            rows = table.select(["us", "admitted_version", "cents"]).to_pydict()
            found: list[tuple] = []
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                found += _revision_windows({k: v[a:b] for k, v in rows.items()}, days * DAY)
            for k, (name, kind) in enumerate((("_prior", pa.int64()), ("_n", pa.int32()), ("_median2", pa.int64()))):
                table = table.append_column(name, pa.array([x[k] for x in found], kind))
            yield from table.to_batches()

    return candidates(ordered.mapInArrow(run, schema)).selectExpr(
        *KEYS,
        "admitted_version AS version",
        "us AS as_of_us",
        f"_prior > {limit} AS history_limit_exceeded",
        f"CASE WHEN _prior <= {limit} THEN _n END AS n_long",
        f"CASE WHEN _prior <= {limit} THEN _median2 END AS median2",
    )


def stored_profiles(tx: DataFrame, revisions: DataFrame, observations: DataFrame) -> DataFrame:
    """Adds the stored profile of each transaction's own time.

    A revision is in force from its ``created_us`` (when its decision was made, which may be days
    after the rows it admits) until a higher version is. ``version``, ``timezone``, ``long_days`` and
    ``short_days`` are those in force at the transaction's time (NULL, UTC, 180 and 30 before the
    first), ``profile_us`` is when the key's first revision was made. ``admitted_us`` is when the row
    came into force as an observation: with the first revision that was made of its
    ``admitted_version`` or a higher one. Revisions may be missing and may be made out of order.
    """
    kept = tx.drop("admitted_us", "timezone", "version", "long_days", "short_days", "profile_us")
    shape = F.struct("version", "timezone", "long_days", "short_days")
    made = revisions.select(*KEYS, "created_us", F.col("version").cast("bigint").alias("version"), shape.alias("shape"))

    # In force: the highest version made by then. Instants are doubled, so that a revision comes
    # before a transaction of its own instant.
    rows = kept.withColumns({"us": F.col("us") * 2 + 1, "shape": F.lit(None).cast(made.schema["shape"].dataType)})
    both = rows.withColumn("is_row", F.lit(True)).unionByName(
        made.select(*KEYS, (F.col("created_us") * 2).alias("us"), "shape", F.lit(False).alias("is_row")),
        allowMissingColumns=True,
    )
    both = running_before(both, {}, {"now": "shape"}).filter("is_row").drop("is_row", "shape")
    named = both.withColumns(
        {
            "us": F.floor((F.col("us") - 1) / 2),
            "version": F.col("now.version"),
            "timezone": F.coalesce("now.timezone", F.lit("UTC")),
            "long_days": F.coalesce("now.long_days", F.lit(180)),
            "short_days": F.coalesce("now.short_days", F.lit(30)),
        }
    ).drop("now")

    # Admitted: the earliest of the revisions from a version on, by running over falling versions.
    # A cell of the running maximum holds a thousand versions.
    step = HOUR // 1000
    order = lambda version, late: (-2 * F.col(version) + late) * (step // 2)
    seen = observations.select("transaction_id", *KEYS, order("admitted_version", 1).alias("us"))
    later = made.select(*KEYS, order("version", 0).alias("us"), (-F.col("created_us")).alias("minus"))
    both = seen.unionByName(later, allowMissingColumns=True)
    both = running_before(both, {}, {"first": "minus"}).filter("transaction_id IS NOT NULL")
    admitted = both.filter("first IS NOT NULL").select("transaction_id", *KEYS, (-F.col("first")).alias("admitted_us"))
    began = revisions.groupBy(*KEYS).agg(F.min("created_us").alias("profile_us"))
    return named.join(admitted, ["transaction_id", *KEYS], "left").join(began, KEY_LIST, "left")


def running_before(rows: DataFrame, sums: dict[str, str], maxima: dict[str, str]) -> DataFrame:
    """Running sums and maxima over all earlier instants of a key, in two levels.

    Hour cells are accumulated over a small cell table, then rows inside their cell, so that one
    long key is spread over its hours.
    """
    rows = add(rows, _cell=f"us div {HOUR}")
    totals = [F.expr(f"sum({v})").alias(f"_{k}") for k, v in sums.items()]
    totals += [F.expr(f"max({v})").alias(f"_{k}") for k, v in maxima.items()]
    earlier = Window.partitionBy(*KEYS).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        rows.groupBy(*KEYS, "_cell")
        .agg(*totals)
        .select(
            *KEYS,
            "_cell",
            *(F.sum(f"_{k}").over(earlier).alias(f"_{k}") for k in sums),
            *(F.max(f"_{k}").over(earlier).alias(f"_{k}") for k in maxima),
        )
    )
    inside = (
        f"OVER (PARTITION BY {', '.join(KEYS)}, _cell ORDER BY us "
        "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    joined = rows.join(cells, [*KEYS, "_cell"])
    joined = add(
        joined,
        **{k: f"coalesce(_{k}, 0) + coalesce(sum({v}) {inside}, 0)" for k, v in sums.items()},
        **{k: f"greatest(_{k}, max({v}) {inside})" for k, v in maxima.items()},
    )
    return joined.drop("_cell", *(f"_{k}" for k in (*sums, *maxima)))


def prior_revisions(tx: DataFrame, revisions: DataFrame) -> DataFrame:
    """Verified revisions strictly older than each transaction: how many, and the newest.

    The revisions themselves are the first ``prior_revisions`` verified ones of the key, in order.
    """
    none = F.lit(None)
    both = tx.select(
        *KEYS, "us", "transaction_id", none.cast("bigint").alias("version")
    ).unionByName(
        revisions.filter("verified").select(
            *KEYS,
            F.col("as_of_us").alias("us"),
            none.cast("bigint").alias("transaction_id"),
            F.col("version").cast("bigint").alias("version"),
        )
    )
    counted = running_before(
        both,
        {"prior_revisions": "CASE WHEN version IS NOT NULL THEN 1 ELSE 0 END"},
        {"latest_version": "version"},
    )
    return counted.filter("version IS NULL").drop("version")


def revision_violations(revisions: DataFrame) -> DataFrame:
    """Revisions that do not follow their predecessor: a gap, or time running backwards.

    The predecessor is found by an equi-join on version, so one long history is spread out.
    """
    older = revisions.select(
        *KEYS,
        (F.col("version") + 1).alias("version"),
        F.col("as_of_us").alias("before_us"),
        F.lit(True).alias("has_before"),
    )
    joined = revisions.join(older, [*KEYS, "version"], "left")
    found = F.array_compact(
        F.array(
            F.when((F.col("version") > 1) & F.col("has_before").isNull(), "version_gap"),
            F.when(F.col("as_of_us") < F.col("before_us"), "time_backwards"),
        )
    )
    marked = joined.select(*KEYS, "version", F.array_join(found, ",").alias("violations"))
    return marked.filter("violations <> ''")


def dropped_observations(
    before: DataFrame, after: DataFrame, as_of_us: int, days: int = 180
) -> DataFrame:
    """Observations still inside the window that a new revision lost."""
    return in_window(before, as_of_us, days).join(
        after.select("transaction_id"), "transaction_id", "left_anti"
    )


def provenance_violations(revisions: DataFrame) -> DataFrame:
    """Verified exactly when both the policy and the learning decision are named."""
    complete = F.col("policy_version").isNotNull() & F.col("decision_id").isNotNull()
    return revisions.filter(F.col("verified") != complete)


def unbacked_revisions(revisions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Verified revisions without the ACCEPT decision that should have produced them."""
    accepted = decisions.filter("action = 'ACCEPT'").select(
        *KEYS,
        "decision_id",
        F.col("policy_version"),
        F.col("version_after").alias("version"),
    )
    return revisions.filter("verified").join(
        accepted, [*KEYS, "decision_id", "policy_version", "version"], "left_anti"
    )
