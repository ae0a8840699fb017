"""Bounded history groups: the partitioning every point-in-time operator shares.

A candidate row needs the rows of its customer and currency that lie before it. The contract bounds
that history: more than ``limit`` prior rows inside the activity window is refused, never truncated.
So a candidate at position ``p`` of its key needs at most the ``limit + 1`` rows right before it,
and a long key can be cut into chunks of ``limit + 1`` positions. Each chunk also receives the rows
of the chunk before. No group ever holds more than two chunks of history, however many rows one
customer has, and the answer (including "more than limit") is exact.

Who needs values beyond the limit too asks for a ``whole`` frame. A long key is then cut into slots of
the activity span, each with the slot before, so that a group holds all that its candidates can see.

Keys with at most ``limit`` rows are one chunk and need no positions at all. How many longer keys
there are is counted first; their table is broadcast only when that count is small.

All windows of a frame partition by (customer_id, currency, chunk [, one more column]), so the one
shuffle serves every one of them. Windows of the same order are applied next to each other: one sort
for the group, one for its recipients and one for its devices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.frames import DAY, HOUR, KEYS, add, prior_count

HISTORY_LIMIT = 10_000
ACTIVITY_SPAN = 180 * DAY
BROADCAST_KEYS = 100_000

GROUP = (*KEYS, "chunk")


def long_histories(
    rows: DataFrame, limit: int = HISTORY_LIMIT, extras: dict[str, str] | None = None
) -> DataFrame:
    """Keys with more than ``limit`` rows, with their row count and extra aggregates."""
    aggregates = [F.expr(value).alias(name) for name, value in (extras or {}).items()]
    return (
        rows.groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("key_rows"), *aggregates)
        .filter(F.col("key_rows") > limit)
    )


def split_by_length(
    rows: DataFrame, limit: int = HISTORY_LIMIT, extras: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of short keys, rows of long keys with ``key_rows`` and extras, or None)."""
    longer = long_histories(rows, limit, extras)
    found = longer.limit(BROADCAST_KEYS + 1).count()
    if not found:
        return rows, None
    if found <= BROADCAST_KEYS:
        longer = F.broadcast(longer)
    # Beyond the bound this is a sort-merge join, whose skewed partitions AQE splits.
    return rows.join(longer.select(*KEYS), list(KEYS), "left_anti"), rows.join(longer, list(KEYS))


def positions(rows: DataFrame) -> DataFrame:
    """Adds ``place`` (0-based position by time) and ``older`` (rows of an earlier instant).

    Two levels: a key's rows are ranked inside hour cells, and cell totals are accumulated over the
    far smaller cell table, so one long key is spread over all its hours.
    """
    rows = rows.withColumn("cell", F.floor(F.col("us") / HOUR).cast("bigint"))
    by_cell = Window.partitionBy(*KEYS).orderBy("cell")
    cells = (
        rows.groupBy(*KEYS, "cell")
        .agg(F.count(F.lit(1)).alias("cell_rows"))
        .select(
            *KEYS,
            "cell",
            (F.sum("cell_rows").over(by_cell) - F.col("cell_rows")).alias("cell_base"),
        )
    )
    in_cell = Window.partitionBy(*KEYS, "cell")
    return (
        rows.join(cells, [*KEYS, "cell"])
        .withColumn(
            "place",
            F.col("cell_base")
            + F.row_number().over(in_cell.orderBy("us", F.col("transaction_id").cast("string")))
            - 1,
        )
        .withColumn("older", F.col("cell_base") + F.rank().over(in_cell.orderBy("us")) - 1)
        .drop("cell", "cell_base")
    )


def _chunked(rows: DataFrame, depth: Column, instants: bool = True) -> DataFrame:
    """``depth`` may differ from key to key, not within one. Without ``instants`` a row also needs
    the rows of its own instant that are placed before it."""
    placed = positions(rows)
    own = F.floor(F.col("older" if instants else "place") / depth).cast("bigint")
    home = F.floor(F.col("place") / depth).cast("bigint")
    has_next = (home + 1) * depth < F.col("key_rows")
    yes, no = F.lit(True), F.lit(False)
    return _with_roles(
        placed,
        _role(home, own == home, True),
        F.when(own != home, _role(own, yes, False)),
        F.when(has_next, _role(home + 1, no, True)),
    ).drop("place", "older", "key_rows")


def _slotted(rows: DataFrame) -> DataFrame:
    """Chunks are the spans since the key's first row. What a candidate sees lies in its own and in
    the one before, however much that is."""
    home, last = (F.expr(f"({until} - key_first) div {ACTIVITY_SPAN}") for until in ("us", "key_last"))
    return _with_roles(
        rows,
        _role(home, F.lit(True), True),
        F.when(home < last, _role(home + 1, F.lit(False), True)),
    ).drop("key_rows", *SLOT_BOUNDS)


SLOT_BOUNDS = {"key_first": "min(us)", "key_last": "max(us)"}


def _role(chunk: Column, candidate: Column, history: bool) -> Column:
    return F.struct(
        chunk.alias("chunk"),
        candidate.alias("is_candidate"),
        F.lit(history).alias("is_history"),
    )


def _with_roles(rows: DataFrame, *roles: Column) -> DataFrame:
    """A row for each role that a row plays."""
    given = rows.withColumn("role", F.explode(F.array_compact(F.array(*roles))))
    return given.select("*", "role.*").drop("role")


def history_frame(
    rows: DataFrame,
    depth: int = HISTORY_LIMIT,
    extras: dict[str, str] | None = None,
    refuse: bool = True,
    room: Callable[[DataFrame], DataFrame] | None = None,
    instants: bool = True,
    whole: bool = False,
) -> DataFrame:
    """Rows with ``chunk``, ``is_candidate`` and ``is_history``, shuffled once by :data:`GROUP`.

    ``depth`` is the number of prior rows that must stay visible. ``extras`` are whole-key
    aggregates (for example the first time a profile existed) added as columns. With ``refuse``,
    ``history_limit_exceeded`` marks candidates with more prior rows than that, and
    :func:`bounded` columns are NULL for them, so no operator can return a value from a cut history.
    ``room`` tells by how many rows (``room``) the groups of a long key have to be deeper. A ``whole``
    frame refuses nobody: every candidate finds its whole activity span in its group.
    """
    extras, refuse = extras or {}, refuse and not whole
    short, long = split_by_length(rows, depth, extras | SLOT_BOUNDS if whole else extras)
    dealt = short.withColumns(
        {"chunk": F.lit(0).cast("bigint"), "is_candidate": F.lit(True), "is_history": F.lit(True)}
    )
    if long is not None:
        deep = F.lit(depth + 1)
        if room is not None and not whole:
            long, deep = long.join(room(long), list(KEYS)), deep + F.col("room")
        chunks = _slotted(long) if whole else _chunked(long, deep, instants)
        missing = {name: F.lit(None) for name in extras}
        dealt = dealt.withColumns(missing) if extras else dealt
        dealt = dealt.unionByName(chunks.select(*dealt.columns))
    framed = dealt.repartition(*GROUP)
    framed = framed.withColumns(_whole_key(extras, long is not None)) if extras else framed
    seen = prior_count("is_history", ACTIVITY_SPAN, *GROUP)
    return add(framed, history_limit_exceeded=f"{seen} > {depth}" if refuse else "false")


def bounded(frame: DataFrame, **columns: str) -> DataFrame:
    """Adds SQL expressions as columns, NULL where the history is refused."""
    return add(
        frame,
        **{k: f"CASE WHEN NOT history_limit_exceeded THEN {v} END" for k, v in columns.items()},
    )


def _whole_key(extras: dict[str, str], partly: bool) -> dict[str, Column]:
    """Short keys are whole inside their group; long keys brought their aggregates along."""
    # Ordered like every other window of the group, so that it shares their sort.
    both = (Window.unboundedPreceding, Window.unboundedFollowing)
    key = Window.partitionBy(*GROUP).orderBy("us").rowsBetween(*both)
    return {
        name: F.coalesce(F.col(name), F.expr(value).over(key))
        if partly
        else F.expr(value).over(key)
        for name, value in extras.items()
    }


def candidates(frame: DataFrame) -> DataFrame:
    """Back to one row per input row."""
    return frame.filter("is_candidate").drop("chunk", "is_candidate", "is_history")
