"""Leakage-free datasets: bitemporal replay, chronological splits, first occurrences, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.frames import DAY, KEYS
from riskweave.operators.arrivals import with_arrived_activity
from riskweave.operators.features import vector, with_baseline
from riskweave.operators.history import (
    ACTIVITY_SPAN,
    HISTORY_LIMIT,
    candidates,
    history_frame,
)
from riskweave.operators.profiles import running_before


def in_flight(rows: DataFrame) -> DataFrame:
    """Per key, the most rows that had happened but not arrived at one time (``room``).

    A row is under way from its time until it arrives, or until it is too old to matter. Only these
    can stand between a candidate and the rows that it sees.
    """
    lands = f"least(greatest(coalesce(available_us, us + {ACTIVITY_SPAN}), us), us + {ACTIVITY_SPAN})"
    both = rows.selectExpr(*KEYS, "us", "1 AS step").unionByName(
        rows.selectExpr(*KEYS, f"{lands} AS us", "-1 AS step")
    )
    flying = running_before(both, {"flying": "step"}, {})
    return flying.filter("step > 0").groupBy(*KEYS).agg(F.max("flying").alias("room"))


def replay_frame(labeled: DataFrame, limit: int = HISTORY_LIMIT, whole: bool = False) -> DataFrame:
    """History groups deep enough to hold ``limit + 1`` rows that had arrived, if there are so many.

    A long key is as much deeper as it has rows under way at one time; other keys do not matter.
    Groups of a ``whole`` frame hold the whole span of each candidate.
    """
    extras = {"profile_since": f"min({ARRIVED})"}
    return history_frame(labeled, limit, extras, refuse=False, room=in_flight, whole=whole)


#: When a baseline row is both admitted and known to have happened.
ARRIVED = "CASE WHEN admitted_us IS NOT NULL THEN greatest(admitted_us, available_us) END"


CLOCKS = ("available_us", "label_available_us", "label")
#: What the vector is made of. Passes in Python carry every column of their frame along, which Spark
#: cannot prune, so others are left out before the rows are dealt.
INPUTS = (
    "transaction_id", "customer_id", "currency", "us", "cents", "recipient_id", "device_id", "admitted_us", "timezone",
    *CLOCKS,
)


def prepare(labeled: DataFrame, limit: int = HISTORY_LIMIT, whole: bool = False) -> DataFrame:
    """The feature vector of every event as it could be known when the event arrived.

    An event with more than ``limit`` known rows in 180 days is refused: marked, and without values.
    Where no event may be missing, ``whole`` gives these too their values, of all their rows.
    """
    frame = with_arrived_activity(replay_frame(labeled.select(*INPUTS), limit, whole))
    frame = with_baseline(frame, seen=ARRIVED)
    return vector(candidates(frame), limit, CLOCKS, whole)


def split(
    prepared: DataFrame, held_out: DataFrame, start_us: int, days: int
) -> DataFrame:
    """Adds ``split``. Event, arrival and label must all fall inside a partition.

    Rows that cross a boundary get NULL. Held-out customers appear in held_out_test only.
    """
    train_end = start_us + int(days * 0.6) * DAY
    validation_end = start_us + int(days * 0.8) * DAY
    test_end = start_us + (days + 3) * DAY
    event, arrival, label = F.col("us"), F.col("available_us"), F.col("label_available_us")

    def inside(low: int, high: int) -> Column:
        return (event >= low) & (event <= arrival) & (arrival < high) & (label < high)

    kept = F.coalesce(F.col("_held"), F.lit(False))
    named = (
        F.when(kept & inside(validation_end, test_end), "held_out_test")
        .when(kept, F.lit(None))
        .when((arrival < train_end) & (label < train_end), "train")
        .when(inside(train_end, validation_end), "validation")
        .when(inside(validation_end, test_end), "test")
    )
    marked = held_out.select("customer_id").distinct().withColumn("_held", F.lit(True))
    return prepared.join(marked, "customer_id", "left").withColumn("split", named).drop("_held")


def split_classes(rows: DataFrame) -> DataFrame:
    """Rows and positives per split, and whether both classes are present."""
    counted = rows.filter("split IS NOT NULL").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives")
    )
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return counted.withColumn("both_classes", both)


def first_feature_occurrence(
    rows: DataFrame, features: tuple[str, ...], time: str, row: str
) -> DataFrame:
    """The first row in time of every distinct feature tuple; labels play no part.

    The minimum combines before the shuffle, so a tuple with countless copies costs one row per
    task.
    """
    rest = [c for c in rows.columns if c not in (*features, time, row)]
    first = rows.groupBy(*features).agg(F.min(F.struct(time, row, *rest)).alias("_r"))
    return first.select(*features, "_r.*").select(*rows.columns)


def time_split(rows: DataFrame, time: str) -> DataFrame:
    """Fixed boundaries of the two-day benchmark, in seconds."""
    named = F.when(F.col(time) < 86_400, "train").when(F.col(time) < 129_600, "validation")
    return rows.withColumn("split", named.otherwise("test"))


def class_weights(rows: DataFrame) -> DataFrame:
    """Balanced weight per class, and negatives per positive."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("positives"),
    )
    n, positives = F.col("n").cast("double"), F.col("positives").cast("double")
    return counts.select(
        "n",
        "positives",
        F.try_divide(n, positives * 2).alias("positive_weight"),
        F.try_divide(n, (n - positives) * 2).alias("negative_weight"),
        F.try_divide(n - positives, positives).alias("negatives_per_positive"),
    )


def in_scope(rows: DataFrame) -> DataFrame:
    """Only the declared currency, zone and windows may be scored by an experimental model."""
    scoped = (F.col("currency") == "KZT") & (F.col("timezone") == "UTC")
    for name, days in (("long_window_days", 180), ("short_window_days", 30)):
        if name in rows.columns:
            scoped = scoped & (F.col(name).isNull() | (F.col(name) == days))
    return rows.withColumn("in_scope", F.coalesce(scoped, F.lit(False)))


def dataset_digest(rows: DataFrame) -> DataFrame:
    """A fingerprint that does not depend on row order or partitioning.

    Every row is hashed with SHA-256; the sums of four 60-bit pieces are kept, with the row count.
    """
    columns = sorted(rows.columns)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    hashed = rows.select(F.sha2(text, 256).alias("h"))
    pieces = [
        F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
        .cast("decimal(38,0)")
        .cast("string")
        .alias(f"piece{i}")
        for i in range(4)
    ]
    return hashed.agg(F.count(F.lit(1)).alias("n"), *pieces)


def changed_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one table and not in the other, with their side; empty when both agree."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right"))
    )
