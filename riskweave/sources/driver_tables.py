"""Domain tables derived from the driver's parquet tables.

Each view has a twin in :mod:`riskweave.plans.oracle`, written in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions.amounts import amount_text, to_cents
from riskweave.functions.frames import DAY, MINUTE, micros
from riskweave.operators import risk
from riskweave.operators.history import positions
from riskweave.operators.intake import iso_utc, request_digest

SCHEMAS = {
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "labels": "doc_id bigint, quality int, toxic int",
}

# One zone per nation group, and one channel per kind of event.
ZONES = ("Asia/Almaty", "UTC", "America/New_York", "Europe/London", "Asia/Kolkata")
CHANNEL_OF = {
    "view": "WEB",
    "click": "MOBILE",
    "signup": "BRANCH",
    "purchase": "MOBILE",
    "error": "ATM",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _choose(column: Column, mapping: dict[str, str]) -> Column:
    chain = None
    for key, value in mapping.items():
        chain = F.when(column == key, value) if chain is None else chain.when(column == key, value)
    return chain


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fast activity: one row per event."""
    return as_transactions(table(spark, sf_dir, "events"))


def as_transactions(events: DataFrame) -> DataFrame:
    """Customers hold two currencies; each is a history of its own."""
    recipient = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("customer_id"),
        F.when(recipient % 5 == 4, "USD").otherwise("KZT").alias("currency"),
        micros(F.col("ts")).alias("us"),
        to_cents(F.col("value")).alias("cents"),
        recipient.alias("recipient_id"),
        F.col("event_type").alias("device_id"),
        _choose(F.col("event_type"), CHANNEL_OF).alias("channel"),
        F.lit("RECEIVED").alias("status"),
    )


def slow_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-grain activity with ties: one row per order."""
    orders = table(spark, sf_dir, "orders")
    recipients = (
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("r"))
    )
    return orders.join(recipients, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.lit("KZT").alias("currency"),
        micros(F.col("o_orderdate")).alias("us"),
        to_cents(F.col("o_totalprice")).alias("cents"),
        F.coalesce("r", F.lit(-1)).alias("recipient_id"),
        F.col("o_orderpriority").alias("device_id"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = F.array(*(F.lit(z) for z in ZONES))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.get(zones, F.col("c_nationkey") % len(ZONES)).alias("timezone"),
        F.col("c_mktsegment").alias("segment"),
    )


def verdict() -> Column:
    """The analyst verdict a transaction ends up with; NULL when nobody reviewed it."""
    kind, recipient = F.col("device_id"), F.col("recipient_id")
    return (
        F.when(kind == "error", "CONFIRMED_FRAUD")
        .when((kind == "signup") & (recipient < 30), "NEEDS_INVESTIGATION")
        .when((kind == "signup") & (recipient < 60), F.lit(None))
        .otherwise("LEGITIMATE")
    )


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).withColumn("verdict", verdict())


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with the time they joined the baseline (often hours later) and the zone."""
    return (
        reviewed(spark, sf_dir)
        .withColumn(
            "admitted_us",
            F.when(F.col("verdict") == "LEGITIMATE", F.col("us") + F.col("recipient_id") % 5 * (DAY // 4)),
        )
        .join(customers(spark, sf_dir).select("customer_id", "timezone"), "customer_id", "left")
        .withColumn("timezone", F.coalesce("timezone", F.lit("UTC")))
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(spark, sf_dir).filter(F.col("admitted_us").isNotNull())


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with arrival and label clocks."""
    recipient = F.col("recipient_id")
    delay = F.when(recipient < 33, 0).when(recipient < 66, 2 * MINUTE).otherwise(120 * MINUTE)
    return (
        admitted(spark, sf_dir)
        .withColumn("available_us", F.col("us") + delay)
        .withColumn("label_available_us", F.col("available_us") + 2 * DAY)
        .withColumn("label", (F.col("device_id") == "error").cast("int"))
    )


def numbered_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the profile version that admitted each."""
    return (
        positions(observations(spark, sf_dir))
        .withColumn("admitted_version", F.col("place") + 1)
        .drop("place", "older")
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile revision per admission; a few are broken on purpose."""
    recipient = F.col("recipient_id")
    verified = F.col("device_id") != "view"
    return (
        numbered_observations(spark, sf_dir)
        .filter(recipient != 13)
        .select(
            "customer_id",
            "currency",
            F.col("admitted_version").alias("version"),
            (F.col("us") - F.when(recipient == 17, 3 * DAY).otherwise(0)).alias("as_of_us"),
            "timezone",
            verified.alias("verified"),
            F.when(verified & (recipient != 7), "profile-learning-v1-experimental").alias(
                "policy_version"
            ),
            F.when(verified, F.col("transaction_id")).alias("decision_id"),
        )
    )


def stored_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions with the time of their decision (up to ten days after their own), a change of zone
    and of windows, and now and then a decision made before that of an earlier version."""
    version = F.col("version")
    delay = F.when(version % 7 == 3, 10).otherwise(version % 4)
    return revisions(spark, sf_dir).withColumns(
        {
            "created_us": F.col("as_of_us") + delay * DAY + 1,
            "timezone": F.when(version >= 12, "America/New_York").otherwise(F.col("timezone")),
            "long_days": F.when(version >= 20, 9).otherwise(180),
            "short_days": F.when(version >= 20, 4).when(version >= 6, 7).otherwise(30),
        }
    )


def captured_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transaction as the captured activity of its customer's next one, some tampered with."""
    kind = F.col("recipient_id") % 10
    order = Window.partitionBy("customer_id", "currency").orderBy("us", F.col("transaction_id").cast("string"))
    following = transactions(spark, sf_dir).withColumn("candidate_id", F.lead("transaction_id").over(order))
    copies = F.when(kind == 0, 2).when(kind == 6, 4).otherwise(1)
    rows = following.filter("candidate_id IS NOT NULL").withColumns(
        {
            "transaction_id": F.when(kind == 1, F.col("candidate_id")).otherwise(F.col("transaction_id")),
            "customer_id": F.when(kind == 3, F.col("customer_id") + 1).otherwise(F.col("customer_id")),
            "currency": F.when(kind == 2, "USD").otherwise(F.col("currency")),
            "us": F.col("us") + F.when(kind == 4, 60).when(kind == 5, -200).otherwise(0) * DAY,
        }
    )
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return rows.select("candidate_id", "transaction_id", "customer_id", "currency", "us")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning decisions behind the verified revisions, with some missing."""
    return (
        numbered_observations(spark, sf_dir)
        .filter((F.col("device_id") != "view") & (F.col("recipient_id") != 11))
        .select(
            F.col("transaction_id").alias("decision_id"),
            "customer_id",
            "currency",
            F.lit("ACCEPT").alias("action"),
            F.lit("profile-learning-v1-experimental").alias("policy_version"),
            F.col("admitted_version").alias("version_after"),
        )
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as submitted text; some recipients get a broken field."""
    tx = transactions(spark, sf_dir)
    recipient = F.col("recipient_id")
    amount = amount_text(F.col("cents"))
    stamp = iso_utc(F.col("us"))
    return tx.select(
        "transaction_id",
        F.when(recipient == 4, F.concat(amount, F.lit("5")))
        .when(recipient == 6, F.concat(F.lit("-"), amount))
        .otherwise(amount)
        .alias("amount"),
        F.when(recipient == 1, "kzt")
        .when(recipient == 2, "KZT\n")
        .otherwise(F.col("currency"))
        .alias("currency"),
        F.when(recipient == 3, "  ")
        .when(recipient == 7, F.concat("device_id", F.lit("\t")))
        .when(recipient == 9, F.repeat("device_id", 100))
        .otherwise(F.col("device_id"))
        .alias("device_id"),
        F.when(recipient == 8, "FAX").otherwise(F.col("channel")).alias("channel"),
        "status",
        F.when(recipient == 5, F.substring(stamp, 1, 19)).otherwise(stamp).alias("timestamp"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transaction submitted once, and some again: the same, changed, or under a new key."""
    kind = F.col("device_id")
    tx = transactions(spark, sf_dir).withColumn(
        "customer_id",
        F.when(F.col("recipient_id") == 3, F.col("customer_id") + 1_000_000_000).otherwise(
            F.col("customer_id")
        ),
    )

    def attempt(number: int, delay: int, key: str, more: int) -> Column:
        return F.struct(
            F.lit(number).alias("attempt"),
            (F.col("us") + delay).alias("arrived"),
            F.concat(F.lit(key), F.col("transaction_id").cast("string")).alias("key"),
            (F.col("cents") + more).alias("sent_cents"),
        )

    attempts = F.array_compact(
        F.array(
            attempt(1, 0, "k", 0),
            F.when(kind == "click", attempt(2, 1_000_000, "k", 0)),
            F.when(kind == "view", attempt(2, 1_000_000, "k", 1)),
            F.when(kind == "signup", attempt(2, 1_000_000, "other", 0)),
        )
    )
    rows = tx.withColumn("a", F.explode(attempts)).select("*", "a.*").drop("a")
    return rows.select(
        F.concat_ws("-", F.col("transaction_id").cast("string"), "attempt").alias("request_id"),
        F.col("channel").alias("principal"),
        "key",
        request_digest("sent_cents").alias("digest"),
        "transaction_id",
        "customer_id",
        "arrived",
    )


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored evaluations: one per transaction, two for errors; signups abstain."""
    recipient, kind = F.col("recipient_id"), F.col("device_id")
    score = F.when(kind != "signup", recipient.cast("double") / 100)
    first = F.struct(
        (F.col("transaction_id") * 2).alias("evaluation_id"),
        (F.col("us") + MINUTE).alias("created_us"),
    )
    second = F.struct(
        (F.col("transaction_id") * 2 + 1).alias("evaluation_id"),
        (F.col("us") + 60 * MINUTE).alias("created_us"),
    )
    each = F.array_compact(F.array(first, F.when(kind == "error", second)))
    band = risk.level(F.col("score"))
    return (
        reviewed(spark, sf_dir)
        .withColumn("e", F.explode(each))
        .select("*", "e.*", score.alias("score"))
        .drop("e")
        .withColumn("level", band)
        .select(
            "evaluation_id",
            "transaction_id",
            "customer_id",
            "currency",
            "created_us",
            F.when(F.col("score").isNull(), "INSUFFICIENT_EVIDENCE")
            .otherwise("SCORED")
            .alias("status"),
            F.lit("rules_only").alias("strategy"),
            "score",
            "level",
            risk.action(F.col("level")).alias("suggested_action"),
            F.when(recipient >= 10, recipient).alias("profile_version"),
            "recipient_id",
            "device_id",
            "verdict",
            "us",
        )
    )


def evaluation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations with their JSON document; some documents disagree with their row."""
    recipient = F.col("recipient_id")
    document = F.to_json(
        F.struct(
            F.col("currency"),
            F.col("customer_id").cast("string").alias("customer_id"),
            (F.col("evaluation_id") + F.when(recipient == 21, 1).otherwise(0))
            .cast("string")
            .alias("evaluation_id"),
            F.struct(
                F.when(recipient == 22, "HIGH").otherwise(F.col("level")).alias("level"),
                F.lit(False).alias("operational_action_executed"),
                F.struct("strategy").alias("policy"),
                F.lit(False).alias("production_eligible"),
                F.col("profile_version"),
                F.when(recipient == 23, F.lit(1.5)).otherwise(F.col("score")).alias("score"),
                F.col("status"),
                F.col("suggested_action"),
                F.col("transaction_id").cast("string").alias("transaction_id"),
            ).alias("risk"),
            F.col("transaction_id").cast("string").alias("transaction_id"),
        )
    )
    return evaluations(spark, sf_dir).withColumn("response_json", document)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per transaction that is not a view, opened on its latest evaluation."""
    latest_one = (F.col("device_id") != "error") | (F.col("evaluation_id") % 2 == 1)
    return (
        evaluations(spark, sf_dir)
        .filter((F.col("device_id") != "view") & latest_one)
        .select(
            F.col("evaluation_id").alias("case_id"),
            "transaction_id",
            F.col("evaluation_id").alias("assessment_id"),
            (F.col("created_us") + MINUTE).alias("created_us"),
            "verdict",
            "recipient_id",
            "customer_id",
            "currency",
        )
    )


def _actor() -> Column:
    return F.concat(F.lit("r"), F.floor(F.col("recipient_id") / 10).cast("string"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review moves; cases with certain recipients are broken on purpose."""
    recipient, opened = F.col("recipient_id"), F.col("created_us")
    reviewed_case = F.col("verdict").isNotNull()
    terminal = F.col("verdict").isin("LEGITIMATE", "CONFIRMED_FRAUD")

    def move(sequence: Column, previous: Column, target: Column, minutes: Column) -> Column:
        return F.struct(
            sequence.cast("int").alias("sequence"),
            previous.alias("previous"),
            target.alias("target"),
            (opened + minutes.cast("bigint") * MINUTE).alias("at_us"),
        )

    moves = F.array_compact(
        F.array(
            F.when(
                reviewed_case, move(F.lit(1), F.lit("OPEN"), F.lit("UNDER_REVIEW"), F.lit(10))
            ),
            F.when(
                terminal,
                move(
                    F.lit(2),
                    F.when(recipient == 43, "OPEN").otherwise("UNDER_REVIEW"),
                    F.col("verdict"),
                    F.when(recipient == 42, -40).otherwise(20),
                ),
            ),
            F.when(
                terminal & (recipient < 80),
                move(
                    F.when(recipient == 41, 4).otherwise(3),
                    F.col("verdict"),
                    F.lit("CLOSED"),
                    F.lit(30),
                ),
            ),
        )
    )
    rows = cases(spark, sf_dir).withColumn("m", F.explode(moves))
    return rows.select("case_id", "m.*", _actor().alias("actor"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst feedback of reviewed cases; some is broken on purpose."""
    recipient, opened = F.col("recipient_id"), F.col("created_us")
    terminal = F.col("verdict").isin("LEGITIMATE", "CONFIRMED_FRAUD")
    asks = (F.col("verdict") == "NEEDS_INVESTIGATION") | (terminal & (recipient >= 50))
    place = F.when(recipient >= 50, 2).otherwise(1)

    def said(sequence: Column, verdict: Column, minutes: int) -> Column:
        return F.struct(
            sequence.cast("int").alias("sequence"),
            verdict.alias("verdict"),
            (opened + minutes * MINUTE).alias("at_us"),
        )

    entries = F.array_compact(
        F.array(
            F.when(asks, said(F.lit(1), F.lit("NEEDS_INVESTIGATION"), 15)),
            F.when(terminal, said(place, F.col("verdict"), 20)),
            F.when(terminal & (recipient == 44), said(place + 1, F.col("verdict"), 25)),
        )
    )
    rows = cases(spark, sf_dir).withColumn("f", F.explode(entries))
    return rows.select(
        (F.col("case_id") * 10 + F.col("f.sequence")).alias("feedback_id"),
        "case_id",
        "f.*",
        F.when(recipient == 45, "someone").otherwise(_actor()).alias("actor"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One domain event per transaction, some already published."""
    recipient = F.col("recipient_id")
    return transactions(spark, sf_dir).select(
        F.col("transaction_id").alias("event_id"),
        F.lit("TRANSACTION_RECEIVED").alias("event_type"),
        F.col("us").alias("occurred_us"),
        F.floor(recipient / 15).cast("int").alias("attempts"),
        F.when(F.col("device_id") == "purchase", F.col("us") + MINUTE).alias("published_us"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipient, us = F.col("recipient_id"), F.col("us")
    return transactions(spark, sf_dir).select(
        F.col("transaction_id").alias("event_id"),
        (us + recipient * MINUTE).alias("available_us"),
        F.when(F.col("device_id") == "click", us + 2 * DAY).alias("lease_us"),
        F.when(F.col("device_id") == "purchase", us + MINUTE).alias("completed_us"),
        F.when((F.col("device_id") == "error") & (recipient > 60), us + 2 * MINUTE).alias("dead_us"),
        F.when(
            (F.col("device_id") == "error") & (recipient > 60), "attempts_exhausted"
        ).alias("last_error"),
    )
