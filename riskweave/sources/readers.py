"""Typed readers. A schema is always given, so a scan never infers and columns are pruned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave import schemas
from riskweave.functions.frames import micros
from riskweave.operators.validate import benchmark_violations

MAX_BENCHMARK_BYTES = 200_000_000


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Facts with the cents and microseconds the operators work on."""
    rows = spark.read.schema(schemas.TRANSACTIONS).parquet(path)
    return rows.withColumns(
        {"cents": (F.col("amount") * 100).cast("bigint"), "us": micros(F.col("timestamp"))}
    )


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CUSTOMERS).parquet(path)


def read_labeled_events(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.LABELED_EVENTS).parquet(path)
    return rows.withColumns(
        {
            "cents": (F.col("amount") * 100).cast("bigint"),
            "us": micros(F.col("timestamp")),
            "available_us": micros(F.col("available_at")),
            "label_available_us": micros(F.col("label_available_at")),
        }
    )


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """The 31-column benchmark CSV, with ``source_row`` (the header is row 1).

    The header must match exactly, and every row must have its width. One aggregation then refuses
    an empty file, values that are not finite, negative times or amounts, and other classes.
    """
    rows = (
        spark.read.schema(schemas.BENCHMARK_CSV)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    located = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    checked = benchmark_violations(located, schemas.BENCHMARK_FEATURES, "Amount")
    time, label = F.col("Time"), F.col("Class")
    bad_time = time.isNull() | F.isnan(time) | (time < 0) | (time == float("inf"))
    totals = checked.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size("violations") > 0).alias("vectors"),
        F.count_if(bad_time).alias("times"),
        F.count_if(~F.coalesce(label.isin(0.0, 1.0), F.lit(False))).alias("classes"),
    ).first()
    if not totals.n:
        raise ValueError("the benchmark source is empty")
    if totals.vectors or totals.times or totals.classes:
        raise ValueError(f"invalid benchmark rows: {totals.asDict()}")
    # Ids grow inside a file block; blocks are numbered over their small table.
    order = Window.orderBy("_file", "_block")
    blocks = (
        located.groupBy("_file", "_block")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.sum("_n").over(order) - F.col("_n"))
        .drop("_n")
    )
    return (
        located.join(blocks, ["_file", "_block"])
        .withColumn("source_row", F.col("_base") + F.col("_id") - F.col("_first") + 2)
        .drop("_file", "_block", "_id", "_first", "_base")
    )


def content_digest(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of each file, computed in the tasks."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def load_pinned(
    spark: SparkSession, path: str, sha256: str, limit: int = MAX_BENCHMARK_BYTES
) -> DataFrame:
    """Reads the benchmark only when it is one file and its bytes are the approved ones."""
    files = spark.read.format("binaryFile").load(path).select("length")
    found = files.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("largest")).first()
    if not found.n or found.largest > limit:
        raise ValueError("the source is missing or exceeds the size limit")
    approved = content_digest(spark, path).agg(F.bool_and(F.col("sha256") == sha256)).first()[0]
    if found.n != 1 or not approved:
        raise ValueError("the source content does not match its approved digest")
    return read_benchmark(spark, path)


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Stored evaluations with the paths of their document that queries need."""
    rows = spark.read.schema(schemas.EVALUATIONS).parquet(path)
    risk = F.from_json("response_json", schemas.EVALUATION_DOCUMENT)["risk"]
    fields = ("status", "score", "level", "suggested_action", "profile_version")
    picked = reduce(
        lambda df, name: df.withColumn(name, F.col("_risk")[name]),
        fields,
        rows.withColumn("_risk", risk),
    )
    return (
        picked.withColumn("strategy", F.col("_risk.policy.strategy"))
        .withColumn("created_us", micros(F.col("created_at")))
        .drop("_risk")
    )


def _stored(spark: SparkSession, path: str, schema: str, **names: str) -> DataFrame:
    """A stored table; timestamps become microseconds, columns get the operators' names.

    ``names`` maps a new name to the stored column it comes from.
    """
    rows = spark.read.schema(schema).parquet(path)
    types = dict(rows.dtypes)
    for new, old in names.items():
        value = F.col(old)
        rows = rows.withColumn(new, micros(value) if types[old] == "timestamp" else value)
    return rows.drop(*(old for new, old in names.items() if old != new))


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """Profile revisions for :mod:`riskweave.operators.profiles`."""
    return _stored(
        spark,
        path,
        schemas.PROFILE_REVISIONS,
        as_of_us="as_of",
        verified="admission_workflow_verified",
        policy_version="admission_policy_version",
        decision_id="learning_decision_id",
    )


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROFILE_OBSERVATIONS).parquet(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, schemas.CASES, created_us="created_at")


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, schemas.TRANSITIONS, at_us="timestamp", actor="actor_id")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, schemas.FEEDBACK, at_us="timestamp", actor="actor_id")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return _stored(
        spark,
        path,
        schemas.LEARNING_DECISIONS,
        created_us="created_at",
        actor="actor_id",
        version_before="profile_version_before",
        version_after="profile_version_after",
    )


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, schemas.LEARNING_EVIDENCE, reviewer="reviewer_id")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return _stored(
        spark, path, schemas.DOMAIN_EVENTS, occurred_us="occurred_at", published_us="published_at"
    )


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    return _stored(
        spark,
        path,
        schemas.DELIVERY,
        lease_us="lease_until",
        available_us="available_at",
        completed_us="completed_at",
        dead_us="dead_at",
    )


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, schemas.RECEIPTS, recorded_us="recorded_at")
