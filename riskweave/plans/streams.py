"""Streaming queries, run over the whole table with everything available now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.frames import HOUR
from riskweave.operators import learning
from riskweave.plans import oracle as o
from riskweave.plans.learning import FOLD_LIMIT, FOLD_SQL, LIMITED_FOLD_SQL
from riskweave.plans.registry import query
from riskweave.session import checkpoint_root
from riskweave.sources import driver_tables as d
from riskweave.streaming import pipelines, replay, stateful


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    raw = (
        spark.readStream.schema(d.SCHEMAS["events"])
        .option("pathGlobFilter", "events.parquet")
        # Bounds a batch, and with it what one customer can bring into one task.
        .option("maxBytesPerTrigger", str(1 << 30))
        .parquet(sf)
    )
    return d.as_transactions(raw)


def _result(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out = pipelines.run_available(stream)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


@query(
    "q_stream_intake",
    f"WITH {o.TX} SELECT transaction_id, us, cents FROM tx",
)
def stream_intake(spark, sf):
    stream = _event_stream(spark, sf)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    unique = pipelines.dedup_intake(twice).select("transaction_id", "us", "cents")
    return _result(spark, unique)


@query(
    "q_stream_hourly_counts",
    f"""WITH {o.TX} SELECT us // {HOUR} * {HOUR} AS hour_us, count(*) AS n,
      CAST(sum(cents) AS BIGINT) AS cents FROM tx GROUP BY 1
    HAVING us // {HOUR} * {HOUR} + {HOUR} <= (SELECT max(us) // 1000 * 1000 - {HOUR} FROM tx)""",
)
def stream_hourly(spark, sf):
    return _result(spark, pipelines.hourly_counts(_event_stream(spark, sf)))


@query(
    "q_stream_activity",
    f"""WITH {o.TX}, a AS (SELECT *, {o.ACTIVITY_COLUMNS} FROM tx), {o.LAST_DEVICE}
    SELECT transaction_id, us, false AS late, na > 10000 AS history_limit_exceeded,
      n5 AS transactions_last_5_min, n10 AS transactions_last_10_min, n60 AS transactions_last_hour,
      na AS activity_history_count, nr60 AS recipient_transactions_last_hour,
      first_r AS first_recipient_us, last_us, last_device, ndev > 0 AS device_seen
    FROM a LEFT JOIN inst USING (customer_id, currency, last_us)""",
)
def stream_activity(spark, sf):
    pipelines.use_rocksdb(spark)
    live = stateful.live_activity(_event_stream(spark, sf))
    return _result(spark, live).drop("customer_id", "currency")


@query(
    "q_late_replay",
    f"""WITH {o.TX}, a AS (SELECT *, {o.ACTIVITY_COLUMNS} FROM tx), {o.LAST_DEVICE},
    own AS (SELECT transaction_id, transaction_id % 10 = 0 AS second,
        count(*) FILTER (WHERE transaction_id % 10 <> 0) OVER {o.frame(o.KEYS, 180 * o.DAY)} AS first_na,
        max(CASE WHEN transaction_id % 10 <> 0 THEN us END) OVER (PARTITION BY {o.KEYS}) AS until FROM tx)
    SELECT transaction_id, us, second AND coalesce(us < until, false) AS late,
      CASE WHEN second THEN coalesce(us < until, false) ELSE na <> first_na END AS corrected,
      na > 10000 AS history_limit_exceeded, n5 AS transactions_last_5_min,
      n10 AS transactions_last_10_min, n60 AS transactions_last_hour, na AS activity_history_count,
      nr60 AS recipient_transactions_last_hour, first_r AS first_recipient_us, last_us, last_device,
      ndev > 0 AS device_seen
    FROM a JOIN own USING (transaction_id) LEFT JOIN inst USING (customer_id, currency, last_us)""",
)
def late_replay(spark, sf):
    """A tenth of the rows arrives in a later batch; replay corrects what was kept without them."""
    pipelines.use_rocksdb(spark)
    folder = f"{checkpoint_root(spark)}/late-{uuid.uuid4().hex}"
    tx = d.transactions(spark, sf)
    second = F.col("transaction_id") % 10 == 0
    for part in (~second, second):
        # The second run goes on from the state of the first.
        tx.filter(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(tx.schema).parquet(f"{folder}/in")
        pipelines.run_available(stateful.live_activity(stream), pipelines.route_late(folder), f"{folder}/state")
    evaluated = spark.read.parquet(f"{folder}/evaluated")
    late = spark.read.parquet(f"{folder}/replay")
    corrections = replay.replay_late(tx, evaluated, late)
    return replay.corrected(evaluated, corrections).drop("customer_id", "currency")


@query(
    "q_fan_out_receipts",
    f"""WITH {o.OUTBOX} SELECT 'recording' AS consumer_id, event_id, occurred_us AS recorded_us
    FROM outbox""",
)
def fan_out_receipts(spark, sf):
    """Every event is published twice and recorded once."""
    outbox = _event_stream(spark, sf).selectExpr("transaction_id AS event_id", "us AS occurred_us")
    twice = outbox.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _result(spark, pipelines.fan_out(twice, "recording"))


def _live_gate(spark, sf, rows):
    """What is known of a row before the stream starts (bootstrap, evaluable) joins it there."""
    pipelines.use_rocksdb(spark)
    names = [c for c in ("is_seed", "evaluable") if c in rows.columns]
    path = f"{checkpoint_root(spark)}/seeds-{uuid.uuid4().hex}"
    known = rows.select("transaction_id", *names)
    known.write.parquet(path)
    stream = (
        _event_stream(spark, sf)
        .withColumn("verdict", d.verdict())
        .join(spark.read.schema(known.schema).parquet(path), "transaction_id", "left")
        .withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    )
    return _result(spark, stateful.live_gate(stream)).drop("customer_id", "currency", "us")


@query("q_stream_gate", f"SELECT * EXCLUDE (action, version_after) FROM ({FOLD_SQL})")
def stream_gate(spark, sf):
    """The same decisions as the batch fold. Bootstrap rows are known before the stream starts."""
    return _live_gate(spark, sf, learning.first_legitimate(d.reviewed(spark, sf)))


@query("q_stream_gate_limited", f"SELECT * EXCLUDE (action, version_after) FROM ({LIMITED_FOLD_SQL})")
def stream_gate_limited(spark, sf):
    """The same decisions as the batch fold where some rows could not be evaluated."""
    rows = learning.with_evaluable(d.reviewed(spark, sf), FOLD_LIMIT)
    return _live_gate(spark, sf, learning.first_legitimate(rows))
