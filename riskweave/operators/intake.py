"""Intake: canonical digests, idempotent acceptance, duplicate and unknown references."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.amounts import amount_text
from riskweave.operators.validate import KEY

# Fixed value: the operation name that prefixes the canonical body.
OPERATION = "submit-transaction:v1"


def iso_utc(us: Column) -> Column:
    """ISO 8601 in UTC; the fraction appears only when there is one."""
    instant = F.timestamp_micros(us)
    fraction = F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0")
    return F.concat(
        F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.pmod(us, F.lit(1_000_000)) != 0, F.concat(F.lit("."), fraction)).otherwise(""),
        F.lit("+00:00"),
    )


def json_text(text: str) -> Column:
    """A JSON string literal in pure ASCII, for text without control characters."""
    return F.expr(
        f"""concat('"', array_join(transform(split({text}, ''), c -> CASE
          WHEN c = '"' THEN concat(char(92), '"')
          WHEN ascii(c) = 92 THEN concat(char(92), char(92))
          WHEN ascii(c) < 127 THEN c
          WHEN ascii(c) < 65536 THEN concat(char(92), 'u', lpad(lower(hex(ascii(c))), 4, '0'))
          ELSE concat(char(92), 'u', lower(hex(55296 + (ascii(c) - 65536) div 1024)),
                      char(92), 'u', lower(hex(56320 + (ascii(c) - 65536) % 1024)))
          END), ''), '"')"""
    )


def request_digest(cents: str = "cents") -> Column:
    """SHA-256 of the operation and the compact JSON body with sorted keys."""
    plain = {
        "amount": amount_text(F.col(cents)),
        "channel": F.col("channel"),
        "currency": F.col("currency"),
        "customer_id": F.col("customer_id"),
        "device_id": None,
        "recipient_id": F.col("recipient_id"),
        "status": F.col("status"),
        "timestamp": iso_utc(F.col("us")),
        "transaction_id": F.col("transaction_id"),
    }
    parts: list[Column] = []
    for name, value in plain.items():
        quoted = (
            json_text(name)
            if value is None
            else F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
        )
        parts += [F.lit(f'{"," if parts else "{"}"{name}":'), quoted]
    return F.sha2(F.concat(F.lit(OPERATION + "\n"), *parts, F.lit("}")), 256)


def bad_keys(requests: DataFrame) -> DataFrame:
    return requests.filter(~F.coalesce(F.col("key").rlike(KEY), F.lit(False)))


def unknown_customers(rows: DataFrame, customers: DataFrame) -> DataFrame:
    return rows.join(customers.select("customer_id"), "customer_id", "left_anti")


#: Requests of one transaction that are settled in one sorted pass.
GROUP_LIMIT = 10_000


def idempotent_intake(
    requests: DataFrame,
    customers: DataFrame,
    existing: DataFrame | None = None,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Adds ``outcome``: ACCEPT, REPLAY, CONFLICT, UNKNOWN_CUSTOMER or DUPLICATE_TRANSACTION.

    Requests carry ``request_id, principal, key, digest, transaction_id, customer_id, arrived``.
    The key is looked at first, then the customer, then the transaction; only an accepted request
    holds its key and its transaction. A transaction whose keys are all its own is a group by itself,
    which depends on no other request: such groups of up to ``group_limit`` requests are settled one
    by one in a sorted pass, without rounds or checkpoints of their rows.

    The others (a key used for several transactions, more requests) are settled in rounds: the
    earliest live request of both its key and its transaction wins. One that can no longer be
    accepted is doomed: it holds nothing, and waits only to learn whether an earlier request takes
    its key. Each round is two partial aggregations and their joins; a chain of rejections adds
    rounds.

    Existing records are (principal, key, digest, transaction_id).
    """
    known = customers.select("customer_id").distinct().withColumn("known", F.lit(True))
    state = requests.join(known, "customer_id", "left")
    none = F.lit(None).cast("string")
    unknown = F.when(F.col("known").isNull(), "UNKNOWN_CUSTOMER")
    if existing is None:
        state = state.withColumns({"outcome": none, "doomed": unknown})
    else:
        by_key = existing.select("principal", "key", F.col("digest").alias("_held"))
        by_tx = existing.select("transaction_id").distinct().withColumn("_taken", F.lit(True))
        state = state.join(by_key, ["principal", "key"], "left").join(
            by_tx, "transaction_id", "left"
        )
        state = state.withColumns(
            {
                "outcome": F.when(F.col("_held").isNotNull(), _key_outcome("_held")),
                "doomed": F.coalesce(
                    unknown, F.when(F.col("_taken"), F.lit("DUPLICATE_TRANSACTION"))
                ),
            }
        )
    state = state.select(*requests.columns, "outcome", "doomed")
    ranged = state.groupBy("principal", "key").agg(
        F.min("transaction_id").alias("low"), F.max("transaction_id").alias("high")
    )
    shared = ranged.filter("low <> high").select("principal", "key")
    tangled = state.join(shared, ["principal", "key"], "left_semi").select("transaction_id").distinct()
    many = state.groupBy("transaction_id").count().filter(F.col("count") > group_limit)
    apart = tangled.union(many.select("transaction_id")).distinct().checkpoint()
    if apart.isEmpty():
        return _settled(state).select(*requests.columns, "outcome")
    result = _settled(state.join(apart, "transaction_id", "left_anti").select(*state.columns))
    rest = state.join(apart, "transaction_id", "left_semi").select(*state.columns)
    settled = [result, rest.filter("outcome IS NOT NULL")]
    live = rest.filter("outcome IS NULL")
    while True:
        done, live = _round(live)
        settled.append(done)
        if live.isEmpty():
            break
    result = reduce(lambda a, b: a.unionByName(b), settled)
    return result.select(*requests.columns, "outcome")


def _settled(state: DataFrame) -> DataFrame:
    """Handles the requests of each transaction one by one, in the order of their arrival."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, accepted, held = object(), False, {}
        for batch in batches:
            names = ("transaction_id", "principal", "key", "digest", "outcome", "doomed")
            out = []
            for tx, principal, key, digest, outcome, doomed in zip(
                *(batch.column(n).to_pylist() for n in names), strict=True
            ):
                if tx != group:
                    group, accepted, held = tx, False, {}
                if outcome is None:
                    if (principal, key) in held:
                        outcome = "REPLAY" if held[principal, key] == digest else "CONFLICT"
                    elif doomed or accepted:
                        outcome = doomed or "DUPLICATE_TRANSACTION"
                    else:
                        outcome, accepted, held[principal, key] = "ACCEPT", True, digest
                out.append(outcome)
            place = batch.schema.get_field_index("outcome")
            yield batch.set_column(place, "outcome", pa.array(out, pa.string()))

    # Dealt by a hash: Spark leaves out a repartition by a column that a join below has dealt by.
    dealt = state.repartition(F.xxhash64("transaction_id"))
    ordered = dealt.sortWithinPartitions("transaction_id", "arrived", "request_id")
    return ordered.mapInArrow(settle, state.schema)


def _key_outcome(held: str) -> Column:
    return F.when(F.col(held) == F.col("digest"), "REPLAY").otherwise("CONFLICT")


def _round(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over unsettled requests: (settled now, still unsettled)."""
    columns = rows.columns
    order = F.struct("arrived", "request_id")
    live = rows.filter("doomed IS NULL")
    first_key = live.groupBy("principal", "key").agg(
        F.min(F.struct("arrived", "request_id", "digest")).alias("_k")
    )
    first_tx = live.groupBy("transaction_id").agg(F.min(order).alias("_t"))
    first = F.struct("_k.arrived", "_k.request_id")
    marked = (
        rows.join(first_key, ["principal", "key"], "left")
        .join(first_tx, "transaction_id", "left")
        .withColumn(
            "_wins",
            F.col("doomed").isNull() & (first == order) & (F.col("_t") == order),
        )
        .withColumn("_earlier", F.col("_k").isNotNull() & (first < order))
        .checkpoint()
    )
    winners = marked.filter("_wins")
    key_held = winners.select("principal", "key", F.col("digest").alias("_held"))
    tx_held = winners.select("transaction_id", F.lit(True).alias("_taken"))
    doomed = F.coalesce("doomed", F.when(F.col("_taken"), F.lit("DUPLICATE_TRANSACTION")))
    rest = (
        marked.filter("NOT _wins")
        .join(key_held, ["principal", "key"], "left")
        .join(tx_held, "transaction_id", "left")
        .withColumn("doomed", doomed)
        .withColumn(
            "outcome",
            F.when(F.col("_held").isNotNull() & F.col("_earlier"), _key_outcome("_held")).when(
                ~F.col("_earlier"), F.col("doomed")
            ),
        )
        .select(*columns)
        .checkpoint()
    )
    done = winners.withColumn("outcome", F.lit("ACCEPT")).select(*columns)
    return done.unionByName(rest.filter("outcome IS NOT NULL")), rest.filter("outcome IS NULL")
