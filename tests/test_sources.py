import hashlib

import pytest
from pyspark.sql import functions as F

from riskweave import schemas
from riskweave.operators import intake, validate
from riskweave.sources import readers, sinks

HEADER = ",".join(("Time", *schemas.BENCHMARK_FEATURES, "Class"))


def line(time, value, label, amount=1.5):
    return ",".join([str(time), *[str(value)] * 28, str(amount), label])


def write(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_benchmark_rows_and_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", line(0, 1.0, '"0"'), line(5, 2.0, "1"), line(3, 1.0, "0"))
    rows = readers.read_benchmark(spark, path).orderBy("source_row").collect()
    assert [(r.source_row, r.Time, r.Class) for r in rows] == [(2, 0.0, 0.0), (3, 5.0, 1.0), (4, 3.0, 0.0)]


def test_benchmark_rows_across_blocks(spark, tmp_path):
    path = write(tmp_path / "b.csv", *(line(i, i % 5, str(i % 2)) for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.read_benchmark(spark, path)
        assert rows.rdd.getNumPartitions() > 2
        assert rows.filter("source_row <> Time + 2").isEmpty() and rows.count() == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    "bad", [line(-1, 1.0, "0"), line(0, "NaN", "0"), line(0, 1.0, "2"), line(0, 1.0, "0", -1), "1,2,3"]
)
def test_benchmark_refuses_bad_rows(spark, tmp_path, bad):
    path = write(tmp_path / "c.csv", line(0, 1.0, "0"), bad)
    with pytest.raises(Exception):
        readers.read_benchmark(spark, path).collect()


def test_benchmark_refuses_header_and_empty(spark, tmp_path):
    other = tmp_path / "d.csv"
    other.write_text(HEADER.replace("V3", "W3") + "\n" + line(0, 1.0, "0") + "\n")
    with pytest.raises(Exception):
        readers.read_benchmark(spark, str(other)).collect()
    with pytest.raises(ValueError):
        readers.read_benchmark(spark, write(tmp_path / "e.csv"))


def test_pinned_content(spark, tmp_path):
    path = write(tmp_path / "f.csv", line(0, 1.0, "0"))
    digest = hashlib.sha256((tmp_path / "f.csv").read_bytes()).hexdigest()
    assert readers.load_pinned(spark, path, digest).count() == 1
    with pytest.raises(ValueError):
        readers.load_pinned(spark, path, "0" * 64)
    with pytest.raises(ValueError):
        readers.load_pinned(spark, path, digest, limit=10)


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "1700000000000000 + id * 86400000000 AS us")
    facts = str(tmp_path / "facts")
    sinks.append_facts(rows, facts)
    sinks.append_facts(rows, facts)
    back = spark.read.parquet(facts)
    assert back.count() == 20 and back.select("event_date").distinct().count() == 10
    created = str(tmp_path / "created")
    sinks.create_dataset(rows, created)
    with pytest.raises(Exception):
        sinks.create_dataset(rows, created)


def test_evidence_documents(spark):
    rows = spark.createDataFrame([(1, None, 2.5)], "transaction_id int, b string, a double")
    row = sinks.evidence_documents(rows).first()
    assert row.document == '{"transaction_id":1,"a":2.5,"b":null}'
    assert row.sha256 == hashlib.sha256(row.document.encode()).hexdigest()
    events = sinks.domain_events(rows.withColumn("us", F.lit(5)), "RISK_EVALUATED", "transaction_id", "us")
    assert events.first().aggregate_id == "1"


def test_typed_transactions(spark, tmp_path):
    path = str(tmp_path / "tx")
    spark.sql(
        "SELECT 't' transaction_id, 'c' customer_id, 'r' recipient_id, "
        "CAST(12.34 AS DECIMAL(18,2)) amount, 'KZT' currency, "
        "TIMESTAMP'2024-01-01 00:00:00.000001Z' timestamp, 'WEB' channel, 'd' device_id, "
        "'RECEIVED' status"
    ).write.parquet(path)
    row = readers.read_transactions(spark, path).first()
    assert (row.cents, row.us) == (1234, 1_704_067_200_000_001)


def digest_of(device):
    body = (
        '{"amount":"12.30","channel":"WEB","currency":"KZT","customer_id":"7","device_id":'
        + __import__("json").dumps(device)
        + ',"recipient_id":"8","status":"RECEIVED","timestamp":"2024-01-01T00:00:00+00:00",'
        '"transaction_id":"9"}'
    )
    return hashlib.sha256(("submit-transaction:v1\n" + body).encode()).hexdigest()


@pytest.mark.parametrize("device", ["plain", 'quo"te', "back\\slash", "тест", "smile 😀 end"])
def test_request_digest(spark, device):
    row = spark.createDataFrame(
        [(9, 7, 8, 1230, "KZT", 1_704_067_200_000_000, "WEB", device, "RECEIVED")],
        "transaction_id int, customer_id int, recipient_id int, cents bigint, currency string, "
        "us bigint, channel string, device_id string, status string",
    )
    assert row.select(intake.request_digest()).first()[0] == digest_of(device)


REQUEST = (
    "request_id string, principal string, key string, digest string, transaction_id int, "
    "customer_id int, arrived int"
)


def sequential(requests, customers, existing=()):
    """Requests handled one by one, in order of arrival."""
    keys = {(principal, key): digest for principal, key, digest, _ in existing}
    taken, out = {tx for *_, tx in existing}, {}
    for rid, principal, key, digest, tx, customer, _ in sorted(requests, key=lambda r: (r[6], r[0])):
        held = keys.get((principal, key))
        if held is not None:
            out[rid] = "REPLAY" if held == digest else "CONFLICT"
        elif customer not in customers:
            out[rid] = "UNKNOWN_CUSTOMER"
        elif tx in taken:
            out[rid] = "DUPLICATE_TRANSACTION"
        else:
            keys[(principal, key)], out[rid] = digest, "ACCEPT"
            taken.add(tx)
    return out


@pytest.mark.parametrize("group_limit", [1, 3, 10_000])
def test_intake_equals_one_by_one(spark, group_limit):
    import random

    rng = random.Random(5)
    requests = []
    for i in range(150):
        tx = rng.randrange(40)
        requests.append((f"q{i:03}", "p", f"k{rng.randrange(40)}", f"d{tx}", tx, rng.choice([1, 1, 1, 9]), i))
    known = spark.createDataFrame([(1,)], "customer_id int")
    got = intake.idempotent_intake(spark.createDataFrame(requests, REQUEST), known, None, group_limit)
    assert {r.request_id: r.outcome for r in got.collect()} == sequential(requests, {1})
    old = [("p", "k1", "d1", 1), ("p", "k2", "d9", 2)]
    existing = spark.createDataFrame(
        old, "principal string, key string, digest string, transaction_id int"
    )
    again = intake.idempotent_intake(spark.createDataFrame(requests, REQUEST), known, existing, group_limit)
    expected = sequential(requests, {1}, old)
    assert {r.request_id: r.outcome for r in again.collect()} == expected


def test_model_version_and_level_checks(spark):
    rows = spark.createDataFrame(
        [("a" * 64, {"ap": 0.5}), ("A" * 64, {"ap": 0.5}), ("a" * 64, {" ": 1.5})],
        "artifact_sha256 string, metrics map<string,double>",
    )
    got = [r.violations for r in validate.model_version_violations(rows).collect()]
    assert got == [[], ["artifact_sha256"], ["metric_name", "metric_value"]]
    pairs = spark.createDataFrame([("LOW", "ALLOW"), ("LOW", "URGENT_REVIEW")], "a string, b string")
    broken = pairs.filter(validate.level_action_broken(F.col("a"), F.col("b")))
    assert [r.b for r in broken.collect()] == ["URGENT_REVIEW"]


def test_stored_tables_get_the_operators_names(spark, tmp_path):
    from datetime import datetime

    from riskweave import schemas

    at = datetime(2024, 1, 2)
    tables = {
        "revisions": (schemas.PROFILE_REVISIONS, ("c", "KZT", 3, at, "UTC", 180, 30, True, "p", "d")),
        "transitions": (schemas.TRANSITIONS, ("k", 1, "OPEN", "UNDER_REVIEW", "r1", at)),
        "feedback": (schemas.FEEDBACK, ("f", "k", "r1", "LEGITIMATE", at, None, 1)),
        "deliveries": (schemas.DELIVERY, ("e", None, None, at, None, None, None)),
        "receipts": (schemas.RECEIPTS, ("n", "e", at)),
        "evidence": (schemas.LEARNING_EVIDENCE, ("d", "k", "f", "t", "r1")),
        "cases": (schemas.CASES, ("k", "t", "a", at)),
    }
    wanted = {
        "revisions": ("as_of_us", "verified", "decision_id", "version"),
        "transitions": ("at_us", "actor", "sequence"),
        "feedback": ("at_us", "actor", "verdict"),
        "deliveries": ("available_us", "lease_us", "dead_us"),
        "receipts": ("recorded_us",),
        "evidence": ("reviewer",),
        "cases": ("created_us",),
    }
    for name, (schema, row) in tables.items():
        path = str(tmp_path / name)
        spark.createDataFrame([row], schema).write.parquet(path)
        found = getattr(readers, f"read_{name}")(spark, path).first()
        for column in wanted[name]:
            assert column in found.asDict(), (name, column)
        for column in found.asDict():
            if column.endswith("_us") and found[column] is not None:
                assert found[column] == 1_704_153_600_000_000
