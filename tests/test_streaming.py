import random
from datetime import timedelta

from conftest import NOW, micros
from pyspark.sql import Row
from riskweave.operators import features
from riskweave.streaming import pipelines, replay, stateful

TX = "transaction_id bigint, customer_id bigint, currency string, us bigint, recipient_id bigint, device_id string"


def arriving(spark, tmp_path, batches, schema):
    """One file per batch, read one file at a time in order of arrival."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in")
        )
        import time

        time.sleep(1.1)
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )


def row(ident, minutes, recipient=1, device="a"):
    return (ident, 1, "KZT", micros(NOW + timedelta(minutes=minutes)), recipient, device)


def test_late_rows_are_routed_and_change_nothing(spark, tmp_path):
    pipelines.use_rocksdb(spark)
    stream = arriving(spark, tmp_path, [[row(1, 0), row(2, 3)], [row(3, 1)], [row(4, 4)]], TX)
    out = str(tmp_path / "out")
    pipelines.run_available(stateful.live_activity(stream), pipelines.route_late(out))
    good = {r.transaction_id: r for r in spark.read.parquet(f"{out}/evaluated").collect()}
    late = spark.read.parquet(f"{out}/replay").collect()
    assert set(good) == {1, 2, 4} and [r.transaction_id for r in late] == [3]
    assert good[2].transactions_last_5_min == 1
    assert good[4].transactions_last_5_min == 3


def test_state_limit_refuses(spark, tmp_path):
    pipelines.use_rocksdb(spark)
    stream = arriving(spark, tmp_path, [[row(i, i) for i in range(6)], [row(6, 6)]], TX)
    live = stateful.live_activity(stream, limit=3)
    out = pipelines.run_available(live)
    got = {r.transaction_id: r.history_limit_exceeded for r in spark.read.parquet(out).collect()}
    assert got == {i: i > 3 for i in range(7)}


def test_stream_equals_batch(spark, tmp_path):
    pipelines.use_rocksdb(spark)
    rows = [row(i, (i * 7) % 90 + i, i % 3, "ab"[i % 2]) for i in range(40)]
    rows.sort(key=lambda r: r[3])
    stream = arriving(spark, tmp_path, [rows[:15], rows[15:]], TX)
    live = spark.read.parquet(pipelines.run_available(stateful.live_activity(stream)))
    batch = features.velocity(spark.createDataFrame(rows, TX))
    names = ["transaction_id", "transactions_last_5_min", "transactions_last_hour", "activity_history_count"]
    assert live.select(*names).exceptAll(batch.select(*names)).isEmpty()


def test_receipts_are_recorded_once(spark, tmp_path):
    schema = "event_id bigint, occurred_us bigint"
    stream = arriving(spark, tmp_path, [[(1, 5), (1, 5), (2, 6)], [(2, 6), (3, 7)]], schema)
    state, total = str(tmp_path / "state"), []
    total += spark.read.parquet(pipelines.run_available(pipelines.fan_out(stream, "recording"), None, state)).collect()
    spark.createDataFrame([(3, 7), (4, 8)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    more = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    total += spark.read.parquet(pipelines.run_available(pipelines.fan_out(more, "recording"), None, state)).collect()
    assert sorted(r.event_id for r in total) == [1, 2, 3, 4]


def test_replay_corrects_what_was_kept(spark, tmp_path):
    """Several batches with late rows: kept values and corrections together are the batch values."""
    pipelines.use_rocksdb(spark)
    r = random.Random(4)
    rows = [row(i, r.randrange(400) * r.choice([1, 1, 1500]), r.choice([1, 2, 3]), r.choice("abc")) for i in range(90)]
    stream = arriving(spark, tmp_path, [rows[:30], rows[30:60], rows[60:]], TX)
    out = str(tmp_path / "out")
    pipelines.run_available(stateful.live_activity(stream), pipelines.route_late(out))
    evaluated, late = spark.read.parquet(f"{out}/evaluated"), spark.read.parquet(f"{out}/replay")
    assert late.count() > 10
    assert late.filter(" OR ".join(f"{n} IS NOT NULL" for n in stateful.VALUES)).isEmpty()
    tx = spark.createDataFrame(rows, TX)
    corrections = replay.replay_late(tx, evaluated, late)
    whole = replay.corrected(evaluated, corrections)
    names = ["transaction_id", *stateful.VALUES]
    assert sorted(whole.select(*names).collect()) == sorted(replay.activity(tx).select(*names).collect())
    changed = {x.transaction_id: set(x.changed) for x in corrections.collect()}
    assert {x.transaction_id for x in late.collect()} <= set(changed)
    assert set(stateful.VALUES) - {"history_limit_exceeded"} <= set().union(*changed.values())


def test_idle_customers_expire(spark, tmp_path):
    """With a watermark, a customer's state goes 181 days after the last row, and nothing is lost."""
    pipelines.use_rocksdb(spark)
    far = 200 * 24 * 60
    batches = [[row(1, 0)], [(2, 2, "KZT", micros(NOW + timedelta(minutes=far)), 1, "a")], [row(3, far + 1)], [row(4, far + 3)]]
    stream = pipelines.with_event_time(arriving(spark, tmp_path, batches, TX), "1 hour")
    found = spark.read.parquet(pipelines.run_available(stateful.live_activity(stream, expire=True)))
    counts = {x.transaction_id: x.activity_history_count for x in found.collect()}
    assert counts == {1: 0, 2: 0, 3: 0, 4: 1}


class _Held:
    """A state of one key in memory that counts its calls."""

    def __init__(self):
        self.value, self.calls = {}, 0

    def _call(self, result=None):
        self.calls += 1
        return result

    def get(self):
        return self._call(self.value.get(None))

    def update(self, value):
        self._call(self.value.update({None: value}))

    def containsKey(self, key):
        return self._call(key in self.value)

    def getValue(self, key):
        return self._call(self.value[key])

    def updateValue(self, key, value):
        self._call(self.value.update({key: value}))

    def removeKey(self, key):
        self._call(self.value.pop(key))


def _activity(batches):
    processor = stateful.ActivityProcessor()
    processor.head, processor.maps = _Held(), tuple(_Held() for _ in range(4))
    found = [list(processor.handleInputRows((1, "KZT"), iter(b), None)) for b in batches]
    return found, processor


def test_a_short_history_is_one_value(monkeypatch):
    """Read and written once a batch; entries give the same rows, also where a history grows into them."""
    r = random.Random(12)
    names = ("transaction_id", "us", "recipient_id", "device_id")
    batches, start = [], 0
    for b in range(12):
        start += r.choice([1, 60, 3_000, 200_000])
        batches.append([
            Row(**dict(zip(names, (100 * b + i, micros(NOW + timedelta(minutes=start + r.randrange(-90, 400))), r.choice([1, 2, None]), r.choice(["a", "b", None])), strict=True)))
            for i in range(15)
        ])
    packed, processor = _activity(batches)
    assert processor.head.calls == 2 * len(batches) and not any(m.calls for m in processor.maps)
    for rows in (0, 20):
        monkeypatch.setattr(stateful, "PACKED_ROWS", rows)
        assert _activity(batches)[0] == packed


def test_a_short_history_needs_no_entries(monkeypatch):
    """Its rows are judged in sorted lists; what would cut them into entries is not even made."""
    monkeypatch.setattr(stateful, "Entries", None)
    names = ("device_id", "us", "recipient_id", "transaction_id")
    rows = [Row(**dict(zip(names, ("ab"[i % 2], micros(NOW + timedelta(minutes=i)), 1, i), strict=True))) for i in range(8)]
    (_, found), _ = _activity([rows[:6], rows[6:]])
    assert [(x.activity_history_count, x.transactions_last_5_min, x.last_device, x.device_seen) for x in found] == [
        (6, 4, "b", True),
        (7, 4, "a", True),
    ]


def test_corrections_are_worked_out_once(spark, capsys):
    """Every row is there once, corrected where there is a correction, in one pass over these."""
    values = [f"{'true' if n in ('history_limit_exceeded', 'device_seen') else 'id'} AS {n}" for n in stateful.VALUES]
    head = ["id AS transaction_id", "7 AS customer_id", "'KZT' AS currency", "id AS us"]
    kept = spark.range(4).selectExpr(*head, "false AS late", *values)
    mended = spark.range(3, 6).selectExpr(*head, "id > 3 AS late", *values)
    found = replay.corrected(kept, mended)
    capsys.readouterr()
    found.explain(extended=False)
    assert capsys.readouterr().out.count("Range (3, 6") == 1
    rows = sorted((x.transaction_id, x.late, x.corrected) for x in found.collect())
    assert rows == [(i, i > 3, i > 2) for i in range(6)]


def test_rows_without_a_device_come_first(spark, tmp_path):
    pipelines.use_rocksdb(spark)
    stream = arriving(spark, tmp_path, [[row(1, 0, None, None)], [row(2, -1, None, None)], [row(3, 1)]], TX)
    live = spark.read.parquet(pipelines.run_available(stateful.live_activity(stream)))
    found = {x.transaction_id: (x.late, x.activity_history_count, x.last_us) for x in live.collect()}
    assert found == {1: (False, 0, None), 2: (True, None, None), 3: (False, 2, None)}


def test_the_live_gate_makes_two_calls_a_batch():
    names = ("transaction_id", "us", "cents", "verdict", "is_seed")
    rows = [Row(**dict(zip(names, (i, micros(NOW + timedelta(days=i)), 3_000, "LEGITIMATE", i < 5), strict=True))) for i in range(12)]

    def run(batches):
        processor = stateful.GateProcessor()
        processor.held = _Held()
        return [x for b in batches for x in processor.handleInputRows((1, "KZT"), iter(b), None)], processor.held.calls

    whole, once = run([rows])
    cut, calls = run([rows[:4], rows[4:7], rows[7:]])
    assert cut == whole and (once, calls) == (2, 6)
    assert [x.n_trusted for x in whole] == list(range(12))
