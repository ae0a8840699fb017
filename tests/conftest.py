import os
import sys
from datetime import UTC, datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskweave.session import build_session, checkpoint_root  # noqa: E402

NOW = datetime(2026, 9, 19, 7, tzinfo=UTC)
TX_SCHEMA = (
    "transaction_id bigint, customer_id bigint, currency string, us bigint, cents bigint, "
    "recipient_id bigint, device_id string, admitted_us bigint, timezone string"
)


def micros(moment: datetime) -> int:
    return (moment - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    checkpoint_root(session)
    yield session


class Ledger:
    """Collects authored transactions."""

    def __init__(self):
        self.rows = []

    def add(
        self,
        moment,
        cents=3_000_000,
        recipient=1,
        device="phone",
        admitted=False,
        customer=1,
        currency="KZT",
        zone="Asia/Almaty",
        us=None,
    ):
        at = micros(moment) if us is None else us
        ident = len(self.rows) + 1
        row = (ident, customer, currency, at, cents, recipient, device, at if admitted else None, zone)
        self.rows.append(row)
        return ident

    def baseline(self, count=20, zone="Asia/Almaty"):
        """One admitted transaction a day: 20000, 25000, 30000, 35000, 50000, repeated."""
        amounts = (2_000_000, 2_500_000, 3_000_000, 3_500_000, 5_000_000)
        for i in range(count):
            self.add(
                NOW - timedelta(days=i + 1), amounts[i % 5], device="old", admitted=True, zone=zone
            )

    def frame(self, spark):
        return spark.createDataFrame(self.rows, TX_SCHEMA)


@pytest.fixture
def ledger():
    return Ledger()
