import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from limitline.session import local_session  # noqa: E402

PAYMENT_SCHEMA = (
    "user_profile_id bigint, request_id bigint, action_creation_time timestamp_ntz, "
    "source_currency string, product_type string, target_recipient_id bigint, "
    "risk_level string, invoice_value_eur decimal(18,8), has_us_address boolean, "
    "tw_ltd_customer boolean"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def when(text: str) -> datetime:
    return datetime.fromisoformat(text)


def payment(user, time, recipient, risk, eur, currency="EUR", product="SENDMONEY", us=False, tw=True):
    at = when(time) if isinstance(time, str) else time
    return (user, 0, at, currency, product, recipient, risk, Decimal(str(eur)), us, tw)


@pytest.fixture(scope="session")
def payments(spark):
    """Payments from ``payment(...)`` tuples; request ids are the row numbers."""

    def build(rows):
        numbered = [(r[0], i, *r[2:]) for i, r in enumerate(rows)]
        return spark.createDataFrame(numbered, PAYMENT_SCHEMA)

    return build


@pytest.fixture(scope="session")
def frame(spark):
    def build(schema, rows):
        return spark.createDataFrame(rows, schema)

    return build


def rows_of(df, *columns):
    """Rows as a sorted list of tuples, NULLs last."""
    picked = df.select(*columns) if columns else df
    return sorted(
        (tuple(r) for r in picked.collect()),
        key=lambda row: tuple((v is None, v if v is not None else 0) for v in row),
    )
