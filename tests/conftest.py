import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from harborline import schemas
from harborline.session import local_session

STAMP = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folders = {
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = local_session(4, "4g", settings=folders)
    yield session
    session.stop()


def _frame(spark, contract, defaults, rows):
    filled = [{**defaults, **r} for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in contract) for r in filled], contract)


@pytest.fixture
def make_bookings(spark):
    defaults = {
        "booking_id": "BK1",
        "guest_id": "G1",
        "brand": "Norwegian",
        "ship_name": "Bliss",
        "itinerary_name": "Alaska Explorer",
        "region": "Alaska",
        "nights": 7,
        "cabin_category": "Inside",
        "num_guests": 2,
        "booking_date": dt.date(2024, 1, 10),
        "sail_date": dt.date(2024, 7, 5),
        "booking_window_days": 177,
        "cabin_price_usd": Decimal("1000.00"),
        "total_revenue_usd": Decimal("2000.00"),
        "booking_channel": "OTA",
        "is_cancelled": False,
        "cancellation_date": None,
        "cancellation_reason": None,
        "loyalty_tier": "Gold",
        schemas.STAMP: STAMP,
    }
    return lambda *rows: _frame(spark, schemas.BOOKINGS, defaults, rows)


@pytest.fixture
def make_spend(spark):
    defaults = {
        "booking_id": "BK1",
        "guest_id": "G1",
        "brand": "Norwegian",
        "sail_date": dt.date(2024, 7, 5),
        **{c: Decimal("10.00") for c in ("dining", "spa", "excursions", "beverage", "casino", "retail")},
        "total_onboard_spend_usd": Decimal("60.00"),
        schemas.STAMP: STAMP,
    }
    return lambda *rows: _frame(spark, schemas.ONBOARD_SPEND, defaults, rows)


@pytest.fixture
def make_guests(spark):
    defaults = {
        "guest_id": "G1",
        "first_name": "Ann",
        "last_name": "Lee",
        "email": "a@example.com",
        "country": "UK",
        "age_group": "25-34",
        "primary_brand": "Norwegian",
        "total_bookings": 1,
        "loyalty_tier": "Gold",
        schemas.STAMP: STAMP,
    }
    return lambda *rows: _frame(spark, schemas.GUESTS, defaults, rows)


@pytest.fixture
def make_pricing(spark):
    defaults = {
        "price_log_id": "PL1",
        "brand": "Norwegian",
        "itinerary_name": "Alaska Explorer",
        "region": "Alaska",
        "cabin_category": "Inside",
        "sail_date": dt.date(2024, 7, 5),
        "price_usd": Decimal("1000.00"),
        "recorded_at": STAMP,
        schemas.STAMP: STAMP,
    }
    return lambda *rows: _frame(spark, schemas.PRICING_LOG, defaults, rows)
