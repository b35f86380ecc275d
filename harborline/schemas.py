"""Column contracts of the four raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
STAMP = "_fivetran_synced"

_S, _I, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.DateType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)


def _struct(*pairs) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


BOOKINGS = _struct(
    ("booking_id", _S),
    ("guest_id", _S),
    ("brand", _S),
    ("ship_name", _S),
    ("itinerary_name", _S),
    ("region", _S),
    ("nights", _I),
    ("cabin_category", _S),
    ("num_guests", _I),
    ("booking_date", _D),
    ("sail_date", _D),
    ("booking_window_days", _I),
    ("cabin_price_usd", MONEY),
    ("total_revenue_usd", MONEY),
    ("booking_channel", _S),
    ("is_cancelled", _B),
    ("cancellation_date", _D),
    ("cancellation_reason", _S),
    ("loyalty_tier", _S),
    (STAMP, _TS),
)

GUESTS = _struct(
    ("guest_id", _S),
    ("first_name", _S),
    ("last_name", _S),
    ("email", _S),
    ("country", _S),
    ("age_group", _S),
    ("primary_brand", _S),
    ("total_bookings", _I),
    ("loyalty_tier", _S),
    (STAMP, _TS),
)

ONBOARD_SPEND = _struct(
    ("booking_id", _S),
    ("guest_id", _S),
    ("brand", _S),
    ("sail_date", _D),
    ("dining", MONEY),
    ("spa", MONEY),
    ("excursions", MONEY),
    ("beverage", MONEY),
    ("casino", MONEY),
    ("retail", MONEY),
    ("total_onboard_spend_usd", MONEY),
    (STAMP, _TS),
)

PRICING_LOG = _struct(
    ("price_log_id", _S),
    ("brand", _S),
    ("itinerary_name", _S),
    ("region", _S),
    ("cabin_category", _S),
    ("sail_date", _D),
    ("price_usd", MONEY),
    ("recorded_at", _TS),
    (STAMP, _TS),
)

RAW_TABLES = {
    "stg_bookings": BOOKINGS,
    "stg_guests": GUESTS,
    "stg_onboard_spend": ONBOARD_SPEND,
    "stg_pricing_log": PRICING_LOG,
}


def to_contract(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Contract columns in contract order, found by name in any case, cast where the type
    differs. A missing column is an error, an extra one is left out."""
    present = {name.lower(): (name, kind) for name, kind in df.dtypes}
    missing = [f.name for f in contract.fields if f.name not in present]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    columns = []
    for f in contract.fields:
        name, kind = present[f.name]
        column = F.col(f"`{name}`")
        columns.append((column if kind == f.dataType.simpleString() else column.cast(f.dataType)).alias(f.name))
    return df.select(*columns)
