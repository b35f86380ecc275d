"""Model features from the revenue and lifetime-value marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.config import CRUISE, DomainConfig
from harborline.functions.dates import (
    day_spine,
    early_bird_factor,
    monday_weekday,
    sail_parts,
    seasonal_factor,
)
from harborline.functions.numeric import safe_ratio
from harborline.operators.lookup import code_of, with_alphabetical_code
from harborline.operators.quantile import exact_median
from harborline.operators.skew import salted_left_join

_BOOKING = [
    "booking_id",
    "guest_id",
    "brand",
    "ship_name",
    "itinerary_name",
    "region",
    "nights",
    "cabin_category",
    "num_guests",
    "booking_date",
    "sail_date",
    "booking_window_days",
    "cabin_price_usd",
    "total_revenue_usd",
    "total_onboard_spend_usd",
    "total_guest_value_usd",
    "booking_channel",
    "is_cancelled",
    "loyalty_tier",
]
_LTV = [
    "total_bookings",
    "completed_voyages",
    "customer_tenure_days",
    "total_lifetime_value",
    "avg_cabin_price",
    "ltv_segment",
]
# The model inputs, in order.
FEATURES = [
    "brand_enc",
    "region_enc",
    "cabin_enc",
    "channel_enc",
    "loyalty_enc",
    "nights",
    "num_guests",
    "booking_window_days",
    "cabin_price_usd",
    "sail_month",
    "sail_quarter",
    "sail_year",
    "is_peak_season",
    "is_weekend_sail",
    "total_bookings",
    "completed_voyages",
    "customer_tenure_days",
    "avg_cabin_price",
]


def feature_frame(
    revenue: DataFrame,
    ltv: DataFrame,
    config: DomainConfig = CRUISE,
    by_brand: bool = True,
    bookings: DataFrame | None = None,
) -> DataFrame:
    """Bookings with their guest's lifetime metrics, calendar features and codes.

    The lifetime mart holds one row per guest and brand. ``by_brand`` joins on both, one
    row per booking; without it the join is on the guest alone, which repeats a booking
    for each of the guest's brands. ``bookings`` may name a cheaper relation with the same
    guests, brands and cabins to read keys and categories from.
    """
    keys = ["guest_id", "brand"] if by_brand else ["guest_id"]
    joined = salted_left_join(
        revenue.select(*_BOOKING),
        ltv.select(*keys, *_LTV),
        keys,
        spread_by=["booking_id"],
        key_source=bookings,
    )
    sails = F.col("sail_date")
    framed = joined.select(
        *_BOOKING,
        *_LTV,
        *sail_parts(sails),
        monday_weekday(sails).alias("sail_dayofweek"),
        F.month(sails).isin(*config.peak_months).cast("int").alias("is_peak_season"),
        monday_weekday(sails).isin(*config.weekend_days).cast("int").alias("is_weekend_sail"),
        code_of(F.col("brand"), config.brand_codes).alias("brand_enc"),
        code_of(F.col("booking_channel"), config.channel_codes).alias("channel_enc"),
        code_of(F.col("loyalty_tier"), config.loyalty_codes).alias("loyalty_enc"),
        code_of(F.col("region"), config.region_codes).alias("region_enc"),
    )
    return with_alphabetical_code(
        framed, "cabin_category", "cabin_enc", ["booking_id"], revenue if bookings is None else bookings
    )


def revenue_per_night() -> Column:
    """Target of the revenue model; 0 where a booking has no nights."""
    return F.coalesce(safe_ratio(F.col("total_guest_value_usd"), F.col("nights")), F.lit(0.0))


def with_upsell_label(frame: DataFrame) -> DataFrame:
    """Active bookings with ``high_spender``: onboard spend above the median, strictly."""
    active = frame.where(~F.col("is_cancelled"))
    median = exact_median(active, "total_onboard_spend_usd").scalar()
    above = F.col("total_onboard_spend_usd").cast("double") > median
    return active.withColumn("high_spender", above.cast("int"))


def seasonal_price(bookings: DataFrame, config: DomainConfig = CRUISE) -> DataFrame:
    """Cabin price adjusted by season and booking window, without random jitter."""
    factor = seasonal_factor(F.col("region"), F.month("sail_date"), config.season_rules)
    early = early_bird_factor(F.col("booking_window_days"), config.early_bird)
    return bookings.select(
        "booking_id",
        "region",
        "sail_date",
        "booking_window_days",
        "cabin_price_usd",
        factor.alias("seasonal_factor"),
        early.alias("early_bird_factor"),
        F.round(F.col("cabin_price_usd").cast("double") * factor * early, 2).alias("seasonal_price_usd"),
    )


def price_calendar(
    itineraries: DataFrame,
    offers: DataFrame,
    first: Column,
    last: Column,
    config: DomainConfig = CRUISE,
    step_days: int = 7,
) -> DataFrame:
    """Every itinerary x offer x sail date with its season factor.

    ``itineraries(itinerary_name, region)``, ``offers(brand, cabin_category)``: the product
    of the two is the result itself. Dates are generated inside each of its rows.
    """
    factor = seasonal_factor(F.col("region"), F.month("sail_date"), config.season_rules)
    return (
        offers.select("brand", "cabin_category")
        .crossJoin(itineraries.select("itinerary_name", "region"))
        .select(
            "brand",
            "itinerary_name",
            "region",
            "cabin_category",
            F.explode(day_spine(first, last, step_days)).alias("sail_date"),
        )
        .withColumn("seasonal_factor", factor)
    )
