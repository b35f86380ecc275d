"""The four gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.config import CRUISE, DomainConfig
from harborline.functions.dates import sail_parts
from harborline.functions.numeric import percent, safe_ratio, zero_if_null
from harborline.operators.skew import fanout_left_join, salted_left_join

_BOOKING_COLUMNS = [
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
    "booking_channel",
    "is_cancelled",
    "cancellation_reason",
    "loyalty_tier",
]
OCCUPANCY_KEYS = ["brand", "ship_name", "itinerary_name", "region", "sail_date"]
LTV_KEYS = ["guest_id", "brand"]
PRICE_KEYS = ["itinerary_name", "brand", "cabin_category", "sail_date"]
_CATEGORIES = ["dining", "spa", "excursions", "beverage", "casino", "retail"]


def _active() -> Column:
    """A NULL flag counts neither as active nor as cancelled."""
    return ~F.col("is_cancelled")


def mart_revenue(
    bookings: DataFrame, spend: DataFrame, spend_is_unique: bool = False
) -> DataFrame:
    """One row per booking (per spend row, where a booking has several), with its values.

    ``spend_is_unique`` skips the guard against one booking holding a large share of the
    spend rows; set it where the spend relation is grouped by booking.
    """
    amounts = spend.select("booking_id", *_CATEGORIES, "total_onboard_spend_usd")
    left = bookings.select(*_BOOKING_COLUMNS)
    if spend_is_unique:
        joined = left.join(amounts, "booking_id", "left")
    else:
        joined = fanout_left_join(left, amounts, "booking_id", _CATEGORIES)
    onboard = zero_if_null(F.col("total_onboard_spend_usd"))
    value = F.col("total_revenue_usd") + onboard
    return joined.select(
        *_BOOKING_COLUMNS,
        onboard.alias("total_onboard_spend_usd"),
        *[zero_if_null(F.col(c)).alias(f"{c}_spend") for c in _CATEGORIES],
        value.alias("total_guest_value_usd"),
        safe_ratio(F.col("total_revenue_usd"), F.col("nights")).alias("revenue_per_night_usd"),
        safe_ratio(value, F.col("nights")).alias("total_value_per_night_usd"),
    )


def occupancy_state(bookings: DataFrame) -> DataFrame:
    """Per ship, itinerary and sail date: counts and sums that add up over parts of the bookings."""
    window, price = F.col("booking_window_days"), F.col("cabin_price_usd")
    return bookings.groupBy(*OCCUPANCY_KEYS).agg(
        F.count("booking_id").alias("booked"),
        F.count_if(_active()).alias("kept"),
        F.count_if(F.col("is_cancelled")).alias("lost"),
        F.sum(F.when(_active(), F.col("num_guests")).otherwise(0)).alias("guests"),
        F.sum(window).alias("window_sum"),
        F.count(window).alias("window_count"),
        F.sum(price).alias("price_sum"),
        F.count(price).alias("price_count"),
        F.sum(F.when(_active(), F.col("total_revenue_usd")).otherwise(0)).alias("revenue"),
    )


def occupancy_of(state: DataFrame) -> DataFrame:
    """The occupancy mart from its counts and sums."""
    return state.select(
        *OCCUPANCY_KEYS,
        # the calendar columns follow from sail_date, so they stay out of the shuffle key
        *sail_parts(F.col("sail_date")),
        F.col("booked").alias("total_bookings"),
        F.col("kept").alias("confirmed_bookings"),
        F.col("lost").alias("cancelled_bookings"),
        F.col("guests").alias("total_guests"),
        percent(F.col("kept"), F.col("booked")).alias("occupancy_rate_pct"),
        percent(F.col("lost"), F.col("booked")).alias("cancellation_rate_pct"),
        safe_ratio(F.col("window_sum"), F.col("window_count")).alias("avg_booking_window_days"),
        safe_ratio(F.col("price_sum"), F.col("price_count")).alias("avg_cabin_price_usd"),
        F.col("revenue").alias("total_revenue_usd"),
    )


def mart_occupancy(bookings: DataFrame) -> DataFrame:
    """Per ship, itinerary and sail date: counts, rates, averages and active revenue."""
    return occupancy_of(occupancy_state(bookings))


def ltv_segment(value: Column, config: DomainConfig) -> Column:
    chain = F
    for segment, at_least in config.ltv_segments:
        chain = chain.when(value >= at_least, F.lit(segment))
    return chain.otherwise(F.lit(config.ltv_floor))


def ltv_state(bookings: DataFrame, spend: DataFrame) -> DataFrame:
    """Per guest and brand: what adds up over parts of the bookings, each with its spend.

    Spend is folded to one row per booking before the join; ``copies`` keeps the weight a
    booking with several spend rows has in counts, sums and averages.
    """
    folded = spend.groupBy("booking_id").agg(
        F.count("*").cast("int").alias("copies"), F.sum("total_onboard_spend_usd").alias("onboard")
    )
    weight = F.coalesce("copies", F.lit(1))
    priced = F.when(_active() & F.col("cabin_price_usd").isNotNull(), weight)
    windowed = F.when(F.col("booking_window_days").isNotNull(), weight)
    return (
        bookings.select(
            "booking_id",
            "guest_id",
            "brand",
            "is_cancelled",
            "booking_date",
            "booking_window_days",
            "cabin_price_usd",
            "total_revenue_usd",
        )
        .join(folded, "booking_id", "left")
        .groupBy(*LTV_KEYS)
        .agg(
            F.sum(F.when(F.col("booking_id").isNotNull(), weight)).alias("booked"),
            F.sum(F.when(_active(), weight)).alias("kept"),
            F.sum(F.when(F.col("is_cancelled"), weight)).alias("lost"),
            F.min("booking_date").alias("first_date"),
            F.max("booking_date").alias("last_date"),
            F.sum(F.when(_active(), F.col("total_revenue_usd") * weight).otherwise(0)).alias("revenue"),
            F.sum(F.col("cabin_price_usd") * priced).alias("price_sum"),
            F.sum(priced).alias("price_count"),
            F.sum(F.col("booking_window_days") * windowed).alias("window_sum"),
            F.sum(windowed).alias("window_count"),
            F.sum(zero_if_null(F.col("onboard"))).alias("onboard"),
        )
    )


def ltv_of(state: DataFrame, guests: DataFrame, config: DomainConfig = CRUISE) -> DataFrame:
    """The lifetime mart from its counts and sums, with the guest's attributes and segment."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    metrics = state.select(
        *LTV_KEYS,
        count("booked").alias("total_bookings"),
        count("kept").alias("completed_voyages"),
        count("lost").alias("cancelled_bookings"),
        F.col("first_date").alias("first_booking_date"),
        F.col("last_date").alias("last_booking_date"),
        F.date_diff("last_date", "first_date").alias("customer_tenure_days"),
        F.col("revenue").alias("total_cabin_revenue"),
        safe_ratio(F.col("price_sum"), F.col("price_count")).alias("avg_cabin_price"),
        safe_ratio(F.col("window_sum"), F.col("window_count")).alias("avg_booking_window_days"),
        F.col("onboard").alias("total_onboard_spend"),
        (F.col("revenue") + F.col("onboard")).alias("total_lifetime_value"),
    )
    people = guests.select(
        "guest_id", "first_name", "last_name", "country", "age_group", "loyalty_tier"
    )
    return metrics.join(people, "guest_id", "left").select(
        *[metrics[c] for c in metrics.columns],
        *[people[c] for c in people.columns if c != "guest_id"],
        ltv_segment(F.col("total_lifetime_value"), config).alias("ltv_segment"),
    )


def mart_guest_ltv(
    bookings: DataFrame, spend: DataFrame, guests: DataFrame, config: DomainConfig = CRUISE
) -> DataFrame:
    """Lifetime metrics per guest and brand with the guest's attributes and segment."""
    return ltv_of(ltv_state(bookings, spend), guests, config)


def booked_state(bookings: DataFrame) -> DataFrame:
    """Sum and count of active cabin prices per itinerary, brand, cabin and sail date."""
    price = F.col("cabin_price_usd")
    return (
        bookings.where(_active())
        .groupBy(*PRICE_KEYS)
        .agg(F.sum(price).alias("price_sum"), F.count(price).alias("price_count"))
    )


def booked_of(state: DataFrame) -> DataFrame:
    mean = safe_ratio(F.col("price_sum"), F.col("price_count"))
    return state.select(*PRICE_KEYS, mean.alias("avg_booked_price_usd"))


def booked_prices(bookings: DataFrame) -> DataFrame:
    """Average active cabin price per itinerary, brand, cabin and sail date."""
    return booked_of(booked_state(bookings))


def mart_pricing_summary(
    pricing: DataFrame, bookings: DataFrame, band: float = CRUISE.price_band
) -> DataFrame:
    """Listed against booked price, one row per price log entry."""
    return pricing_of(pricing, booked_prices(bookings), band)


def pricing_of(pricing: DataFrame, booked_at: DataFrame, band: float = CRUISE.price_band) -> DataFrame:
    """The pricing mart from the log and the average booked prices."""
    joined = salted_left_join(
        pricing.select(
            "price_log_id",
            "brand",
            "itinerary_name",
            "region",
            "cabin_category",
            "sail_date",
            "price_usd",
        ),
        booked_at,
        PRICE_KEYS,
        spread_by=["price_log_id"],
    )
    listed = F.col("price_usd").cast("double")
    booked = F.col("avg_booked_price_usd")
    return joined.select(
        "brand",
        "itinerary_name",
        "region",
        "cabin_category",
        "sail_date",
        F.trunc("sail_date", "month").alias("sail_month"),
        F.year("sail_date").alias("sail_year"),
        F.col("price_usd").alias("listed_price_usd"),
        "avg_booked_price_usd",
        F.round(safe_ratio(booked - listed, listed) * 100, 2).alias("price_variance_pct"),
        F.when(booked > listed * (1 + band), F.lit("Above List"))
        .when(booked < listed * (1 - band), F.lit("Below List"))
        .otherwise(F.lit("At List"))
        .alias("price_position"),
    )
