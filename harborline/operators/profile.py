"""Guest profile from booking history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guest_profile(bookings: DataFrame) -> DataFrame:
    """Most frequent brand (smallest on a tie), booking count and latest tier per guest.

    Ids are padded numbers, so a longer id is a later one. One partial aggregate: a guest
    with very many bookings is folded on the map side.
    """
    return bookings.groupBy("guest_id").agg(
        F.mode("brand", deterministic=True).alias("primary_brand"),
        F.count("*").alias("total_bookings"),
        F.max_by("loyalty_tier", F.struct(F.length("booking_id"), "booking_id")).alias("loyalty_tier"),
    )
