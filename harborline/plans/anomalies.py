"""Occupancy and cancellation anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.config import CRUISE
from harborline.plans.summaries import occupancy_quarterly

_KEYS = ["brand", "region", "itinerary_name", "sail_year", "sail_quarter"]


def by_occupancy() -> list:
    return [F.asc_nulls_last("avg_occupancy"), *[F.asc_nulls_last(k) for k in _KEYS]]


def anomaly_scan(occupancy: DataFrame) -> DataFrame:
    return occupancy_quarterly(occupancy).select(
        *_KEYS,
        F.col("avg_occupancy_pct").alias("avg_occupancy"),
        F.col("avg_cancellation_pct").alias("avg_cancellation"),
        "total_revenue",
        "total_bookings",
    )


def anomalies(
    occupancy: DataFrame,
    min_occupancy: float = CRUISE.min_occupancy,
    max_cancellation: float = CRUISE.max_cancellation,
    scan_limit: int | None = CRUISE.scan_limit,
) -> DataFrame:
    """Groups below the occupancy or above the cancellation threshold, among the
    ``scan_limit`` least occupied ones (None: among all)."""
    scanned = anomaly_scan(occupancy)
    if scan_limit is not None:
        scanned = scanned.orderBy(*by_occupancy()).limit(scan_limit)
    return scanned.where(
        (F.col("avg_occupancy") < min_occupancy) | (F.col("avg_cancellation") > max_cancellation)
    )


def first_anomalies(found: DataFrame, n: int) -> DataFrame:
    """The n most urgent ones: 3 for display, 2 to act on."""
    return found.orderBy(*by_occupancy()).limit(n)
