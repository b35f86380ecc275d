"""Typed staging views over the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from harborline.schemas import BOOKINGS, GUESTS, ONBOARD_SPEND, PRICING_LOG, to_contract


def stage_bookings(raw: DataFrame) -> DataFrame:
    return to_contract(raw, BOOKINGS)


def stage_guests(raw: DataFrame) -> DataFrame:
    return to_contract(raw, GUESTS)


def stage_onboard_spend(raw: DataFrame) -> DataFrame:
    return to_contract(raw, ONBOARD_SPEND)


def stage_pricing_log(raw: DataFrame) -> DataFrame:
    return to_contract(raw, PRICING_LOG)
