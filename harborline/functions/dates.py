"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sail_parts(day: Column) -> list[Column]:
    return [
        F.month(day).alias("sail_month"),
        F.quarter(day).alias("sail_quarter"),
        F.year(day).alias("sail_year"),
    ]


def monday_weekday(day: Column) -> Column:
    """Monday is 0, Sunday is 6."""
    return F.weekday(day)


def day_spine(first: Column, last: Column, step_days: int = 7) -> Column:
    """Array of days from first to last, both inside, ``step_days`` apart."""
    return F.sequence(first, last, F.make_dt_interval(F.lit(step_days)))


def seasonal_factor(region: Column, month: Column, rules) -> Column:
    chain = F
    for rule in rules:
        chain = chain.when((region == rule.region) & month.isin(*rule.months), F.lit(rule.factor))
    return chain.otherwise(F.lit(1.0)) if rules else F.lit(1.0)


def early_bird_factor(window_days: Column, steps) -> Column:
    chain = F
    for longer_than, factor in steps:
        chain = chain.when(window_days > longer_than, F.lit(factor))
    return chain.otherwise(F.lit(1.0)) if steps else F.lit(1.0)
