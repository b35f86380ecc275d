"""Business questions as parameterised queries over the marts, and free SQL over them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborline.config import CRUISE
from harborline.functions.numeric import exact_mean, percent
from harborline.functions.text import labelled_line, printed, render, strip_code_fences

TOP = 10
SHOWN_ROWS = 20
NO_RESULTS = "Query returned no results."
# Replies used when a reply lacks its labels.
DEFAULT_REASON = "Question may be outside available data scope."
DEFAULT_SUGGESTION = "Try asking about brand performance, occupancy, revenue, or pricing."
# Fixed value: the reply to a question that the data cannot answer.
REFUSAL = "I can't answer that with the available data. {reason} Try asking: '{suggestion}'"


def _active() -> Column:
    return ~F.col("is_cancelled")


def _mean2(name: str, scale: int | None = None) -> Column:
    return F.round(exact_mean(F.col(name), scale), 2)


def region_performance(revenue: DataFrame, limit: int = TOP) -> DataFrame:
    """Which region is doing well?"""
    return (
        revenue.where(_active())
        .groupBy("region")
        .agg(
            F.sum("total_revenue_usd").alias("total_revenue"),
            F.count("*").alias("total_bookings"),
            _mean2("total_revenue_usd").alias("avg_revenue_per_booking"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"), F.asc_nulls_last("region"))
        .limit(limit)
    )


def region_cancellation(occupancy: DataFrame, limit: int = TOP) -> DataFrame:
    """Which region has the highest cancellation rate?"""
    return (
        occupancy.groupBy("region")
        .agg(
            F.sum("total_bookings").alias("total_bookings"),
            F.sum("cancelled_bookings").alias("cancelled_bookings"),
            percent(F.sum("cancelled_bookings"), F.sum("total_bookings")).alias("cancellation_rate_pct"),
        )
        .orderBy(F.desc_nulls_last("cancellation_rate_pct"), F.asc_nulls_last("region"))
        .limit(limit)
    )


def brand_in_region(revenue: DataFrame, brand: str, region: str) -> DataFrame:
    """How is a brand performing in a region?"""
    return (
        revenue.where((F.col("brand") == brand) & (F.col("region") == region) & _active())
        .groupBy("brand", "region")
        .agg(
            F.count("*").alias("total_bookings"),
            F.sum("total_revenue_usd").alias("total_revenue"),
            _mean2("total_revenue_usd").alias("avg_revenue_per_booking"),
            _mean2("total_guest_value_usd").alias("avg_guest_value"),
            _mean2("cabin_price_usd").alias("avg_cabin_price"),
        )
    )


def cabin_revenue_per_night(revenue: DataFrame, brand: str, cabin_like: str = "%Suite%") -> DataFrame:
    """What is the average revenue per night for a brand's suites?"""
    return (
        revenue.where((F.col("brand") == brand) & F.col("cabin_category").like(cabin_like) & _active())
        .groupBy("brand")
        .agg(
            F.count("*").alias("total_bookings"),
            _mean2("revenue_per_night_usd", 6).alias("avg_revenue_per_night"),
        )
    )


def cabin_onboard_spend(revenue: DataFrame, limit: int = TOP) -> DataFrame:
    """Which cabin category generates the most onboard spend?"""
    return (
        revenue.where(_active())
        .groupBy("cabin_category")
        .agg(
            F.sum("total_onboard_spend_usd").alias("total_onboard_spend"),
            _mean2("total_onboard_spend_usd").alias("avg_onboard_spend"),
            F.count("*").alias("total_bookings"),
        )
        .orderBy(F.desc_nulls_last("total_onboard_spend"), F.asc_nulls_last("cabin_category"))
        .limit(limit)
    )


def tier_lifetime_value(ltv: DataFrame, limit: int = TOP) -> DataFrame:
    """Which loyalty tier has the highest lifetime value?"""
    return (
        ltv.groupBy("loyalty_tier")
        .agg(
            F.count("*").alias("guest_brands"),
            F.sum("total_lifetime_value").alias("total_lifetime_value"),
            _mean2("total_lifetime_value").alias("avg_lifetime_value"),
        )
        .orderBy(F.desc_nulls_last("avg_lifetime_value"), F.asc_nulls_last("loyalty_tier"))
        .limit(limit)
    )


def price_comparison(pricing: DataFrame, region: str, brands: Sequence[str]) -> DataFrame:
    """How does the pricing of brands compare in a region?"""
    lowest = Window.partitionBy("region")
    grouped = (
        pricing.where((F.col("region") == region) & F.col("brand").isin(*brands))
        .groupBy("region", "brand")
        .agg(
            _mean2("listed_price_usd").alias("avg_listed_price"),
            _mean2("avg_booked_price_usd", 6).alias("avg_booked_price"),
            _mean2("price_variance_pct", 2).alias("avg_price_variance_pct"),
        )
    )
    ratio = F.col("avg_listed_price") / F.nullif(F.min("avg_listed_price").over(lowest), F.lit(0.0))
    return grouped.withColumn("ratio_to_lowest", F.round(ratio, 2))


def booking_window_trend(occupancy: DataFrame, region: str) -> DataFrame:
    """What is the booking window trend for a region's sailings?"""
    return (
        occupancy.where(F.col("region") == region)
        .groupBy("sail_year", "sail_quarter")
        .agg(_mean2("avg_booking_window_days", 10).alias("avg_booking_window"))
        .orderBy("sail_year", "sail_quarter")
    )


def overall_by_brand(revenue: DataFrame, limit: int = TOP) -> DataFrame:
    """How are we doing overall?"""
    return (
        revenue.where(_active())
        .groupBy("brand")
        .agg(
            F.sum("total_revenue_usd").alias("total_revenue"),
            F.count("*").alias("total_bookings"),
            _mean2("total_guest_value_usd").alias("avg_guest_value"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"), F.asc_nulls_last("brand"))
        .limit(limit)
    )


def problem_areas(
    occupancy: DataFrame,
    min_occupancy: float = CRUISE.min_occupancy,
    max_cancellation: float = CRUISE.max_cancellation,
    limit: int = TOP,
) -> DataFrame:
    """Where are the problem areas? Low occupancy or high cancellation."""
    return (
        occupancy.groupBy("brand", "region", "itinerary_name")
        .agg(
            _mean2("occupancy_rate_pct", 2).alias("avg_occupancy"),
            _mean2("cancellation_rate_pct", 2).alias("avg_cancellation"),
            F.sum("total_bookings").alias("total_bookings"),
        )
        .where((F.col("avg_occupancy") < min_occupancy) | (F.col("avg_cancellation") > max_cancellation))
        .orderBy(
            F.asc_nulls_last("avg_occupancy"),
            *[F.asc_nulls_last(c) for c in ("brand", "region", "itinerary_name")],
        )
        .limit(limit)
    )


# The standing questions, each with the query that answers it.
STANDING_QUESTIONS = {
    "Which region is doing well?": lambda m: region_performance(m["mart_revenue"]),
    "Which region has the highest cancellation rate?": lambda m: region_cancellation(
        m["mart_occupancy"]
    ),
    "How is Norwegian brand performing in Alaska?": lambda m: brand_in_region(
        m["mart_revenue"], "Norwegian", "Alaska"
    ),
    "What is the average revenue per night for Regent suites?": lambda m: cabin_revenue_per_night(
        m["mart_revenue"], "Regent"
    ),
    "Which cabin category generates the most onboard spend?": lambda m: cabin_onboard_spend(
        m["mart_revenue"]
    ),
    "Which loyalty tier has the highest lifetime value?": lambda m: tier_lifetime_value(
        m["mart_guest_ltv"]
    ),
    "How does Oceania pricing compare to Norwegian in Caribbean?": lambda m: price_comparison(
        m["mart_pricing_summary"], "Caribbean", ["Oceania", "Norwegian"]
    ),
    "What is the booking window trend for Mediterranean sailings?": lambda m: booking_window_trend(
        m["mart_occupancy"], "Mediterranean"
    ),
    "How are we doing overall?": lambda m: overall_by_brand(m["mart_revenue"]),
    "Where are the problem areas?": lambda m: problem_areas(m["mart_occupancy"]),
}


def answer(question: str, marts: dict[str, DataFrame]) -> DataFrame:
    """Result of a standing question; other questions go through ``run_sql``."""
    return STANDING_QUESTIONS[question](marts)


def register_marts(marts: dict[str, DataFrame]) -> None:
    """Marts as temporary views for free SQL."""
    for name, df in marts.items():
        df.createOrReplaceTempView(name)


def run_sql(
    spark: SparkSession, statement: str, marts: dict[str, DataFrame] | None = None
) -> DataFrame:
    """A statement over the registered marts, with or without code fences around it.

    ``marts`` are views for this statement only: names are resolved when it is parsed, so
    the views go again at once.
    """
    register_marts(marts or {})
    try:
        return spark.sql(re.sub(r"```sql|```", "", statement).strip())
    finally:
        for name in marts or {}:
            spark.catalog.dropTempView(name)


def clean_statements(replies: DataFrame, column: str) -> DataFrame:
    return replies.withColumn(column, strip_code_fences(F.col(column)))


def parse_validation(replies: DataFrame, column: str) -> DataFrame:
    """``answerable``, ``reason`` and ``suggestion`` from labelled reply lines."""
    reply = F.col(column)
    reason, suggestion = labelled_line(reply, "REASON"), labelled_line(reply, "SUGGESTION")
    complete = reason.isNotNull() & suggestion.isNotNull()
    answer = F.regexp_extract(F.lower(reply), r"(?s)answerable:([^\n]*)", 1)
    return replies.withColumns(
        {
            "answerable": F.contains(answer, F.lit("yes")),
            "reason": F.when(complete, reason).otherwise(F.lit(DEFAULT_REASON)),
            "suggestion": F.when(complete, suggestion).otherwise(F.lit(DEFAULT_SUGGESTION)),
        }
    )


def refusals(parsed: DataFrame) -> DataFrame:
    """Adds ``refusal`` to parsed validations: the reply to questions that are not answerable."""
    text = render(REFUSAL, reason=F.col("reason"), suggestion=F.col("suggestion"))
    return parsed.withColumn("refusal", F.when(~F.col("answerable"), text))


def result_lines(result: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``(line_no, line)``: header, a rule of 60 dashes and the first 20 rows as text."""
    cells = [printed(F.col(f.name), f.dataType.simpleString()) for f in result.schema.fields]
    shown = (
        result.orderBy(*order)
        .limit(SHOWN_ROWS)
        .select(
            F.row_number().over(Window.orderBy(*order)).alias("n"),
            F.concat_ws(" | ", *cells).alias("line"),
        )
    )
    head = F.array(F.lit(" | ".join(result.columns)), F.lit("-" * 60))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda e: e["line"])
    return (
        shown.agg(rows.alias("rows"))
        .select(
            F.posexplode(
                F.when(F.size("rows") == 0, F.array(F.lit(NO_RESULTS))).otherwise(F.concat(head, "rows"))
            ).alias("line_no", "line")
        )
    )


def transcript(answers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``answers(question, answer, sql, results)`` as chat turns: the user's, then the reply.

    A question that has no answer yet is a turn of its own.
    """
    none = F.lit(None).cast("string")
    asked = [F.lit("user"), F.col("question"), none, none]
    replied = [F.lit("assistant"), F.col("answer"), F.col("sql"), F.col("results")]
    names = ["role", "content", "sql", "results"]
    turns = F.array(
        *[F.struct(*[c.alias(n) for c, n in zip(turn, names)]) for turn in (asked, replied)]
    )
    spoken = F.filter(turns, lambda t: t["content"].isNotNull())
    return answers.select(*keys, F.inline(spoken))
