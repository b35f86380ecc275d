"""Quarterly rollups of the marts and the sentences rendered from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions.numeric import exact_mean
from harborline.functions.text import render, thousands, two_decimals, whole
from harborline.operators.ranking import sequential_ids
from harborline.sources.durable import stored

# Sentence formats of the summary documents.
OCCUPANCY_TEXT = (
    "{brand} brand {itinerary} itinerary ({region} region) in Q{quarter} {year}: "
    "Total bookings were {bookings} with {confirmed} confirmed and {cancelled} cancelled. "
    "Occupancy rate was {occupancy}%. "
    "Cancellation rate by region for {region} was {cancellation}%. "
    "Average booking window was {window} days. Total revenue was ${revenue}."
)
REVENUE_TEXT = (
    "{brand} brand {cabin} cabins in {region} region during Q{quarter} {year}: "
    "Average cabin price was ${price}. Average total revenue per booking was ${revenue}. "
    "Average onboard spend was ${onboard}. Average total guest value was ${value}. "
    "Revenue per night averaged ${per_night}. Based on {bookings} confirmed bookings."
)
PRICING_TEXT = (
    "{brand} brand {cabin} cabins in {region} during Q{quarter} {year} were priced {position}. "
    "Average listed price was ${listed} vs average booked price of ${booked}. "
    "Price variance was {variance}%."
)
BRAND_HEAD = "{brand} brand cancellation rate and occupancy rate comparison across all regions: {lines}"
BRAND_LINE = (
    "{region}: cancellation rate {cancellation}%, occupancy {occupancy}%, "
    "avg booking window {window} days, total revenue ${revenue}"
)
OVERALL_HEAD = "Overall cancellation rate by region across all brands (ranked highest to lowest): {lines}"
OVERALL_LINE = (
    "{region}: avg cancellation rate {cancellation}%, avg occupancy {occupancy}%, "
    "total revenue ${revenue}"
)
LINE_SEPARATOR = " | "


def occupancy_quarterly(occupancy: DataFrame) -> DataFrame:
    return occupancy.groupBy("brand", "region", "itinerary_name", "sail_year", "sail_quarter").agg(
        F.sum("total_bookings").alias("total_bookings"),
        F.sum("confirmed_bookings").alias("confirmed_bookings"),
        F.sum("cancelled_bookings").alias("cancelled_bookings"),
        F.round(exact_mean(F.col("occupancy_rate_pct"), 2), 2).alias("avg_occupancy_pct"),
        F.round(exact_mean(F.col("cancellation_rate_pct"), 2), 2).alias("avg_cancellation_pct"),
        F.round(exact_mean(F.col("avg_booking_window_days"), 10), 0).alias("avg_booking_window"),
        F.sum("total_revenue_usd").alias("total_revenue"),
    )


def revenue_quarterly(revenue: DataFrame) -> DataFrame:
    return (
        revenue.where(~F.col("is_cancelled"))
        .groupBy(
            "brand",
            "region",
            "cabin_category",
            F.year("sail_date").alias("sail_year"),
            F.quarter("sail_date").alias("sail_quarter"),
        )
        .agg(
            F.count("*").alias("total_bookings"),
            F.round(exact_mean(F.col("cabin_price_usd")), 2).alias("avg_cabin_price"),
            F.round(exact_mean(F.col("total_revenue_usd")), 2).alias("avg_revenue"),
            F.round(exact_mean(F.col("total_onboard_spend_usd")), 2).alias("avg_onboard_spend"),
            F.round(exact_mean(F.col("total_guest_value_usd")), 2).alias("avg_guest_value"),
            F.round(exact_mean(F.col("revenue_per_night_usd"), 6), 2).alias("avg_rev_per_night"),
        )
    )


def pricing_quarterly(pricing: DataFrame) -> DataFrame:
    return (
        pricing.where(
            F.col("avg_booked_price_usd").isNotNull() & F.col("price_variance_pct").isNotNull()
        )
        .groupBy(
            "brand",
            "region",
            "cabin_category",
            "price_position",
            F.year("sail_date").alias("sail_year"),
            F.quarter("sail_date").alias("sail_quarter"),
        )
        .agg(
            F.count("*").alias("records"),
            F.round(exact_mean(F.col("listed_price_usd")), 2).alias("avg_listed_price"),
            F.round(exact_mean(F.col("avg_booked_price_usd"), 6), 2).alias("avg_booked_price"),
            F.round(exact_mean(F.col("price_variance_pct"), 2), 2).alias("avg_price_variance_pct"),
        )
    )


def region_brand_scorecard(occupancy: DataFrame) -> DataFrame:
    return occupancy.groupBy("region", "brand").agg(
        F.round(exact_mean(F.col("occupancy_rate_pct"), 2), 2).alias("avg_occupancy_pct"),
        F.round(exact_mean(F.col("cancellation_rate_pct"), 2), 2).alias("avg_cancellation_pct"),
        F.sum("total_revenue_usd").alias("total_revenue"),
        F.sum("total_bookings").alias("total_bookings"),
        F.round(exact_mean(F.col("avg_booking_window_days"), 10), 0).alias("avg_booking_window"),
    )


def region_scorecard(scorecard: DataFrame) -> DataFrame:
    """Unweighted mean of the brands' rounded rates per region."""
    return scorecard.groupBy("region").agg(
        F.round(exact_mean(F.col("avg_cancellation_pct"), 2), 2).alias("avg_cancellation"),
        F.round(exact_mean(F.col("avg_occupancy_pct"), 2), 2).alias("avg_occupancy"),
        F.sum("total_revenue").alias("total_revenue"),
    )


def ordered_lines(rank: Column, tie: Column, line: Column) -> Column:
    """Aggregate: lines joined by falling rank, then tie. For small, already grouped input."""
    entries = F.sort_array(F.collect_list(F.struct((-rank).alias("r"), tie.alias("t"), line.alias("l"))))
    return F.array_join(F.transform(entries, lambda e: e["l"]), LINE_SEPARATOR)


def _document(kind: str, text: Column, **fields: Column) -> list[Column]:
    """Text and typed metadata; fields a document kind lacks are NULL."""
    kinds = {
        "brand": "string",
        "region": "string",
        "itinerary": "string",
        "cabin": "string",
        "position": "string",
        "year": "int",
        "quarter": "int",
    }
    return [
        F.lit(kind).alias("type"),
        *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()],
        text.alias("text"),
    ]


def docs_occupancy(quarterly: DataFrame) -> DataFrame:
    c = F.col
    text = render(
        OCCUPANCY_TEXT,
        brand=c("brand"),
        itinerary=c("itinerary_name"),
        region=c("region"),
        quarter=c("sail_quarter"),
        year=c("sail_year"),
        bookings=whole(c("total_bookings")),
        confirmed=whole(c("confirmed_bookings")),
        cancelled=whole(c("cancelled_bookings")),
        occupancy=two_decimals(c("avg_occupancy_pct")),
        cancellation=two_decimals(c("avg_cancellation_pct")),
        window=whole(c("avg_booking_window")),
        revenue=thousands(c("total_revenue")),
    )
    return quarterly.select(
        *_document(
            "occupancy",
            text,
            brand=c("brand"),
            region=c("region"),
            itinerary=c("itinerary_name"),
            year=c("sail_year"),
            quarter=c("sail_quarter"),
        )
    )


def docs_revenue(quarterly: DataFrame) -> DataFrame:
    c = F.col
    text = render(
        REVENUE_TEXT,
        brand=c("brand"),
        cabin=c("cabin_category"),
        region=c("region"),
        quarter=c("sail_quarter"),
        year=c("sail_year"),
        price=thousands(c("avg_cabin_price")),
        revenue=thousands(c("avg_revenue")),
        onboard=thousands(c("avg_onboard_spend")),
        value=thousands(c("avg_guest_value")),
        per_night=thousands(c("avg_rev_per_night")),
        bookings=whole(c("total_bookings")),
    )
    return quarterly.select(
        *_document(
            "revenue",
            text,
            brand=c("brand"),
            region=c("region"),
            cabin=c("cabin_category"),
            year=c("sail_year"),
            quarter=c("sail_quarter"),
        )
    )


def docs_pricing(quarterly: DataFrame) -> DataFrame:
    c = F.col
    text = render(
        PRICING_TEXT,
        brand=c("brand"),
        cabin=c("cabin_category"),
        region=c("region"),
        quarter=c("sail_quarter"),
        year=c("sail_year"),
        position=c("price_position"),
        listed=thousands(c("avg_listed_price")),
        booked=thousands(c("avg_booked_price")),
        variance=two_decimals(c("avg_price_variance_pct")),
    )
    return quarterly.select(
        *_document(
            "pricing",
            text,
            brand=c("brand"),
            region=c("region"),
            cabin=c("cabin_category"),
            position=c("price_position"),
            year=c("sail_year"),
            quarter=c("sail_quarter"),
        )
    )


def docs_aggregate(scorecard: DataFrame) -> DataFrame:
    """One ranked comparison per brand and one over all brands.

    The lists hold one entry per region of a scorecard that is already aggregated, never
    raw rows.
    """
    c = F.col
    brand_line = render(
        BRAND_LINE,
        region=c("region"),
        cancellation=two_decimals(c("avg_cancellation_pct")),
        occupancy=two_decimals(c("avg_occupancy_pct")),
        window=whole(c("avg_booking_window")),
        revenue=thousands(c("total_revenue")),
    )
    per_brand = scorecard.groupBy("brand").agg(
        ordered_lines(c("avg_cancellation_pct"), c("region"), brand_line).alias("lines")
    )
    overall_line = render(
        OVERALL_LINE,
        region=c("region"),
        cancellation=two_decimals(c("avg_cancellation")),
        occupancy=two_decimals(c("avg_occupancy")),
        revenue=thousands(c("total_revenue")),
    )
    overall = region_scorecard(scorecard).agg(
        ordered_lines(c("avg_cancellation"), c("region"), overall_line).alias("lines")
    )
    return per_brand.select(
        *_document(
            "aggregate", render(BRAND_HEAD, brand=c("brand"), lines=c("lines")), brand=c("brand")
        )
    ).unionByName(
        overall.select(
            *_document("aggregate", render(OVERALL_HEAD, lines=c("lines")), brand=F.lit("all"))
        )
    )


def all_documents(occupancy: DataFrame, revenue: DataFrame, pricing: DataFrame) -> DataFrame:
    """Every document with its global id ``doc_<n>``, n counting from 0 in document order:
    occupancy, revenue, pricing, then the comparisons with the overall one last."""
    parts = [
        docs_occupancy(occupancy_quarterly(occupancy)),
        docs_revenue(revenue_quarterly(revenue)),
        docs_pricing(pricing_quarterly(pricing)),
        docs_aggregate(region_brand_scorecard(occupancy)),
    ]
    ranked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    # numbering reads the documents several times, the marts behind them only once
    docs = stored(reduce(DataFrame.unionByName, ranked)).withColumns(
        {
            "_last": ((F.col("type") == "aggregate") & (F.col("brand") == "all")).cast("int"),
            "_tail": F.coalesce("itinerary", "position", F.lit("")),
        }
    )
    numbered = sequential_ids(
        docs,
        [["_part", "_last", "brand", "region"], ["cabin"], ["year", "quarter", "_tail"]],
        "_n",
    )
    return numbered.select(
        F.concat(F.lit("doc_"), F.col("_n").cast("string")).alias("doc_id"),
        *[c for c in parts[0].columns],
    )
