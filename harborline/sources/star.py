"""Derives the four raw tables from an order / line-item star schema.

Every order becomes a booking, its customer the guest, the lines of a running order its
onboard spend, and every line one entry of the price log. All rows are used; row counts
grow with the star tables.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.config import CRUISE, DomainConfig, SeasonRule
from harborline.functions.names import padded_id
from harborline.functions.numeric import money, row_total
from harborline.operators.profile import guest_profile
from harborline.schemas import STAMP

# Names the star schema maps to.
STAR_CONFIG: DomainConfig = replace(
    CRUISE,
    brands=("Mass", "Premium", "Luxury"),
    brand_codes={"Mass": 0, "Premium": 1, "Luxury": 2},
    region_codes={"AFRICA": 0, "AMERICA": 1, "ASIA": 2, "EUROPE": 3, "MIDDLE EAST": 4},
    channel_codes={
        "1-URGENT": 0,
        "2-HIGH": 1,
        "3-MEDIUM": 2,
        "4-NOT SPECIFIED": 3,
        "5-LOW": 4,
    },
    season_rules=(
        SeasonRule("AFRICA", (12, 1, 2, 3), 1.25),
        SeasonRule("AMERICA", (6, 7, 8), 1.30),
        SeasonRule("ASIA", (7, 8), 1.35),
        SeasonRule("EUROPE", (6, 7, 8), 1.20),
    ),
    ltv_segments=(("Platinum", 5_000_000), ("Gold", 2_000_000), ("Silver", 500_000)),
)
REASONS = ("Personal", "Medical", "Price", "Weather", "Work", None)
TIERS = ("None", "Latitudes", "Gold", "Platinum", "Ambassador")
AGE_GROUPS = ("25-34", "35-44", "45-54", "55-64", "65+")
SPEND_PAIRS = {
    "dining": ("A", "F"),
    "spa": ("A", "O"),
    "excursions": ("N", "F"),
    "beverage": ("N", "O"),
    "casino": ("R", "F"),
    "retail": ("R", "O"),
}


# Columns read from the star tables; naming them saves a schema-inference job per table.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class StarSource:
    """Lazy raw tables over one folder of star-schema parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            reader = self.spark.read.schema(COLUMNS[name])
            self._tables[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def places(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            "n_nationkey", F.col("n_name").alias("itinerary_name"), F.col("r_name").alias("region")
        )

    @cached_property
    def _dated_orders(self) -> DataFrame:
        """Orders with the booking columns that need no other table."""
        key = F.col("o_orderkey")
        share = key % 20
        booked = F.col("o_orderdate").cast("date")
        sails = F.date_add(F.trunc(booked, "month"), (38 + (key * 37) % 233).cast("int"))
        return self.table("orders").select(
            "o_orderkey",
            "o_custkey",
            "o_orderpriority",
            "o_orderdate",
            "o_totalprice",
            (F.col("o_orderstatus") == "F").alias("is_cancelled"),
            F.when(share < 12, "Mass").when(share < 17, "Premium").otherwise("Luxury").alias("brand"),
            booked.alias("booking_date"),
            sails.alias("sail_date"),
        )

    @cached_property
    def _lead_cabins(self) -> DataFrame:
        """Part type of each order's first line.

        The closing group makes the key provably unique, so Catalyst drops the whole
        left join wherever the cabin is not selected.
        """
        first = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("lead"))
            .select("l_orderkey", F.col("lead.l_partkey").alias("l_partkey"))
        )
        part = self.table("part").select("p_partkey", "p_type")
        return (
            first.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.min("p_type").alias("lead_type"))
        )

    @cached_property
    def bookings(self) -> DataFrame:
        key = F.col("o_orderkey")
        window = F.date_diff("sail_date", "booking_date")
        price = money(F.col("o_totalprice"))
        guests = (1 + key % 4).cast("int")
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        return (
            self._dated_orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(self.places, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self._lead_cabins, "o_orderkey", "left")
            .select(
                padded_id("BK", key, 7).alias("booking_id"),
                padded_id("G", F.col("o_custkey"), 7).alias("guest_id"),
                "brand",
                F.concat(F.lit("Ship "), (key % 5).cast("string")).alias("ship_name"),
                "itinerary_name",
                "region",
                (5 + F.col("n_nationkey") % 10).cast("int").alias("nights"),
                F.coalesce("lead_type", F.lit("STANDARD")).alias("cabin_category"),
                guests.alias("num_guests"),
                "booking_date",
                "sail_date",
                window.alias("booking_window_days"),
                price.alias("cabin_price_usd"),
                money(price * guests).alias("total_revenue_usd"),
                F.col("o_orderpriority").alias("booking_channel"),
                "is_cancelled",
                F.when(
                    F.col("is_cancelled"),
                    F.date_sub("sail_date", (1 + key % window).cast("int")),
                ).alias("cancellation_date"),
                F.when(F.col("is_cancelled"), _pick(REASONS, key % len(REASONS))).alias(
                    "cancellation_reason"
                ),
                _pick(TIERS, key % len(TIERS)).alias("loyalty_tier"),
                F.col("o_orderdate").cast("timestamp_ntz").alias(STAMP),
            )
        )

    @cached_property
    def onboard_spend(self) -> DataFrame:
        """One row per running order with lines; one line's flags choose its category."""
        # whole cents sum exactly in a long; decimals would triple the cost per line
        cents = F.rint(F.col("l_extendedprice") * 100).cast("long")
        by_order = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(
                *[
                    F.sum(
                        F.when(
                            (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), cents
                        ).otherwise(F.lit(0))
                    ).alias(category)
                    for category, (flag, status) in SPEND_PAIRS.items()
                ]
            )
        )
        running = self._dated_orders.where(~F.col("is_cancelled"))
        usd = {c: money(F.col(c).cast("decimal(18,0)") / 100) for c in SPEND_PAIRS}
        return by_order.join(running, F.col("l_orderkey") == F.col("o_orderkey")).select(
            padded_id("BK", F.col("o_orderkey"), 7).alias("booking_id"),
            padded_id("G", F.col("o_custkey"), 7).alias("guest_id"),
            "brand",
            "sail_date",
            *[amount.alias(c) for c, amount in usd.items()],
            money(row_total(list(usd.values()))).alias("total_onboard_spend_usd"),
            F.col("o_orderdate").cast("timestamp_ntz").alias(STAMP),
        )

    @cached_property
    def line_spend(self) -> DataFrame:
        """Onboard spend with one row per line, so that bookings have several."""
        amount = money(F.col("l_extendedprice"))
        running = self._dated_orders.where(~F.col("is_cancelled"))
        categories = [
            F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), amount).alias(c)
            for c, (flag, status) in SPEND_PAIRS.items()
        ]
        return (
            self.table("lineitem")
            .join(running, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                padded_id("BK", F.col("o_orderkey"), 7).alias("booking_id"),
                padded_id("G", F.col("o_custkey"), 7).alias("guest_id"),
                "brand",
                "sail_date",
                *categories,
                amount.alias("total_onboard_spend_usd"),
                F.col("o_orderdate").cast("timestamp_ntz").alias(STAMP),
            )
        )

    @cached_property
    def pricing_log(self) -> DataFrame:
        """One listed price per order line, 80 to 120 percent of the booked price."""
        percent = 80 + (F.col("l_linenumber") * 13 + F.col("l_partkey")) % 41
        cents = F.rint(F.col("o_totalprice") * 100).cast("long")
        listed = F.floor((cents * percent + 50) / F.lit(100.0)).cast("long")
        part = self.table("part").select("p_partkey", "p_type")
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        return (
            self.table("lineitem")
            .join(self._dated_orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(self.places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.concat_ws(
                    "-",
                    padded_id("PL", F.col("l_orderkey"), 9),
                    F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string"),
                ).alias("price_log_id"),
                "brand",
                "itinerary_name",
                "region",
                F.col("p_type").alias("cabin_category"),
                "sail_date",
                money(listed / F.lit(100.0)).alias("price_usd"),
                F.col("l_shipdate").cast("timestamp_ntz").alias("recorded_at"),
                F.col("o_orderdate").cast("timestamp_ntz").alias(STAMP),
            )
        )

    @cached_property
    def guests(self) -> DataFrame:
        customer = self.table("customer")
        people = customer.join(self.places, F.col("c_nationkey") == F.col("n_nationkey")).select(
            padded_id("G", F.col("c_custkey"), 7).alias("guest_id"),
            F.substring_index("c_name", "#", 1).alias("first_name"),
            F.substring_index("c_name", "#", -1).alias("last_name"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
            F.col("itinerary_name").alias("country"),
            _pick(AGE_GROUPS, F.col("c_custkey") % len(AGE_GROUPS)).alias("age_group"),
        )
        profile = guest_profile(self.bookings)
        return people.join(profile, "guest_id").select(
            *people.columns,
            "primary_brand",
            F.col("total_bookings").cast("int").alias("total_bookings"),
            "loyalty_tier",
            F.lit("2002-01-01 00:00:00").cast("timestamp_ntz").alias(STAMP),
        )

    def as_text(self, name: str) -> DataFrame:
        """A raw table as a loader delivers it: days, stamps and flags as text."""
        df: DataFrame = getattr(self, name)
        return df.select(
            *[
                F.col(f.name).cast("string").alias(f.name)
                if f.dataType.typeName() in ("date", "timestamp_ntz", "boolean")
                else F.col(f.name)
                for f in df.schema.fields
            ]
        )
