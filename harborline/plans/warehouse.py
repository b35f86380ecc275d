"""Staging views and marts of one source, each built once and shared by its readers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from harborline.config import CRUISE, DomainConfig
from harborline.functions.names import schema_name
from harborline.operators.quality import dq_suite, staging_rules
from harborline.plans import marts, staging, summaries
from harborline.sources import sinks, tables
from harborline.sources.durable import stored

# columns that joins and groupings of the marts share; close to unique in their views
BUCKETED = {
    "stg_bookings": "booking_id",
    "stg_onboard_spend": "booking_id",
    "stg_guests": "guest_id",
    "ltv_state": "guest_id",
}


class RawSource(Protocol):
    """Anything that offers the four raw tables."""

    bookings: DataFrame
    guests: DataFrame
    onboard_spend: DataFrame
    pricing_log: DataFrame


@dataclass
class RawTables:
    bookings: DataFrame
    guests: DataFrame
    onboard_spend: DataFrame
    pricing_log: DataFrame


class Warehouse:
    """Lazy graph raw tables -> staging -> marts -> documents."""

    def __init__(
        self, source: RawSource, config: DomainConfig = CRUISE, spend_is_unique: bool = False
    ):
        self.source = source
        self.config = config
        self.spend_is_unique = spend_is_unique
        self._stored: set[str] = set()

    def staged(self, *names: str) -> Warehouse:
        """The same warehouse with some staging views stored, for plans that read them often."""
        other = Warehouse(self.source, self.config, self.spend_is_unique)
        for name in names:
            other.__dict__[name] = self._once(name)
            other._stored.add(name)
        return other

    def saved(self, schema: str, buckets: int, names: list[str] | None = None) -> Warehouse:
        """The same warehouse over tables of ``schema``, bucketed by the keys of its joins.

        Bookings meet their spend, and lifetime metrics their guests, without a shuffle, in
        every later session that reads the tables with ``from_saved``. ``buckets`` should
        give files of some 100 to 500 MB of the largest view.
        """
        spark = self.stg_bookings.sparkSession
        other = Warehouse(self.source, self.config, self.spend_is_unique)
        for name in names or list(BUCKETED):
            built = getattr(other, name) if name == "ltv_state" else getattr(self, name)
            sinks.save_table(built, name, schema, buckets=(buckets, BUCKETED[name]))
            other._take(spark, schema, name)
        return other

    def from_saved(self, spark: SparkSession, schema: str, names: list[str] | None = None) -> Warehouse:
        """This warehouse over the tables that ``saved`` has written."""
        other = Warehouse(self.source, self.config, self.spend_is_unique)
        for name in names or list(BUCKETED):
            other._take(spark, schema, name)
        return other

    def _take(self, spark: SparkSession, schema: str, name: str) -> None:
        self.__dict__[name] = tables.source(spark, schema_name(schema, schema), name)
        self._stored.add(name)

    def _once(self, name: str) -> DataFrame:
        """A view of this warehouse, stored at its first use here and shared from then on."""
        if name not in self._stored:
            self.__dict__[name] = stored(getattr(self, name))
            self._stored.add(name)
        return self.__dict__[name]

    @cached_property
    def stg_bookings(self) -> DataFrame:
        return staging.stage_bookings(self.source.bookings)

    @cached_property
    def stg_guests(self) -> DataFrame:
        return staging.stage_guests(self.source.guests)

    @cached_property
    def stg_onboard_spend(self) -> DataFrame:
        return staging.stage_onboard_spend(self.source.onboard_spend)

    @cached_property
    def stg_pricing_log(self) -> DataFrame:
        return staging.stage_pricing_log(self.source.pricing_log)

    @cached_property
    def mart_revenue(self) -> DataFrame:
        return marts.mart_revenue(self.stg_bookings, self.stg_onboard_spend, self.spend_is_unique)

    @cached_property
    def mart_occupancy(self) -> DataFrame:
        return marts.mart_occupancy(self.stg_bookings)

    @cached_property
    def ltv_state(self) -> DataFrame:
        return marts.ltv_state(self.stg_bookings, self.stg_onboard_spend)

    @cached_property
    def mart_guest_ltv(self) -> DataFrame:
        return marts.ltv_of(self.ltv_state, self.stg_guests, self.config)

    @cached_property
    def mart_pricing_summary(self) -> DataFrame:
        # the join looks at the log for its hot keys before it reads the rows
        return marts.mart_pricing_summary(
            self._once("stg_pricing_log"), self.stg_bookings, self.config.price_band
        )

    @cached_property
    def documents(self) -> DataFrame:
        # bookings feed three marts, and the occupancy mart three kinds of documents
        kept = self.staged("stg_bookings")
        return summaries.all_documents(
            stored(kept.mart_occupancy), kept.mart_revenue, kept.mart_pricing_summary
        )

    @cached_property
    def document_index(self) -> DataFrame:
        """The documents as retrieval reads them, stored once."""
        return stored(self.documents)

    def marts(self) -> dict[str, DataFrame]:
        return {
            "mart_revenue": self.mart_revenue,
            "mart_occupancy": self.mart_occupancy,
            "mart_guest_ltv": self.mart_guest_ltv,
            "mart_pricing_summary": self.mart_pricing_summary,
        }

    def quality(self) -> DataFrame:
        models = {
            "stg_bookings": self.stg_bookings,
            "stg_guests": self.stg_guests,
            "stg_onboard_spend": self.stg_onboard_spend,
            "stg_pricing_log": self.stg_pricing_log,
        }
        return dq_suite(models, staging_rules(self.config))
