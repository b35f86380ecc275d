"""Marts kept as tables of counts and sums, to which every delivery of bookings is added."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.config import CRUISE, DomainConfig
from harborline.plans import marts
from harborline.sources.versions import has_batch, read_version, write_version

FOLDS = {"first_date": F.min, "last_date": F.max}  # all other measures add up


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of either state, its measures folded; types stay those of ``old``."""
    folded = [
        FOLDS.get(f.name, F.sum)(f.name).cast(f.dataType).alias(f.name)
        for f in old.schema.fields
        if f.name not in keys
    ]
    return old.unionByName(new).groupBy(*keys).agg(*folded)


def add_state(new: DataFrame, path: str, keys: list[str], batch: int) -> bool:
    """Folds a delivery's state into the table at ``path``; a repeated batch changes nothing."""
    spark = new.sparkSession
    if has_batch(spark, path, batch):
        return False
    old = read_version(spark, path)
    return write_version(new if old is None else merged(old, new, keys), path, batch)


@dataclass(frozen=True)
class MartStates:
    """States of the marts in one folder.

    A delivery holds new bookings, each of them once, together with all their spend; spend of
    other bookings is passed over. Its rows are read once per mart, the marts' states hold
    one row per group, and only those are shuffled with what was there. Deliveries are
    numbered upwards. One that failed on the way is given again with its number: the states
    that have it skip it.
    """

    spark: SparkSession
    folder: str
    config: DomainConfig = CRUISE

    def add(self, bookings: DataFrame, spend: DataFrame, batch: int) -> None:
        add_state(marts.occupancy_state(bookings), self._path("occupancy"), marts.OCCUPANCY_KEYS, batch)
        add_state(marts.ltv_state(bookings, spend), self._path("guest_ltv"), marts.LTV_KEYS, batch)
        add_state(marts.booked_state(bookings), self._path("booked_prices"), marts.PRICE_KEYS, batch)

    def occupancy(self) -> DataFrame:
        return marts.occupancy_of(self._state("occupancy"))

    def guest_ltv(self, guests: DataFrame) -> DataFrame:
        return marts.ltv_of(self._state("guest_ltv"), guests, self.config)

    def pricing_summary(self, pricing: DataFrame) -> DataFrame:
        """``pricing`` is read twice, so it should be a stored table."""
        return marts.pricing_of(
            pricing, marts.booked_of(self._state("booked_prices")), self.config.price_band
        )

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _state(self, name: str) -> DataFrame:
        state = read_version(self.spark, self._path(name))
        if state is None:
            raise FileNotFoundError(f"no delivery yet under {self._path(name)}")
        return state
