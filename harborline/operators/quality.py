"""Data-quality rules and their failure counts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.config import CRUISE, DomainConfig
from harborline.sources.durable import stored


@dataclass(frozen=True)
class Rule:
    model: str
    column: str
    test: str  # unique, not_null or accepted_values
    values: tuple[str, ...] = ()


def staging_rules(config: DomainConfig = CRUISE) -> list[Rule]:
    return [
        Rule("stg_bookings", "booking_id", "unique"),
        Rule("stg_bookings", "booking_id", "not_null"),
        Rule("stg_bookings", "guest_id", "not_null"),
        Rule("stg_bookings", "brand", "not_null"),
        Rule("stg_bookings", "brand", "accepted_values", config.brands),
        Rule("stg_bookings", "cabin_price_usd", "not_null"),
        Rule("stg_guests", "guest_id", "unique"),
        Rule("stg_guests", "guest_id", "not_null"),
        Rule("stg_onboard_spend", "booking_id", "not_null"),
        # guards the revenue mart against silent fan-out
        Rule("stg_onboard_spend", "booking_id", "unique"),
        Rule("stg_pricing_log", "price_log_id", "unique"),
        Rule("stg_pricing_log", "price_log_id", "not_null"),
    ]


def duplicated_values(df: DataFrame, column: str) -> DataFrame:
    """Failing rows of ``unique``: non-null values that occur more than once."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n_records"))
        .where(F.col("n_records") > 1)
    )


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unaccepted_values(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Failing values of ``accepted_values``; NULL passes, as in SQL."""
    return (
        df.where(~F.col(column).isin(*values))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n_records"))
    )


def _counted(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rules of one model that look at single rows, in one aggregate over one scan."""

    def failures(rule: Rule) -> Column:
        column = F.col(rule.column)
        if rule.test == "not_null":
            return F.count_if(column.isNull())
        return F.count_distinct(F.when(~column.isin(*rule.values), column))

    counted = df.agg(*[failures(r).alias(f"f{i}") for i, r in enumerate(rules)])
    entries = [
        F.struct(
            F.lit(r.model).alias("model"),
            F.lit(r.column).alias("column"),
            F.lit(r.test).alias("test"),
            F.col(f"f{i}").alias("failures"),
        )
        for i, r in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*entries)))


def _duplicates(df: DataFrame, rule: Rule) -> DataFrame:
    return duplicated_values(df, rule.column).agg(F.count("*").alias("failures")).select(
        F.lit(rule.model).alias("model"),
        F.lit(rule.column).alias("column"),
        F.lit(rule.test).alias("test"),
        "failures",
    )


def dq_suite(models: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """``(model, column, test, failures)`` for every rule.

    The columns that a model's rules look at are stored once, so the model is computed in
    one pass however many rules it has. One aggregate counts its null and unaccepted
    values, a group-by per unique rule its repeated ones.
    """
    parts = []
    for name, df in models.items():
        mine = [r for r in rules if r.model == name]
        if not mine:
            continue
        looked_at = stored(df.select(*dict.fromkeys(r.column for r in mine)))
        unique = [r for r in mine if r.test == "unique"]
        single = [r for r in mine if r.test != "unique"]
        if single:
            parts.append(_counted(looked_at, single))
        parts += [_duplicates(looked_at, r) for r in unique]
    return reduce(DataFrame.unionByName, parts)
