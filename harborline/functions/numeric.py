"""Money, rates and means whose results do not depend on row order or partitioning."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.schemas import MONEY


def money(value: Column) -> Column:
    return value.cast(MONEY)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast(MONEY))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; NULL when the denominator is zero or NULL."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """part / whole as a percentage with two decimals."""
    return F.round(safe_ratio(part.cast("double") * 100.0, whole), 2)


def exact_mean(value: Column, scale: int | None = None) -> Column:
    """Aggregate mean over a decimal sum, so that any partitioning gives the same bits.

    Doubles are first fixed to ``scale`` decimals; decimals and integers need no scale.
    """
    term = value if scale is None else value.cast(T.DecimalType(28, scale))
    return F.sum(term).cast("double") / F.nullif(F.count(value), F.lit(0))


def row_total(columns: list[Column]) -> Column:
    """Sum across columns of one row, with two decimals."""
    return F.round(reduce(add, columns), 2)


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Report shape: decimals stay exact inside the plans and leave as doubles."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
