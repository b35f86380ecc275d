"""Exact median without sorting or collecting all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1 << 16  # rows that the only unpartitioned window may see


def _value_at(values: DataFrame, rank: int, lo: float, hi: float, before: int) -> float:
    """The value of a rank counted from 0, among values of which ``before`` lie below ``lo``.

    The interval that holds the rank is cut into equal bins again and again; the next
    interval runs from the smallest to the largest value of the bin that holds it, until
    the two are one value. An outlier so costs one more pass and fills no bin.
    """
    all_before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while lo < hi:
        width = (hi - lo) / BINS
        inside = values.where((F.col("v") >= lo) & (F.col("v") <= hi))
        at = F.floor((F.col("v") - lo) / width) if width else F.when(F.col("v") > lo, 1).otherwise(0)
        row = (
            inside.groupBy(F.least(at.cast("long"), F.lit(BINS - 1)).alias("bin"))
            .agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .withColumn("before", before + F.coalesce(F.sum("c").over(all_before), F.lit(0)))
            .where((F.col("before") <= rank) & (F.col("before") + F.col("c") > rank))
            .first()
        )
        lo, hi, before = row["lo"], row["hi"], row["before"]
    return lo


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row ``(median)``, a double: the mean of the two middle values, NULL without values.

    Values are counted in bins, at most ``BINS`` rows per pass; three numbers per pass come
    to the driver.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    row = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).first()
    n, median = row["n"], None
    if n:
        low = _value_at(values, (n - 1) // 2, row["lo"], row["hi"], 0)
        high = low if n % 2 else _value_at(values, n // 2, row["lo"], row["hi"], 0)
        median = (low + high) / 2
    return df.sparkSession.range(1).select(F.lit(median).cast("double").alias("median"))
