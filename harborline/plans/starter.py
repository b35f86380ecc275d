"""Starter models: a literal relation and a filter over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_model(spark: SparkSession) -> DataFrame:
    """Ids 1 and NULL."""
    one = spark.range(1).select(F.lit(1).alias("id"))
    return one.unionAll(spark.range(1).select(F.lit(None).cast("int").alias("id")))


def second_model(first: DataFrame) -> DataFrame:
    return first.where(F.col("id") == 1)
