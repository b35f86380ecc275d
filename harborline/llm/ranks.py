"""Order over large integer keys without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.sources.durable import stored

STEP_BITS = 16  # a window sees the values that differ in their last 16 bits


def successors(values: DataFrame, column: str) -> DataFrame:
    """``(value, next)`` for the distinct non-null integers; after the last comes the first.

    Values that share all but their last 16 bits are ordered together. The first value of
    every such group is the successor of the last one of the group before, which the same
    step finds one level up, four levels in all.
    """
    here = stored(values.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct())
    smallest = here.agg(F.min("value")).first()[0]
    if smallest is None:
        return here.withColumn("next", F.col("value"))
    levels = [here.select("value", F.shiftright("value", STEP_BITS).alias("group"))]
    while len(levels) < 64 // STEP_BITS:
        below = levels[-1].groupBy("group").agg(F.min("value").alias("value"))
        top = len(levels) == 64 // STEP_BITS - 1  # the last level orders at most 2^16 groups at once
        group = F.lit(0) if top else F.shiftright("group", STEP_BITS)
        levels.append(below.select("value", group.alias("group"), F.col("group").alias("of")))
    following = None
    for level in reversed(levels):
        inside = Window.partitionBy("group").orderBy("value")
        level = level.withColumn("next", F.lead("value").over(inside))
        if following is not None:
            level = level.join(following, "group", "left").withColumn("next", F.coalesce("next", "after"))
        following = None if "of" not in level.columns else level.select(
            F.col("of").alias("group"), F.col("next").alias("after")
        )
    return level.select("value", F.coalesce("next", F.lit(smallest)).alias("next"))


def numbered(rows: DataFrame, group: list[str], order: list[str], buckets: int, name: str) -> DataFrame:
    """Adds a number from 0, without gaps, to the rows of every group.

    The groups' rows are spread over hash buckets, so a group with a third of all rows is
    numbered in many tasks: buckets are counted first and their counts summed up, and rows
    are ordered inside their bucket only. ``rows`` is read twice and should be stored.
    """
    spread = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    key = [*group, "_bucket"]
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy(*key).agg(F.count("*").alias("_n"))
    offsets = counts.select(*key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key).orderBy(*order)
    return (
        spread.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets, key)
        .withColumn(name, (F.col("_before") + F.col("_at")).cast("long"))
        .drop("_bucket", "_before", "_at")
    )


def buckets_for(n: int) -> int:
    """So many that even a group of all rows has some 4,096 of them in a bucket."""
    return max(1, -(-n // 4096))
