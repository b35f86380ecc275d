"""Global numbering and top-k without sorting everything in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.sources.durable import stored


def _matches(columns: list[str], prefix: str) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in columns])


def _renamed(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in columns], F.col("_offset").alias(prefix + "offset"))


def running_total(df: DataFrame, value: Column, levels: list[list[str]], name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows in ascending order of the levels.

    The levels are a prefix hierarchy (NULLs first). Sums per prefix are aggregated first
    and turned into offsets one level at a time, each window holding only the children of
    one parent; rows are added up inside their own prefix. So no window sees more than
    the rows of one full prefix, whatever the size of the input.
    """
    df = df.withColumn("_value", value)
    before = Window.unboundedPreceding, -1
    prefixes = [sum(levels[: i + 1], []) for i in range(len(levels) - 1)]
    inside = Window.partitionBy(*(prefixes[-1] if prefixes else [])).orderBy(*levels[-1])
    total = F.coalesce(F.sum("_value").over(inside.rowsBetween(*before)), F.lit(0))
    if not prefixes:
        return df.withColumn(name, total).drop("_value")
    sums = df.groupBy(*prefixes[-1]).agg(F.sum("_value").alias("_value"))
    offsets = None
    for i, prefix in enumerate(prefixes):
        parent = prefixes[i - 1] if i else []
        siblings = Window.partitionBy(*parent).orderBy(*levels[i]).rowsBetween(*before)
        here = (
            sums.groupBy(*prefix)
            .agg(F.sum("_value").alias("_value"))
            .withColumn("_offset", F.coalesce(F.sum("_value").over(siblings), F.lit(0)))
        )
        if offsets is None:
            offsets = here.select(*prefix, "_offset")
        else:
            up = _renamed(offsets, parent, "_up_")
            offsets = here.join(up, _matches(parent, "_up_")).select(
                *prefix, (F.col("_offset") + F.col("_up_offset")).alias("_offset")
            )
    last = prefixes[-1]
    joined = df.join(_renamed(offsets, last, "_at_"), _matches(last, "_at_"))
    return joined.withColumn(name, F.col("_at_offset") + total).select(
        *[c for c in df.columns if c != "_value"], name
    )


def in_ranges(df: DataFrame, column: str) -> DataFrame:
    """Adds ``_range``: the number of the range of values a row lies in, ascending.

    Ranges come from a sample of the values themselves, so they hold about the same number of
    rows however the values are distributed. The rows are stored, so that every reader sees
    the same ranges.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(ranges, column).withColumn("_range", F.spark_partition_id()))


def sequential_ids(
    df: DataFrame, levels: list[list[str]], name: str = "seq", start: int = 0
) -> DataFrame:
    """Consecutive numbers in ascending order of all level columns, see ``running_total``."""
    numbered = running_total(df, F.lit(1), levels, name)
    return numbered.withColumn(name, (F.col(name) + start).cast("long"))


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows of every key. Spark limits each key inside every task before the
    shuffle, so a key with very many rows ships at most k of them per task."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
