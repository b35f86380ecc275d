"""Category codes as literal maps in the projection: no join, no shuffle."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.ranking import in_ranges, sequential_ids
from harborline.operators.skew import salted_left_join

MAX_CATEGORIES = 1000


def code_of(value: Column, codes: dict[str, int]) -> Column:
    """Code from a small map; unknown and NULL give 0."""
    if not codes:
        return F.lit(0)
    table = F.create_map(*[F.lit(x) for x in chain(*codes.items())])
    return F.coalesce(F.try_element_at(table, value), F.lit(0))


def alphabetical_codes(df: DataFrame, column: str) -> DataFrame:
    """``(column, code)``: position of each distinct value in ascending order, from 0."""
    distinct = df.where(F.col(column).isNotNull()).select(column).distinct()
    numbered = sequential_ids(in_ranges(distinct, column), [["_range"], [column]], "code")
    return numbered.select(column, F.col("code").cast("int").alias("code"))


def with_alphabetical_code(
    df: DataFrame, column: str, name: str, spread_by: list[str], source: DataFrame | None = None
) -> DataFrame:
    """Adds the alphabetical code of ``column``; NULL gives 0.

    Up to ``MAX_CATEGORIES`` distinct values become a literal map, read once from
    ``source``; a column with more goes through a skew-safe join.
    """
    source = df if source is None else source
    found = (
        source.where(F.col(column).isNotNull())
        .select(column)
        .distinct()
        .limit(MAX_CATEGORIES + 1)
        .collect()
    )
    if len(found) <= MAX_CATEGORIES:
        ordered = sorted((r[0] for r in found), key=lambda v: v.encode("utf-8"))
        return df.withColumn(name, code_of(F.col(column), {v: i for i, v in enumerate(ordered)}))
    codes = alphabetical_codes(source, column).withColumnRenamed("code", "_code")
    joined = salted_left_join(df, codes, [column], spread_by)
    return joined.select(*[F.col(c) for c in df.columns], F.coalesce("_code", F.lit(0)).alias(name))
