"""Reproducible train / test split with exact sizes per stratum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.sources.durable import stored

HASH_DIGITS = 4  # every level cuts a range of hashes into 65,536
WHOLE_HASH = 32  # digits of an md5


def _level(rows: DataFrame, digits: int, nth: Column) -> DataFrame:
    """Per stratum, the range of ``digits`` digits that holds its n-th smallest hash.

    ``nth`` is that rank among the given rows. ``_nth`` of the result is the rank inside the
    range, ``_low`` and ``_high`` are its hashes. Rows are counted per range inside every
    task, so a window sees at most 65,536 ranges of a stratum.
    """
    whole = Window.partitionBy("_stratum")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_range", F.substring("_hash", 1, digits))
        .groupBy("_stratum", "_range")
        .agg(
            F.count("*").alias("_c"),
            F.min("_hash").alias("_low"),
            F.max("_hash").alias("_high"),
            *[F.first(c).alias(c) for c in rows.columns if c == "_rank"],
        )
        .withColumn("_total", F.sum("_c").over(whole))
        .withColumn("_take", nth)
        .withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .where((F.col("_before") < F.col("_take")) & (F.col("_before") + F.col("_c") >= F.col("_take")))
        .select("_stratum", "_range", (F.col("_take") - F.col("_before")).alias("_nth"), "_low", "_high")
    )


def _cuts(slim: DataFrame, test_share: float) -> DataFrame:
    """``(_cut_stratum, _cut)``: the largest hash of every stratum that belongs to the test rows."""
    level = stored(_level(slim, HASH_DIGITS, F.ceil(F.col("_total") * F.lit(test_share))))
    settled = []
    for digits in range(2 * HASH_DIGITS, WHOLE_HASH + 1, HASH_DIGITS):
        settled.append(level.where("_low = _high"))
        open_ranges = level.where("_low < _high")
        if open_ranges.isEmpty():
            break
        inside = slim.alias("s").join(
            open_ranges.select("_stratum", "_range", F.col("_nth").alias("_rank")).alias("c"),
            F.col("s._stratum").eqNullSafe(F.col("c._stratum"))
            & (F.substring("s._hash", 1, digits - HASH_DIGITS) == F.col("c._range")),
        )
        level = stored(_level(inside.select("s._stratum", "s._hash", "_rank"), digits, F.col("_rank")))
    else:
        settled.append(level)  # whole hashes, so their ranges hold one hash each
    return reduce(DataFrame.unionByName, settled).select(
        F.col("_stratum").alias("_cut_stratum"), F.col("_low").alias("_cut")
    )


def stratified_split(
    df: DataFrame,
    keys: list[str],
    stratum: Column | None = None,
    test_share: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Adds boolean ``is_test``: the first ceil(share * n) rows of each stratum by key hash.

    ``keys`` identify a row. Rows are counted per hash range; the one range per stratum that
    holds the cut is counted again in finer ranges, until it is a single hash. Two levels
    settle 4 billion rows of a stratum. The wide rows themselves are compared with a
    per-stratum cut value and never shuffled. Rows of equal keys have one hash and stay
    together, on the side of the first of them.
    """
    hashed = df.withColumns(
        {
            "_stratum": F.lit(0) if stratum is None else stratum,
            "_hash": F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))),
        }
    )
    cut = _cuts(hashed.select("_stratum", "_hash"), test_share)
    # one row per stratum; stored, so that the planner broadcasts it by its real size
    return hashed.join(
        stored(cut), F.col("_stratum").eqNullSafe(F.col("_cut_stratum")), "left"
    ).select(*df.columns, F.coalesce(F.col("_hash") <= F.col("_cut"), F.lit(False)).alias("is_test"))
