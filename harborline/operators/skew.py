"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.sources.durable import stored

ROWS_PER_SPLIT = 4_000_000  # a key with more rows is split, however small its share
# The key list holds at most as many keys as there are shuffle partitions, or this many:
# broadcasting it is always safe. The sketch tracks twenty times as many.
LISTED_KEYS = 10_000


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _listed_keys(df: DataFrame, key: Column, name: str) -> DataFrame:
    """``(name, _splits)`` for the values of ``key`` with more rows than a fair shuffle
    partition or than ``ROWS_PER_SPLIT``, whichever is less.

    One scan of the key into a mergeable sketch: no shuffle of rows, a bounded number of
    result rows. A split gets about half the rows that make a key hot. The list
    is stored: the sketch's counts may vary from run to run, and both sides of a join have
    to see the same splits, also after a lost executor.
    """
    partitions = _partitions(df.sparkSession)
    listed = max(LISTED_KEYS, partitions)
    tracked = min(20 * listed, 1_000_000)
    hot = F.least(F.col("n") / partitions, F.lit(float(ROWS_PER_SPLIT)))
    count = F.col("hit.count")
    return stored(
        df.select(key.alias(name))
        .where(F.col(name).isNotNull())
        .agg(
            F.expr(f"approx_top_k({name}, {listed}, {tracked})").alias("hits"),
            F.count("*").alias("n"),
        )
        .select(F.explode("hits").alias("hit"), "n")
        .where((count >= hot) & (count > 1))
        .select(
            F.col("hit.item").alias(name),
            F.greatest(F.ceil(2 * count / hot), F.lit(2)).cast("int").alias("_splits"),
        )
    )


def _key(on: list[str]) -> Column:
    return F.xxhash64(*on)


def hot_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """``(_key, _splits)`` by key hash. A key that is listed without being hot does no harm."""
    return _listed_keys(df, _key(on), "_key")


def _spread(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a listed key get one of its splits, others split 0."""
    split = F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*by), F.col("_splits"))
    )
    return df.withColumn("_salt", split.cast("int")).drop("_splits")


def _repeat(df: DataFrame) -> DataFrame:
    """Rows of a listed key once per split, others once."""
    splits = F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)
    return df.withColumn("_salt", F.explode(splits)).drop("_splits")


def salted_left_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread_by: list[str],
    key_source: DataFrame | None = None,
) -> DataFrame:
    """Left equi join for a left side with hot keys.

    Rows of a hot key are spread over several partitions by a hash of ``spread_by``; only
    the matching right rows are repeated, once per split. The result equals
    ``left.join(right, on, "left")``. ``key_source`` may name a cheaper relation with the
    same key distribution to look for hot keys in.
    """
    hot = F.broadcast(hot_keys(left if key_source is None else key_source, on))
    spread = _spread(left.withColumn("_key", _key(on)).join(hot, "_key", "left"), spread_by)
    repeated = _repeat(right.withColumn("_key", _key(on)).join(hot, "_key", "left"))
    return spread.drop("_key").join(repeated.drop("_key"), [*on, "_salt"], "left").drop("_salt")


def fanout_left_join(left: DataFrame, right: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    """Left equi join on one column for a right side that may hold many rows of one key.

    Hot right rows are spread, the left rows of those keys repeated per split. A hot key
    is known to occur on the right, so its unmatched repeats are dropped and no left row
    is lost: the result equals ``left.join(right, key, "left")``.
    """
    hot = F.broadcast(_listed_keys(right, F.col(key), key))
    spread = _spread(right.join(hot, key, "left"), spread_by).withColumn("_matched", F.lit(True))
    listed = left.join(hot, key, "left").withColumn("_hot", F.col("_splits").isNotNull())
    return (
        _repeat(listed)
        .join(spread, [key, "_salt"], "left")
        .where(~F.col("_hot") | F.col("_matched").isNotNull())
        .drop("_salt", "_hot", "_matched")
    )
