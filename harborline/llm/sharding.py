"""Sharding by vector bin packing: bytes, tokens and rows are balanced together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.ranks import buckets_for, numbered
from harborline.llm.text import n_words
from harborline.sources.durable import stored

BUNDLES = 16_384  # small groups are placed in bundles, a fixed number of them
ROW_BYTES = 16
HEAVY = 512  # a group above 1/512 of a shard is placed by itself; there are at most 512 per shard
PARTS = 8  # a group above a whole shard is dealt out in parts of an eighth of a shard


def _place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every item; one row of bytes, tokens and rows each.

    Items come in falling order of their largest share. Each goes to the shard where the dot
    product of its shares and the shard's residual capacity is highest, among the shards
    that it does not overfill; if it overfills all, to the one with most bytes left.
    """
    total = items.sum(axis=0)
    shares = items / np.where(total > 0, total, 1) * shards
    left = np.ones((shards, items.shape[1]))
    placed = np.zeros(len(items), np.int32)
    for i in np.lexsort((np.arange(len(items)), -shares.max(axis=1))):
        fits = left[:, 0] >= shares[i, 0]
        score = np.where(fits, left @ shares[i], -np.inf)
        best = int(score.argmax()) if fits.any() else int(left[:, 0].argmax())
        left[best] -= shares[i]
        placed[i] = best
    return placed


def shard(
    docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    The law is ``bytes``: the shards' sizes are near equal. Documents with equal texts are
    a group and share a shard. Only a group larger than a whole shard's share fits none and
    is dealt out in parts of an eighth of a shard. Groups below a 512th of a shard are
    bundled by their texts' digest into 16,384 bundles; bundles, groups and parts are placed
    one after another. So what the driver holds, three sums per item, is bounded by
    parameters: the bundles and some 520 groups and parts per shard. ``slot`` numbers the
    rows of a shard from 0 in order of a hash, digest and id.

    Null texts are a group of their own of size 16, apart from empty ones. A null id is a
    value like others. An empty table gives no rows. Further columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            n_words(body).alias("tokens"),
            F.coalesce(F.md5(F.encode(F.col(text), "UTF-8")), F.lit("null")).alias("digest"),
        )
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = max(total / shards, 1.0)
    parts = F.when(F.col("size") > share, F.ceil(F.col("size") * PARTS / share)).otherwise(F.lit(1))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    heavy = stored(
        rows.groupBy("digest")
        .agg(*sums)
        .where(F.col("size") > share / HEAVY)
        .select("digest", parts.cast("long").alias("parts"))
    )
    # a group of several parts is dealt out by the hash of its rows' ids
    dealt = rows.join(heavy, "digest", "left").withColumn(
        "item",
        F.when(
            F.col("parts").isNotNull(),
            F.concat_ws("-", "digest", F.pmod(F.xxhash64("doc_id", "digest"), F.col("parts"))),
        ).otherwise(F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("string")),
    )
    dealt = stored(dealt.drop("parts", "tokens").join(_shards(dealt, sums, shards), "item"))
    slots = numbered(dealt, ["shard"], ["digest", "doc_id"], buckets_for(rows.count()), "slot")
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _shards(dealt: DataFrame, sums, shards: int) -> DataFrame:
    """``(item, shard)``: the bounded list of items is placed on the driver and stored."""
    items = dealt.groupBy("item").agg(*sums).orderBy("item").toPandas()
    vectors = items[["size", "tokens", "n"]].to_numpy(float)
    placed = pd.DataFrame({"item": items["item"], "shard": _place(vectors, shards)})
    spark = dealt.sparkSession
    if placed.empty:
        return spark.createDataFrame([], "item string, shard int")
    return stored(spark.createDataFrame(placed, "item string, shard int"))
