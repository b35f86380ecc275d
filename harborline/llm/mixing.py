"""Mixing sources to target weights with hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.text import n_words, stable_hash48
from harborline.operators.ranking import sequential_ids
from harborline.sources.durable import stored

HASH_BITS = 48
LEVEL_BITS = 12  # 4,096 buckets per source and level, four levels
MOST_COPIES = 3


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def _ranked(sources: DataFrame) -> DataFrame:
    """Rank of every source by code point, null last, by prefix counts."""
    keyed = sources.select(
        "source",
        "source_size",
        F.col("source").isNull().alias("_none"),
        F.substring("source", 1, 4).alias("_head"),
        F.substring("source", 5, 8).alias("_next"),
    )
    return sequential_ids(keyed, [["_none"], ["_head"], ["_next"], ["source"]], "rank").select(
        "source", "source_size", "rank"
    )


def _water_level(sources: DataFrame) -> float:
    """The level at which ``min(cap, weight * level)`` adds up to all words.

    Each round gives the excess of the capped sources to the others by weight. Only sums
    over all sources come to the driver. The level grows from round to round and a round
    that caps no further source is the last one.
    """
    cap = F.col("source_size") * MOST_COPIES
    level = 0.0
    while True:
        capped = cap < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        above = (row["total"] - row["full"]) / row["open"] if row["open"] else level
        if above <= level:
            return level
        level = above


def targets(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``(source, source_size, rank, weight, target, copies, rest)``, one row per source.

    ``copies`` whole copies of the source and ``rest`` words of one more make the target.
    """
    sources = stored(
        _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn(
            "weight",
            F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1),
        )
    )
    level = _water_level(sources)
    cap = F.col("source_size") * MOST_COPIES
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    size = F.greatest("source_size", F.lit(1))
    copies = F.least(F.floor(F.col("target") / size), F.lit(MOST_COPIES))
    return (
        sources.withColumn("target", target)
        .withColumn("copies", copies.cast("long"))
        .withColumn("rest", F.round("target").cast("long") - F.col("copies") * F.col("source_size"))
    )


def thresholds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds to every source the ``threshold`` below which a hash gets one more copy.

    Words are summed by source and hash bucket. Only the bucket that crosses ``rest`` is
    looked at again, in finer buckets, until a bucket is one hash. That last unit is taken
    if it brings the sum nearer to ``rest``. No rows are sorted; windows see one source's
    4,096 sums.
    """
    found = sources.select(
        "source", "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before")
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        at = found.select(
            F.col("source").alias("_source"),
            F.col("bucket").alias("_parent"),
            F.col("before").alias("_before"),
            F.col("rest").alias("_rest"),
        )
        inside = sized.join(
            at,
            _same(F.col("source"), F.col("_source"))
            & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("_parent")),
        )
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.max("_before").alias("_before"), F.max("_rest").alias("rest")
        )
        found = stored(
            sums.withColumn("after", F.col("_before") + F.sum("size").over(running))
            .where(F.col("after") > F.col("rest"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "after", "size", "rest")).alias("first"))
            .select(
                "source",
                "first.bucket",
                (F.col("first.after") - F.col("first.size")).alias("before"),
                "first.rest",
                "first.size",
            )
        )
    nearer = 2 * F.col("before") + F.col("size") <= 2 * F.col("rest")
    cut = found.select(
        F.col("source").alias("_source"), (F.col("bucket") + nearer.cast("long")).alias("threshold")
    )
    joined = sources.join(cut, _same(F.col("source"), F.col("_source")), "left").drop("_source")
    return joined.withColumn("threshold", F.coalesce("threshold", F.lit(1 << HASH_BITS)))


def sized_documents(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
        stable_hash48(F.col(doc_id)).alias("hash"),
    )


def mix_plan(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Everything that decides a mix: one stored row per source."""
    return stored(thresholds(sized, targets(sized, weights)))


def copies_of(size_hash: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan's columns and ``times``, the copies the mix takes, to every row.

    The rows need ``source`` and ``hash``. The plan is stored, so the planner knows its size
    and broadcasts it only while it is small.
    """
    per_source = plan.select(
        F.col("source").alias("_source"), "source_size", "target", "copies", "threshold"
    )
    return (
        size_hash.join(per_source, _same(F.col("source"), F.col("_source")), "left")
        .withColumn(
            "times",  # a source at its cap has nothing left, but empty documents lie below its threshold
            F.least(F.col("copies") + (F.col("hash") < F.col("threshold")).cast("long"), F.lit(MOST_COPIES)),
        )
        .drop("_source", "copies", "threshold")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    Sources in order of code point, null last, weigh ``weights``, repeated. They share all
    words; no source gets more than three times its own, and what is above goes to the
    others by weight. A source's documents are taken ``floor(target / size)`` times, those
    with the lowest hashes of their id once more, so a source ends within half a document
    of its target and reruns agree.

    Null and empty texts have size 0 and take 0. Rows with equal ids have equal hashes and
    are taken alike. A null id hashes like any other value. An empty table gives no rows.
    Further columns of the input are not read.
    """
    sized = stored(sized_documents(docs, doc_id, text, source))
    return copies_of(sized, mix_plan(sized, weights)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def mixed_rows(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: every document as often as ``mix`` takes it, with all its columns.

    Texts are neither shuffled nor sorted: sizes are summed up first, then every row looks
    up its source's threshold.
    """
    plan = mix_plan(stored(sized_documents(docs, doc_id, text, source)), weights)
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(source).alias("source"),
        stable_hash48(F.col(doc_id)).alias("hash"),
    )
    taken = copies_of(rows, plan).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
