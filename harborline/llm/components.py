"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.sources.durable import stored


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum: equal only if a round changed nothing."""
    low = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))
    return tuple(edges.agg(F.count("*"), F.sum(low)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node's neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u").where(F.col("v") > F.col("u"))
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where(F.col("v") != F.col("m"))
    tied = others.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(tied).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every id in the links ``(a, b)``; ``root`` is the smallest id reachable.

    Both stars take minima that are folded inside every task first. Rounds grow with the
    logarithm of the longest chain; every round is stored, so a lost executor costs no
    earlier round. No links come to the driver, only a checksum. An id that is linked to
    itself alone does not appear.
    """
    edges = stored(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = _state(edges)
    while state[0]:
        edges = stored(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
