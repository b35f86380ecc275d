"""Top-k cosine retrieval over vectors: exact, and approximate by random hyperplanes.

The corpus side is always partitioned; up to ``QUERY_BLOCK`` queries travel to it, more are
partitioned themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.operators.ranking import top_k
from harborline.sources.durable import stored

QUERY_BLOCK = 1024
MOST_TABLES = 256
DEFAULT_K = 6
GRID_QUERIES, GRID_ROWS = 16_384, 65_536  # queries and corpus rows that meet in one task
CELL_QUERIES, CELL_ROWS = 512, 8_192  # of which so many are multiplied at once


class _Best:
    """The k best documents of every query seen by one task, emitted once at its end."""

    def __init__(self, query_ids: list, k: int):
        self.query_ids, self.k = query_ids, k
        self.rows: list[list[tuple]] = [[] for _ in query_ids]

    def add(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Offers the scores that are not NaN; ties go to the smaller id."""
        kept = np.flatnonzero(~np.isnan(scores))
        if len(kept) > self.k:
            floor = np.partition(scores[kept], len(kept) - self.k)[len(kept) - self.k]
            kept = kept[scores[kept] >= floor]
        found = self.rows[j] + [(-scores[i], ids[i]) for i in kept]
        self.rows[j] = sorted(found)[: self.k]

    def frames(self) -> Iterator[pd.DataFrame]:
        flat = [(q, d, -s) for q, rows in zip(self.query_ids, self.rows) for s, d in rows]
        if flat:
            yield pd.DataFrame(flat, columns=["query_id", "doc_id", "similarity"])


def _result_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("doc_id", corpus.schema["doc_id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _six_decimals(values: np.ndarray) -> np.ndarray:
    return np.floor(values * 1e6 + 0.5) / 1e6


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = [F.col("similarity").desc(), F.col("doc_id").asc()]
    return top_k(scored, ["query_id"], order, k).select("query_id", "rank", "doc_id", "similarity")


def _unit(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _score_block(corpus: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """Best k of every task per query: similarities are never all emitted."""
    rows = block.where(F.col("embedding").isNotNull()).collect()
    schema = _result_schema(block, corpus)
    if not rows:
        return corpus.sparkSession.createDataFrame([], schema)
    query_ids = [r["query_id"] for r in rows]
    unit = _unit(np.array([r["embedding"] for r in rows], dtype="float64"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(query_ids, k)
        for batch in batches:
            if len(batch):
                ids = batch["doc_id"].to_numpy()
                vectors = np.stack(batch["embedding"].to_numpy()).astype("float64")
                cosine = _six_decimals(_unit(vectors) @ unit.T)
                for j in range(len(query_ids)):
                    best.add(j, ids, cosine[:, j])
        yield from best.frames()

    source = corpus.where(F.col("embedding").isNotNull()).select("doc_id", "embedding")
    return source.mapInPandas(score, schema)


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Exact top-k by cosine, six decimals, ties by id.

    ``queries(query_id, embedding)``, ``corpus(doc_id, embedding)`` ->
    ``(query_id, rank, doc_id, similarity)``. A zero vector has no similarity and never
    appears. Up to ``QUERY_BLOCK`` queries travel to the corpus; more are met with it in a
    grid, see ``grid_topk``. Either way the corpus is read once.
    """
    queries = stored(queries.select("query_id", "embedding"))
    if queries.count() <= QUERY_BLOCK:
        return _ranked(_score_block(corpus, queries, k), k)
    return grid_topk(queries, corpus, k)


def grid_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DEFAULT_K,
    block: int = GRID_QUERIES,
    part: int = GRID_ROWS,
) -> DataFrame:
    """``cosine_topk`` for any number of queries, none of which comes to the driver.

    Queries are dealt by hash into blocks of about ``block``, corpus rows into parts of about
    ``part``; every pair of a block and a part is one group that a task scores, keeping the k
    best rows per query. So a query is sent once per part and a corpus row once per block:
    below ``block`` queries the corpus is shuffled once. A group holds one block and one part,
    whatever the sizes of the two sides.
    """
    queries = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    corpus = corpus.where("embedding IS NOT NULL").select("doc_id", "embedding")
    blocks = max(1, -(-queries.count() // block))
    parts = max(1, -(-corpus.count() // part))
    schema = _result_schema(queries, corpus)

    def dealt(rows: DataFrame, key: str, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)))
        return rows.select(key, "embedding", F.pmod(F.xxhash64(key), F.lit(own_n)).cast("int").alias(own)).select(
            "*", everywhere.alias(other)
        )

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame(columns=schema.names)
        best = _Best(asked["query_id"].tolist(), k)
        unit = _unit(np.stack(asked["embedding"].to_numpy()).astype("float64"))
        ids = held["doc_id"].to_numpy()
        for a in range(0, len(held), CELL_ROWS):
            vectors = np.stack(held["embedding"].iloc[a : a + CELL_ROWS].to_numpy()).astype("float64")
            vectors = _unit(vectors)
            for b in range(0, len(unit), CELL_QUERIES):
                cosine = _six_decimals(unit[b : b + CELL_QUERIES] @ vectors.T)
                for j, row in enumerate(cosine):
                    best.add(b + j, ids[a : a + CELL_ROWS], row)
        return next(best.frames(), pd.DataFrame(columns=schema.names))

    left = dealt(queries, "query_id", "block", blocks, "part", parts).groupBy("block", "part")
    right = dealt(corpus, "doc_id", "part", parts, "block", blocks).groupBy("block", "part")
    return _ranked(left.cogroup(right).applyInPandas(score, schema), k)


@dataclass(frozen=True)
class SignIndex:
    """Random hyperplanes and the corpus' keys: the signs of one table's planes as one number."""

    keys: DataFrame  # (table, key, doc_id)
    vectors: DataFrame  # (doc_id, embedding)
    planes: np.ndarray  # tables x bits x dimensions


def _keyed(frame: DataFrame, name: str, planes: np.ndarray) -> DataFrame:
    powers = 1 << np.arange(planes.shape[1], dtype=np.int64)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = np.stack(batch["embedding"].to_numpy()).astype("float64")
                keys = (np.einsum("tbd,nd->ntb", planes, vectors) > 0) @ powers
                yield pd.DataFrame({name: batch[name], "keys": list(keys)})

    kind = frame.schema[name].dataType.simpleString()
    signed = frame.select(name, "embedding").mapInPandas(sign, f"{name} {kind}, keys array<long>")
    return signed.select(name, F.posexplode("keys").alias("table", "key"))


def sign_tables(n: int, in_bucket: int, likely: float, missed: float) -> tuple[int, int]:
    """``(bits, tables)`` for ``n`` vectors: the bits that leave about ``in_bucket`` vectors to
    a key, or as many as let ``MOST_TABLES`` tables keep the chance of a miss."""

    def needed(bits: int) -> int:
        same = (1 - np.arccos(likely) / np.pi) ** bits
        return int(np.ceil(np.log(missed) / np.log1p(-same)))

    bits = max(1, int(np.ceil(np.log2(max(n / in_bucket, 2)))))
    while bits > 1 and needed(bits) > MOST_TABLES:
        bits -= 1
    return bits, needed(bits)


def build_sign_index(
    corpus: DataFrame, in_bucket: int = 64, likely: float = 0.6, missed: float = 0.02, seed: int = 42
) -> SignIndex:
    """Index of ``corpus(doc_id, embedding)``.

    There are as many tables as it takes to miss a vector of cosine ``likely`` with a chance
    of ``missed``, whatever the corpus' size. A table has as many planes as leave about
    ``in_bucket`` vectors to a key, so candidates are a falling share of a growing corpus,
    until more than ``MOST_TABLES`` tables would be needed; from there on the planes stay as
    many as they are and candidates are a fixed share.
    """
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    vectors = stored(corpus.where(length > 0).select("doc_id", "embedding"))
    n = max(vectors.count(), 1)
    first = vectors.select(F.size("embedding")).first()
    bits, tables = sign_tables(n, in_bucket, likely, missed)
    planes = np.random.default_rng(seed).standard_normal((tables, bits, first[0] if first else 1))
    return SignIndex(stored(_keyed(vectors, "doc_id", planes)), vectors, planes)


def lsh_candidates(queries: DataFrame, index: SignIndex) -> DataFrame:
    """``(query_id, doc_id)`` that share a key in some table; queries are the small side."""
    asked = stored(_keyed(queries.where("embedding IS NOT NULL"), "query_id", index.planes))
    return index.keys.join(asked, ["table", "key"]).select("query_id", "doc_id").distinct()


def lsh_topk(
    queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K, index: SignIndex | None = None
) -> DataFrame:
    """Approximate top-k: candidates share the signs of some hyperplanes, then exact cosine.

    No candidate is dropped for a low similarity. A query with fewer than k candidates is
    answered by the exact ``cosine_topk``, so it has k rows if the corpus has.
    """
    index = index or build_sign_index(corpus)
    found = stored(lsh_candidates(queries, index))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    scored = (
        found.join(index.vectors, "doc_id")
        .withColumn("v", F.col("embedding").cast("array<double>"))
        .join(asked, "query_id")
        .withColumn("size", F.sqrt(dot("v", "v") * dot("q", "q")))
        .where("size > 0")
        .select("query_id", "doc_id", F.round(dot("v", "q") / F.col("size"), 6).alias("similarity"))
    )
    ranked = stored(_ranked(scored, k))
    full = stored(ranked.where(F.col("rank") == k).select("query_id"))
    short = queries.join(full, "query_id", "left_anti").select("query_id", "embedding")
    exact = cosine_topk(short, index.vectors, k)
    return ranked.join(full, "query_id", "left_semi").unionByName(exact)
