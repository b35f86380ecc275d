"""Approximate top-k cosine over an inverted file: cells, residual product codes, exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.operators.ranking import top_k
from harborline.operators.retrieval import DEFAULT_K, cosine_topk
from harborline.sources.durable import stored

CELLS_PER_ROOT = 8  # cells for n vectors: this many times the square root of n
CENTER_BYTES = 128 << 20  # all centers together; tasks carry them
ROWS_PER_CELL = 32  # sampled vectors by cell that the cells are fitted on
FIT_ROWS = 16_384  # sampled vectors, at most, that one fit reads in one task
REFINED = 2  # passes over the sample that move all centers at once
CODE_PARTS, CODE_WORDS = 16, 256
BLOCK_ROWS = 1024
SLICE_ROWS, SLICES = 100_000, 256  # rows of a folder of the index, and the most folders
SPARE = 0.01  # share of neighbours, beyond the recall, that the probed cells hold
TESTED = 128  # corpus vectors that the search is measured with
DISTANCES = 1 << 22  # distances that a task holds at once
GROUP_QUERIES, GROUP_ROWS = 512, 131_072  # queries and coded rows that meet in one task
SIDE_BY_SIDE = 64  # queries of neighbouring cells whose candidates are scored at once


@dataclass(frozen=True)
class Cells:
    """What tasks need to find a vector's cell: all centers, and the words of the codes."""

    centers: np.ndarray  # cell x dimension
    words: np.ndarray  # part x word x dimension of the part

    @property
    def n(self) -> int:
        return len(self.centers)

    def by_distance(self, vector: np.ndarray) -> np.ndarray:
        """All cells, the nearest first."""
        return np.argsort((self.centers * self.centers).sum(1) - 2 * (self.centers @ vector), kind="stable")

    def parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        return np.array_split(vectors, len(self.words), axis=1)

    def encode(self, vectors: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """One byte per part: the word nearest to what the cell's center leaves of the vector."""
        left = vectors - self.centers[cell]
        codes = [nearest(p, w[:, : p.shape[1]]) for p, w in zip(self.parts(left), self.words)]
        return np.stack(codes, 1).astype(np.uint8)

    def decode(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for: the cell's center and the words."""
        sizes = [p.shape[1] for p in self.parts(self.centers[:1])]
        return self.centers[cell] + np.concatenate([w[c, :d] for w, c, d in zip(self.words, codes.T, sizes)], 1)


@dataclass(frozen=True)
class CellIndex:
    cells: Cells
    blocks: DataFrame  # (slice, cell, block, ids, codes): at most some 1,024 rows of a cell each
    sizes: DataFrame  # (slice, cell, n, blocks)
    vectors: DataFrame  # (slice, cell, doc_id, embedding), all rows that have a direction
    n: int
    probes: int  # cells that a query looks into
    shortlist: int  # coded candidates whose vectors are compared
    per_slice: int = 1  # cells of a slice, which follow each other


def nearest(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of every vector, a bounded number of distances at a time."""
    lengths, rows = (centers * centers).sum(1), max(1, DISTANCES // len(centers))
    found = [
        np.argmin(lengths - 2 * (vectors[a : a + rows] @ centers.T), axis=1) for a in range(0, len(vectors), rows)
    ]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _lloyd(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """At most k centers of the points; empty ones move to the points farthest from theirs."""
    points = np.unique(points, axis=0)
    if len(points) <= k:
        return points
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(points, centers)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centers)
        for d in range(points.shape[1]):
            sums[:, d] = np.bincount(at, points[:, d], minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            away = ((points - centers[at]) ** 2).sum(1)
            centers[empty] = points[np.argsort(-away, kind="stable")[: len(empty)]]
    return centers


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def directions(corpus: DataFrame) -> DataFrame:
    """Unit vectors; rows without a direction (null, empty or zero) are left out."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    sized = corpus.select("doc_id", "embedding", size.alias("size")).where("size > 0")
    return sized.select("doc_id", F.transform("embedding", lambda x: x / F.col("size")).alias("unit"))


def _pairs(rows, key: str, value: str) -> dict[int, list]:
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r[key], []).append(r[value])
    return found


def _refined(sample: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Every center moved to the mean of the sampled vectors nearest to it."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(centers), np.zeros(len(centers), np.int64)
        for b in batches:
            if len(b):
                vectors = _matrix(b["unit"])
                at = nearest(vectors, centers)
                n += np.bincount(at, minlength=len(centers))
                for d in range(vectors.shape[1]):
                    total[:, d] += np.bincount(at, vectors[:, d], minlength=len(centers))
        met = np.flatnonzero(n)
        if len(met):  # a task may have no rows; an empty column of lists has no Arrow type
            yield pd.DataFrame({"cell": met, "n": n[met], "total": list(total[met])})

    parts = sample.select("unit").mapInPandas(sums, "cell long, n long, total array<double>")
    summed = [F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(centers.shape[1])]
    moved = centers.copy()
    for r in parts.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*summed).alias("total")).collect():
        moved[r["cell"]] = np.array(r["total"]) / r["n"]
    return moved


def fit_cells(units: DataFrame, n: int, seed: int = 42) -> Cells:
    """Cells for ``units(doc_id, unit)``, fitted on samples drawn by a hash of the id.

    Groups come from k-means over at most ``FIT_ROWS`` vectors, the cells of a group from k-means
    over its share of ``ROWS_PER_CELL`` vectors by cell, at most ``FIT_ROWS`` by group, one task
    per group; then all centers move together over the whole sample. Code words come from the
    residuals of at most ``FIT_ROWS`` vectors. These bounds concern the fit alone; every row is
    indexed. The driver receives centers only, ``CENTER_BYTES`` at most.
    """
    first = units.select(F.size("unit")).first()
    dims = first[0] if first else 1
    wanted = int(min(max(1, CELLS_PER_ROOT * n**0.5), max(1, CENTER_BYTES // (8 * dims))))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30))
    parts = min(CODE_PARTS, dims)
    width = -(-dims // parts)

    def sample(rows: int) -> DataFrame:
        return units.where(draw < int((1 << 30) * min(1.0, rows / max(n, 1))))

    few = stored(sample(FIT_ROWS))
    held = few.select(array_to_vector("unit").alias("v"))
    if held.isEmpty():
        return Cells(np.zeros((1, dims)), np.zeros((parts, CODE_WORDS, width)))
    kmeans = KMeans(k=max(1, int(wanted**0.5)), maxIter=5, seed=seed, featuresCol="v")
    groups = np.array(kmeans.fit(held).clusterCenters())

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(group=nearest(_matrix(b["unit"]), groups).astype("int32"))

    kind = units.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, unit array<double>, group int"
    whole = stored(sample(ROWS_PER_CELL * wanted).mapInPandas(grouped, schema))
    count = {r["group"]: r["n"] for r in whole.groupBy("group").agg(F.count("*").alias("n")).collect()}
    share = {g: max(1, round(wanted * c / sum(count.values()))) for g, c in count.items()}
    bounded = top_k(whole, ["group"], [F.xxhash64("doc_id", F.lit(seed + 1)), F.col("doc_id")], FIT_ROWS)

    def centers_of(rows: pd.DataFrame) -> pd.DataFrame:
        g = int(rows["group"].iloc[0])
        return pd.DataFrame({"group": g, "center": list(_lloyd(_matrix(rows["unit"]), share[g], seed))})

    fitted = bounded.groupBy("group").applyInPandas(centers_of, "group int, center array<double>").collect()
    by_group = _pairs(fitted, "group", "center")
    centers = np.array([c for g in sorted(by_group) for c in by_group[g]])
    for _ in range(REFINED):
        centers = _refined(whole, centers)
    cells = Cells(centers, np.zeros((parts, CODE_WORDS, width)))

    def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                vectors = _matrix(b["unit"])
                for m, p in enumerate(cells.parts(vectors - centers[nearest(vectors, centers)])):
                    yield pd.DataFrame({"part": m, "left": list(p)})

    def words_of(rows: pd.DataFrame) -> pd.DataFrame:
        found = _lloyd(_matrix(rows["left"]), CODE_WORDS, seed)
        return pd.DataFrame({"part": int(rows["part"].iloc[0]), "word": list(found)})

    left = few.select("unit").mapInPandas(residuals, "part int, left array<double>")
    found = left.groupBy("part").applyInPandas(words_of, "part int, word array<double>").collect()
    words = cells.words.copy()
    for m, own in _pairs(found, "part", "word").items():
        words[m, :, : len(own[0])] = own[0]
        words[m, : len(own), : len(own[0])] = own
    return Cells(centers, words)


def build_cell_index(corpus: DataFrame, k: int = DEFAULT_K, recall: float = 0.93, seed: int = 42) -> CellIndex:
    """Index of ``corpus(doc_id, embedding)`` in which a search finds about ``recall`` of the top k.

    The number of cells follows the square root of the corpus' size, as long as their centers
    fit into ``CENTER_BYTES``; so with as many probes the share of rows that a query looks at
    falls as the corpus grows. Rows are stored cell by cell in blocks of bounded size, so a cell
    with a third of all rows is many blocks. How many cells a query probes is measured, see
    ``calibrated``.
    """
    units = stored(directions(corpus))
    n = units.count()
    cells = fit_cells(units, n, seed)
    kind = units.schema["doc_id"].dataType.simpleString()
    slices = min(SLICES, cells.n, -(-n // SLICE_ROWS) or 1)
    per_slice = -(-cells.n // slices)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                vectors = _matrix(b["unit"])
                at = nearest(vectors, cells.centers)
                codes = cells.encode(vectors, at)
                yield pd.DataFrame(
                    {"doc_id": b["doc_id"], "embedding": b["unit"], "cell": at.astype("int32"), "code": [c.tobytes() for c in codes]}
                )

    schema = f"doc_id {kind}, embedding array<double>, cell int, code binary"
    slice_of = (F.col("cell") / per_slice).cast("int").alias("slice")
    # one task writes a slice or, where it is large, a part of it
    writers = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // (slices * SLICE_ROWS)))))
    coded = units.mapInPandas(placed, schema).select("*", slice_of).repartition("slice", writers)
    vectors = stored(coded, by="slice")
    counted = vectors.groupBy("slice", "cell").agg(F.count("*").alias("n"))
    sizes = stored(counted.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")))
    numbered = vectors.select("slice", "cell", "doc_id", "code").join(sizes.select("cell", "blocks"), "cell")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block")
    packed = (
        numbered.select("slice", "cell", block, F.struct("doc_id", "code").alias("row"))
        .groupBy("slice", "cell", "block")
        .agg(F.collect_list("row").alias("rows"))
        .select("slice", "cell", "block", F.col("rows.doc_id").alias("ids"), F.col("rows.code").alias("codes"))
    )
    blocks = stored(packed.repartition("slice", F.pmod("block", F.lit(8))), by="slice")
    index = CellIndex(cells, blocks, sizes, vectors.drop("code"), n, 1, 16 * k, per_slice)
    return calibrated(index, k, recall, seed)


def _asked(queries: DataFrame) -> DataFrame:
    """``(query_id, q)``: unit vectors of the queries that have a direction."""
    return directions(queries.select(F.col("query_id").alias("doc_id"), "embedding")).select(
        F.col("doc_id").alias("query_id"), F.col("unit").alias("q")
    )


def _probed(asked: DataFrame, index: CellIndex) -> DataFrame:
    """``asked`` with ``cells``, those that every query looks into; no rows without an indexed vector."""
    cells, probes = index.cells, index.probes
    kind = asked.schema["query_id"].dataType.simpleString()

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cells=[cells.by_distance(np.asarray(q))[:probes].astype("int32") for q in b["q"]])

    met = asked if index.n else asked.limit(0)  # an empty index does not know how long vectors are
    return met.mapInPandas(near, f"query_id {kind}, q array<double>, cells array<int>")


def candidate_share(queries: DataFrame, index: CellIndex) -> float:
    """Share of all pairs of a query and a row whose codes a search reads."""
    probes = _probed(_asked(queries), index).select(F.explode("cells").alias("cell"))
    read = probes.groupBy("cell").count().join(index.sizes, "cell").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    return (read or 0) / max(1, queries.count() * index.n)


def _best_coded(queries: np.ndarray, probed: list, rows: np.ndarray, cell: np.ndarray, ids: np.ndarray, most: int):
    """``(query, row, score)`` of the best rows, in cells that it probes, of every query by number.

    ``rows`` are decoded and sorted by cell. Queries are taken by their nearest cell, so that those
    scored at once share most of the cells they probe; only rows of these are scored. Equal rows
    have equal scores, the smaller id first.
    """
    held, first = np.unique(cell, return_index=True)
    ends = np.append(first[1:], len(cell))
    looks = [np.isin(held, p) for p in probed]
    order = np.argsort([p[0] for p in probed], kind="stable")
    for a in range(0, len(order), SIDE_BY_SIDE):
        some = order[a : a + SIDE_BY_SIDE]
        wanted = np.array([looks[i] for i in some])
        met = np.flatnonzero(wanted.any(0))
        if not len(met):
            continue
        at = np.concatenate([np.arange(first[c], ends[c]) for c in met])
        scores = queries[some] @ rows[at].T
        scores[~np.repeat(wanted[:, met], ends[met] - first[met], axis=1)] = -np.inf
        for i, own in zip(some, scores):
            floor = np.partition(own, len(own) - most)[len(own) - most] if len(own) > most else -np.inf
            kept = np.flatnonzero((own >= floor - 1e-9) & (own > -np.inf))
            near = np.round(own[kept], 9)
            best = np.lexsort((ids[at[kept]], -near))[:most]
            yield i, at[kept[best]], near[best]


def shortlisted(asked: DataFrame, index: CellIndex) -> DataFrame:
    """``(query_id, slice, cell, doc_id)``: the best candidates of every query by their codes.

    Only the folders of probed cells are read. Queries are dealt into groups, and the blocks of a
    slice into parts of bounded size; a group and a part meet in one task, which sends on the
    best rows of each query. So a block is sent once per group of queries, not once per query.
    """
    cells, most, per_slice = index.cells, index.shortlist, index.per_slice
    kinds = [asked.schema["query_id"].dataType.simpleString(), index.vectors.schema["doc_id"].dataType.simpleString()]
    probes = stored(_probed(asked, index))
    groups = max(1, -(-asked.count() // GROUP_QUERIES))
    of_slice = index.sizes.groupBy("slice").agg(F.ceil(F.sum("n") / GROUP_ROWS).cast("int").alias("parts"))
    slices = F.array_distinct(F.transform("cells", lambda c: (c / per_slice).cast("int")))
    in_slices = probes.withColumn("slice", F.explode(slices))
    read = [r["slice"] for r in in_slices.select("slice").distinct().collect()]  # SLICES at most
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group")
    sent = in_slices.join(F.broadcast(of_slice), "slice").select(
        "query_id", "q", "cells", "slice", group, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    dealt = F.pmod(F.xxhash64("cell", "block"), F.col("parts")).cast("int").alias("part")
    blocks = index.blocks.where(F.col("slice").isin(read)).join(F.broadcast(of_slice), "slice")
    held = blocks.select("slice", "cell", "ids", "codes", dealt, every_group)

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "slice", "cell", "doc_id", "near"]
        if asked.empty or held.empty:
            return pd.DataFrame(columns=names)
        held = held.sort_values("cell", kind="stable")
        cell = held["cell"].to_numpy().repeat([len(x) for x in held["ids"]])
        codes = np.frombuffer(b"".join(c for block in held["codes"] for c in block), np.uint8).reshape(len(cell), -1)
        ids, queries = np.concatenate([np.asarray(x) for x in held["ids"]]), _matrix(asked["q"])
        found = list(_best_coded(queries, list(asked["cells"]), cells.decode(codes, cell), cell, ids, most))
        if not found:
            return pd.DataFrame(columns=names)
        rows = np.concatenate([r for _, r, _ in found])
        query = np.repeat([i for i, _, _ in found], [len(r) for _, r, _ in found])
        return pd.DataFrame(
            {
                "query_id": asked["query_id"].to_numpy()[query],
                "slice": held["slice"].iloc[0],
                "cell": cell[rows],
                "doc_id": ids[rows],
                "near": np.concatenate([near for _, _, near in found]),
            }
        )

    schema = f"query_id {kinds[0]}, slice int, cell int, doc_id {kinds[1]}, near double"
    keys = ["slice", "part", "group"]
    found = sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(score, schema)
    return top_k(found, ["query_id"], [F.col("near").desc(), F.col("doc_id")], most).drop("near", "rank")


def search(queries: DataFrame, index: CellIndex, k: int = DEFAULT_K) -> DataFrame:
    """``(query_id, rank, doc_id, similarity)``: approximate top-k, similarities exact.

    The vectors of the shortlist are read from the folders of their cells and compared exactly,
    six decimals, ties by id. A query without a direction has no rows; one with fewer than k
    candidates has fewer rows where other cells hold more, see ``ivf_topk``.
    """
    asked = stored(_asked(queries))
    found = stored(shortlisted(asked, index))
    dot = F.aggregate(F.zip_with("embedding", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = found.join(index.vectors, ["slice", "cell", "doc_id"]).join(asked, "query_id").select(
        "query_id", "doc_id", F.round(dot, 6).alias("similarity")
    )
    best = top_k(scored, ["query_id"], [F.col("similarity").desc(), F.col("doc_id")], k)
    return best.select("query_id", "rank", "doc_id", "similarity")


def calibrated(index: CellIndex, k: int, recall: float, seed: int = 42) -> CellIndex:
    """The index with as many probes and as long a shortlist as the recall takes.

    Some ``TESTED`` corpus vectors, drawn by a hash of their ids, are compared with all rows. The
    probes are raised until the cells in reach hold the wanted share of their neighbours, other
    than themselves, and the shortlist until the search itself finds that share. At worst all
    cells are probed and all rows compared, which is exact.
    """
    if not index.n:
        return index
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 2)), F.lit(1 << 30))
    drawn = draw < int((1 << 30) * min(1.0, TESTED / index.n))
    tested = stored(index.vectors.where(drawn).select(F.col("doc_id").alias("query_id"), "embedding"))
    truth = cosine_topk(tested, index.vectors.select("doc_id", "embedding"), k + 1).where("query_id <> doc_id")
    truth = stored(truth.select("query_id", "doc_id"))
    rows, cells = truth.count(), index.cells
    if not rows:
        return replace(index, probes=cells.n, shortlist=index.n)

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for vector, held in zip(b["embedding"], b["held"]):
                place = np.empty(cells.n, np.int64)
                place[cells.by_distance(np.asarray(vector))] = np.arange(cells.n)
                yield pd.DataFrame({"place": place[np.asarray(held)]})

    where = truth.join(index.vectors.select("doc_id", "cell"), "doc_id")
    held = where.groupBy("query_id").agg(F.collect_list("cell").alias("held"))
    listed = tested.join(held, "query_id").select("embedding", "held").mapInPandas(ranks, "place long")
    places = np.sort([r["place"] for r in listed.collect()])
    covering = min(len(places) - 1, int(np.ceil((recall + SPARE) * len(places))))
    index = replace(index, probes=int(places[covering]) + 1)
    while True:
        found = search(tested, index, k + 1).join(truth, ["query_id", "doc_id"])
        if found.count() >= recall * rows or (index.probes >= cells.n and index.shortlist >= index.n):
            return index
        if index.shortlist < index.n:
            index = replace(index, shortlist=min(index.n, 2 * index.shortlist))
        else:
            index = replace(index, probes=min(cells.n, 2 * index.probes))


def ivf_topk(
    queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_K, index: CellIndex | None = None
) -> DataFrame:
    """Approximate top-k through the cells; queries left with fewer than k rows are answered
    exactly, so every query with a direction has k rows if the corpus has."""
    index = index or build_cell_index(corpus, k)
    queries = stored(queries.select("query_id", "embedding"))
    found = stored(search(queries, index, k))
    full = stored(found.where(F.col("rank") == k).select("query_id"))
    short = queries.join(full, "query_id", "left_anti")
    exact = cosine_topk(short, index.vectors.select("doc_id", "embedding"), k)
    return found.join(full, "query_id", "left_semi").unionByName(exact)
