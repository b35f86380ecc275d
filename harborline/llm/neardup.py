"""Near duplicates: circulant MinHash, banding, exact Jaccard verification.

Every text becomes its set of distinct 5-word shingles, held as 64-bit hashes. One
permutation is applied to the shingles (the hash itself), a second one to the result,
circularly shifted by k for coordinate k; a coordinate is the smallest value over the set.
So two permutations give all coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.components import components
from harborline.llm.wordhash import in_small_batches, text_slices, word_hashes
from harborline.sources.durable import stored

SHINGLE = 5
BANDS, ROWS = 48, 5  # a pair at 0.75 is missed by all bands with a chance of 2 in a million
SHARE = 75  # percent of the union two sets have to share
BLOCK = 512  # members compared at once
CHUNK = 1 << 16  # shingles signed at once, so the work stays in the cache


def _mixed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permute32(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in one array, and the texts' offsets.

    Words are runs of characters other than ASCII white space, A-Z in lower case. A text of
    fewer than five words is one shingle, a text without words none.
    """
    hashes, bounds = word_hashes(texts)
    factor = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(len(hashes) - SHINGLE + 1, 0), np.uint64)
    for i in range(SHINGLE):
        rolled = rolled * factor + hashes[i : i + len(rolled)]
    rolled = _mixed64(rolled)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= SHINGLE:
            sets.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                whole = whole * factor + hashes[i]
            sets.append(_mixed64(whole))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def signatures(flat: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of consecutive non-empty sets: one row of coordinates per set."""
    first = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(_permute32(first + np.uint32(k)), starts)
    return out


def _band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for r in range(ROWS):
        keys = _mixed64(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return keys.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch):
            yield _sign(rows)


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    flat, bounds = shingle_sets(batch.column("text"))
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    keys = np.zeros((len(full), BANDS), np.int64)
    digests = np.zeros((2, len(sizes)), np.uint64)
    if len(full):
        starts = bounds[:-1][full]
        for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            digests[i, full] = np.add.reduceat(_mixed64(flat ^ np.uint64(salt)), starts)
        cuts = np.flatnonzero(np.diff(starts // CHUNK, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(full)]):
            end = bounds[full[b - 1] + 1]
            part = signatures(flat[starts[a] : end], starts[a:b] - starts[a], BANDS * ROWS)
            keys[a:b] = _band_keys(part)
    offsets = np.zeros(len(sizes) + 1, np.int32)
    offsets[1:] = np.cumsum((sizes > 0) * BANDS)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("row"),
            batch.column("doc_id").cast(pa.int64()),
            pa.array(sizes.astype(np.int64)),
            pa.array(digests[0].view(np.int64)),
            pa.array(digests[1].view(np.int64)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
        ],
        names=["row", "doc_id", "n_shingles", "digest", "digest2", "bands"],
    )


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch):
            flat, bounds = shingle_sets(rows.column("text"))
            sets = pa.ListArray.from_arrays(
                pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), sets], names=["id", "shingles"]
            )


def _cell_links(ids, sets, probe, member, label) -> list[tuple[int, int]]:
    """Links that join what the labels keep apart, among all pairs of a probe and a member.

    One sorted list of the members' shingles gives every member's intersection with a
    probe at once. Of links inside one group only those that connect it are returned.
    """
    inside = np.flatnonzero(member)
    sizes = np.array([len(s) for s in sets])
    shingles = np.concatenate([sets[i] for i in inside])
    owner = np.repeat(inside, sizes[inside])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    label = label.copy()
    links = []
    for p in np.flatnonzero(probe):
        lo = np.searchsorted(shingles, sets[p], "left")
        n = np.searchsorted(shingles, sets[p], "right") - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        near = 100 * shared >= SHARE * (sizes + sizes[p] - shared)
        for other in np.flatnonzero(near & (shared > 0) & (label != label[p])):
            if label[other] != label[p]:
                links.append((int(ids[p]), int(ids[other])))
                label[label == label[other]] = label[p]
    return links


def _compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells arrive one after the other; only the rows of the cell at hand are held."""

    def finish(cell: pd.DataFrame) -> list[tuple[int, int]]:
        sets = [np.asarray(s, np.int64) for s in cell["shingles"]]
        args = (cell[c].to_numpy() for c in ("probe", "member", "label"))
        return _cell_links(cell["id"].to_numpy(), sets, *args)

    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if frame.empty:
            continue
        cells = frame["cell"].to_numpy()
        cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        bounds = [0, *cuts]
        links = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            links += finish(frame.iloc[a:b])
        rest = frame.iloc[bounds[-1] :].copy()
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
    if rest is not None and len(rest):
        yield pd.DataFrame(finish(rest), columns=["a", "b"], dtype="int64")


def _links(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links of all cells ``(cell, id, probe, member, label)``."""
    rows = cells.join(sets, "id").select("cell", "id", "probe", "member", "label", "shingles")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInPandas(_compared, "a long, b long")


def _hash_block(value: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(value), blocks)


def _large_links(star: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of candidate groups of more than ``BLOCK`` members.

    Members are first checked against the first member of each of their buckets. What is
    then connected needs no further look among itself: only members outside the largest
    connected part are compared with all others, in cells of ``BLOCK`` by ``BLOCK``.
    """
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    sizes = F.size("sa") + F.size("sb")
    known = members.select(F.col("id").alias("a"))
    confirmed = stored(
        star.join(known, "a", "left_semi")
        .join(a, "a")
        .join(b, "b")
        .withColumn("shared", shared)
        .where(100 * F.col("shared") >= SHARE * (sizes - F.col("shared")))
        .select("a", "b")
    )
    parts = components(confirmed).withColumnRenamed("root", "part")
    placed = stored(
        members.join(parts, "id", "left").select("root", "id", F.coalesce("part", "id").alias("part"))
    )
    by_part = placed.groupBy("root", "part").agg(F.count("*").alias("n"))
    by_group = by_part.groupBy("root").agg(
        F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("n")
    )
    grid = by_group.select(
        "root",
        F.col("main.part").alias("main"),
        F.ceil(F.col("n") / BLOCK).alias("blocks"),
        F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("chunks"),
    ).where("chunks > 0")
    placed = placed.join(grid, "root")
    column = lambda side, other, name: F.xxhash64(
        "root", *([side, other] if name == "block" else [other, side])
    )
    as_member = placed.select(
        "*", _hash_block(F.col("id"), F.col("blocks")).alias("at"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("with"),
    ).select(
        column(F.col("at"), F.col("with"), "block").alias("cell"), "id",
        F.lit(False).alias("probe"), F.lit(True).alias("member"), F.col("part").alias("label"),
    )
    as_probe = placed.where("part != main").select(
        "*", _hash_block(F.col("id"), F.col("chunks")).alias("at"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"),
    ).select(
        column(F.col("at"), F.col("with"), "chunk").alias("cell"), "id",
        F.lit(True).alias("probe"), F.lit(False).alias("member"), F.col("part").alias("label"),
    )
    return confirmed.unionByName(_links(as_member.unionByName(as_probe), sets))


def _candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(star, classes)``: texts that share a band, tied to the bucket's smallest row.

    Equal sets are one class, known by its smallest row, and only that one is banded;
    ``least`` is the smallest id of its rows, null if none has one.
    """
    classes = stored(
        signed.where("n_shingles > 0")
        .groupBy("digest", "digest2")
        .agg(F.min("row").alias("id"), F.min("doc_id").alias("least"))
    )
    first = signed.join(classes.select(F.col("id").alias("row")), "row", "left_semi")
    banded = first.select(F.col("row").alias("id"), F.explode("bands").alias("key"))
    buckets = (
        banded.groupBy("key")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last")
        .select("key", F.col("first").alias("a"))
    )
    star = banded.join(buckets, "key").where("id != a").select("a", F.col("id").alias("b"))
    return stored(star.distinct()), classes


def _placed(source: DataFrame) -> DataFrame:
    """``row, doc_id, n_shingles, component_id, kept`` of stored rows ``(row, doc_id, text)``.

    ``row`` is every row's own key; ids are only looked at when the groups are known.
    """
    signed = stored(
        in_small_batches(source).mapInArrow(
            _signed, "row long, doc_id long, n_shingles long, digest long, digest2 long, bands array<long>"
        )
    )
    star, classes = _candidates(signed)
    groups = stored(components(star))
    wanted = groups.select(F.col("id").alias("row"))
    sets = stored(
        source.join(wanted, "row", "left_semi").mapInArrow(_as_sets, "id long, shingles array<long>")
    )
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    sized = stored(groups.join(sizes, "root"))
    yes = F.lit(True)
    small = sized.where(F.col("n") <= BLOCK).select(
        F.col("root").alias("cell"), "id", yes.alias("probe"), yes.alias("member"),
        F.col("id").alias("label"),
    )
    links = _links(small, sets)
    large = sized.where(F.col("n") > BLOCK).select("root", "id")
    if not large.isEmpty():
        links = links.unionByName(_large_links(star, stored(large), sets))
    roots = stored(components(links))
    tied = stored(classes.join(roots, "id", "left").withColumn("_root", F.coalesce("root", "id")).drop("root"))
    # the smallest id's class stays, the smallest digest where that id has several; nulls come last
    order = F.struct(F.col("least").isNull(), "least", "digest", "digest2")
    heads = tied.groupBy("_root").agg(F.min(F.struct(order.alias("order"), "id", "least")).alias("head"))
    placed = tied.join(heads, "_root").select(
        "digest", "digest2",
        F.col("head.least").alias("_least"),
        (F.col("id") == F.col("head.id")).alias("_stays"),
        F.col("head.id").alias("_head"),
    )
    alone = F.col("_head").isNull()  # no shingles
    of_id = F.col("_stays") & F.coalesce(F.col("doc_id") == F.col("_least"), F.lit(False))
    kept = F.when(alone, True).when(F.col("_least").isNull(), F.col("row") == F.col("_head")).otherwise(of_id)
    return signed.join(stored(placed), ["digest", "digest2"], "left").select(
        "row",
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"),
        kept.alias("kept"),
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Two documents are linked if their sets share at least 75 % of their union; the sets
    themselves are compared, in full. ``component_id`` is the smallest id reachable over
    links, ``kept`` marks the document that has it. Pairs are looked for among texts that
    share a band, and no bucket or group has a cap: candidate groups of up to ``BLOCK``
    texts are compared in one place, larger ones in cells of bounded size.

    Null and empty texts have no shingles and are linked with nothing. Rows with equal
    texts are linked. Rows of one id with equal texts are one document and stay together;
    rows of one id with other texts are judged by their own texts. A null id is nobody's
    component: the row belongs to the smallest other id of its group, else to null, and of
    a group of null ids alone one row stays. An empty table gives no rows. Further columns
    of the input are not read.
    """
    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
    )
    return _placed(stored(source)).drop("row")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that ``near_duplicates`` keeps, with all their columns.

    Rows go by keys of their own, stored with them, so a row never goes for another of its id.
    """
    key = "_row_of_neardup"
    held = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    source = held.select(
        F.col(key).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")
    )
    dropped = stored(_placed(source).where("not kept").select(F.col("row").alias(key)))
    return held.join(dropped, key, "left_anti").select(*docs.columns)
