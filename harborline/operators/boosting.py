"""Gradient-boosted trees grown from sums per bin, in numpy over blocks of binned rows.

The algorithm, its samples and its trees are those of the library's boosters. A row is held as a
byte per feature, its label, its prediction and a flag, some 30 bytes, instead of objects of
some 200; a level of a tree adds up a block in some array operations, and of two sibling nodes
only the smaller one: the other is what is left of their parent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.operators.draws import drawn, first_int
from harborline.sources.durable import shared_folder

BINS = 32
SPLIT_ROWS = 10_000  # rows, about, that the bounds of the bins are taken from, as in the library
BLOCK_ROWS = 1 << 18
CHUNK_ROWS = 1 << 15  # rows whose sums a task forms at once, so that its arrays stay in the cache
KEPT_ROUNDS = 20  # rounds until the predictions are written to the shared folder
FEW_PARTS = 64  # parts whose sums meet in the driver; those of more are added up by tasks first
NO_IMPURITY = 2.0**-52
ROUNDING = 1e-12  # of a node's mean square; gains that differ by less are equal, smaller ones are none


@dataclass(frozen=True)
class Block:
    """Rows of a part, from its row ``start`` on."""

    part: int
    start: int
    bins: np.ndarray  # feature x row, bytes
    label: np.ndarray
    prediction: np.ndarray
    taken: np.ndarray  # whether this round's sample has the row


@dataclass
class Tree:
    """Nodes numbered as in a heap: the children of n are 2n+1 and 2n+2. A leaf has feature -1."""

    feature: np.ndarray
    bin: np.ndarray  # rows up to this bin go left
    gain: np.ndarray
    stats: np.ndarray  # node x (rows, sum, sum of squares)

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1.0), np.zeros((n, 3)))

    def values(self) -> np.ndarray:
        return self.stats[:, 1] / np.maximum(self.stats[:, 0], 1)

    def routes(self, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Feature and bin of all nodes, level by level; below a leaf all rows go left."""
        levels = [slice(2**d - 1, 2 ** (d + 1) - 1) for d in range(depth)]
        last = np.where(self.feature < 0, 255, self.bin)
        return [(np.maximum(self.feature[s], 0), last[s]) for s in levels]

    def leaves(self, depth: int) -> np.ndarray:
        """The prediction of every place of the lowest level, see ``routes``."""
        found = self.values()
        for node in range(2**depth - 1):
            if self.feature[node] < 0:
                found[2 * node + 1] = found[node]  # the right child is never met
        return found[2**depth - 1 :]


def _places(bins: np.ndarray, rows: np.ndarray, routes: list) -> np.ndarray:
    """Where in its level every row of the chunk arrives after these steps."""
    place, width, flat = np.zeros(len(rows), np.int64), bins.shape[1], bins.reshape(-1)
    for feature, last in routes:
        at = flat.take((feature * width).take(place) + rows)
        place = 2 * place + (at > last.take(place))
    return place


def _residuals(label: np.ndarray, prediction: np.ndarray, classifier: bool, first: bool) -> np.ndarray:
    """What a round's tree is fitted to: the label itself, then the negative gradient of the loss."""
    if first:
        return label
    if classifier:
        return 4.0 * label / (1.0 + np.exp(2.0 * label * prediction))
    return 2.0 * (label - prediction)


def _chunks(n: int) -> Iterator[slice]:
    return (slice(a, min(n, a + CHUNK_ROWS)) for a in range(0, n, CHUNK_ROWS))


def _sums(blocks, routes: list, slot: np.ndarray, n_slots: int, classifier: bool, first: bool):
    """One array, slot x feature x bin x (rows, sum, sum of squares), of the sampled rows that
    arrive at the places with a slot."""
    total = None
    for block in blocks:
        if total is None:
            total = np.zeros((3, len(block.bins), n_slots * BINS))
        for part in _chunks(len(block.label)):
            rows = np.flatnonzero(block.taken[part]) + part.start
            own = slot.take(_places(block.bins, rows, routes))
            if len(routes):
                met = np.flatnonzero(own >= 0)
                rows, own = rows.take(met), own.take(met)
            left = _residuals(block.label.take(rows), block.prediction.take(rows), classifier, first)
            left = left.astype("float64")
            square, base = left * left, own * BINS
            for f, column in enumerate(block.bins):
                key = column.take(rows) + base
                total[0, f] += np.bincount(key, minlength=n_slots * BINS)
                total[1, f] += np.bincount(key, left, n_slots * BINS)
                total[2, f] += np.bincount(key, square, n_slots * BINS)
    if total is not None:
        yield total.reshape(3, -1, n_slots, BINS).transpose(2, 1, 3, 0)


def _level(blocks: RDD, n_parts: int, *about) -> np.ndarray:
    found = blocks.mapPartitions(lambda held: _sums(held, *about))
    return found.treeReduce(np.add) if n_parts > FEW_PARTS else reduce(np.add, found.collect())


def _impurity(stats: np.ndarray) -> np.ndarray:
    n = np.maximum(stats[..., 0], 1)
    return (stats[..., 2] - stats[..., 1] ** 2 / n) / n


def best_split(sums: np.ndarray) -> tuple[float, int, int, np.ndarray, np.ndarray] | None:
    """Gain, feature, bin and the stats of both sides, the first of the best; ``None`` where no
    split of the node, given by feature x bin x stats, gains anything."""
    running = sums.cumsum(1)
    left, whole = running[:, :-1], running[:, -1:]
    right = whole - left
    n = whole[..., 0]
    gain = _impurity(whole) - left[..., 0] / n * _impurity(left) - right[..., 0] / n * _impurity(right)
    gain = np.where((left[..., 0] < 1) | (right[..., 0] < 1), -np.inf, gain)
    noise = ROUNDING * float((whole[..., 2] / n).max())
    if not gain.max() > noise:
        return None
    f, b = np.unravel_index(np.argmax(gain >= gain.max() - noise), gain.shape)
    return float(gain[f, b]), int(f), int(b), left[f, b], right[f, b]


def grown(blocks: RDD, n_parts: int, depth: int, classifier: bool, first: bool) -> Tree:
    """One tree over the sampled rows, a pass per level. Of two children, the one with fewer rows
    is added up."""
    tree, known, nodes = Tree.empty(depth), {}, [0]  # known: sums of the nodes that have children
    for d in range(depth):
        asked = nodes if d == 0 else [min(n, n + 1, key=lambda c: tree.stats[c, 0]) for n in nodes if n % 2]
        if not asked:
            break
        slot = np.full(2**d, -1)
        slot[np.array(asked) - (2**d - 1)] = np.arange(len(asked))
        sums = dict(zip(asked, _level(blocks, n_parts, tree.routes(depth)[:d], slot, len(asked), classifier, first)))
        if d == 0:
            tree.stats[0] = sums[0][0].sum(0)
        for n in asked if d else []:  # the sibling is what is left of the parent
            rest = known[(n - 1) // 2] - sums[n]
            sums[n + 1 if n % 2 else n - 1] = np.where(rest[..., :1] > 0, rest, 0.0)
        known = {}
        for n in nodes:
            split = best_split(sums[n]) if abs(_impurity(tree.stats[n])) >= NO_IMPURITY else None
            if split:
                known[n] = sums[n]
                tree.gain[n], tree.feature[n], tree.bin[n], tree.stats[2 * n + 1], tree.stats[2 * n + 2] = split
        nodes = [c for n in known for c in (2 * n + 1, 2 * n + 2)]
    return tree


def bounds_of(counts: pd.Series, sampled: float, bins: int) -> np.ndarray:
    """Bounds between a feature's bins, from how often each of its values but 0 was sampled.

    The other rows of the ``sampled`` ones count as 0. Halfway between all values that follow each
    other, or, where these are more than the bins, between those that a stride of rows lies between.
    """
    here = counts.sum()
    if sampled - here > NO_IMPURITY * here * here:
        counts = pd.concat([counts, pd.Series({0.0: sampled - here})])
    counts = counts.sort_index()
    value, n = counts.index.to_numpy("float64"), counts.to_numpy("float64")
    if len(value) < 2:
        return np.zeros(0)
    between = (value[:-1] + value[1:]) / 2
    if len(between) <= bins - 1:
        return between
    stride, target, found, count = sampled / bins, sampled / bins, [], n[0]
    for i in range(1, len(value)):
        before, count = count, count + n[i]
        if abs(before - target) < abs(count - target):
            found.append(between[i - 1])
            target += stride
    return np.array(found)


def _bounds(parts: DataFrame, n: int, features: list[str], seed: int) -> list[np.ndarray]:
    """Bounds of the bins of all features, from some ``SPLIT_ROWS`` rows that the library would draw."""
    spark, share = parts.sparkSession, min(1.0, SPLIT_ROWS / max(n, 1))
    picked = parts._jdf.javaRDD().sample(False, share, first_int(seed))
    rows = DataFrame(spark._jsparkSession.createDataFrame(picked, parts._jdf.schema()), spark)
    held = rows.select(*features).toPandas()
    counted = [held[f][held[f] != 0].value_counts() for f in features]
    return [bounds_of(c, share * n, min(BINS, n)) for c in counted]


def _blocks(parts: DataFrame, features: list[str], bounds: list[np.ndarray], classifier: bool, seed: int, share: float) -> RDD:
    """The rows as blocks of bins, in the order of their parts."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, bins, labels, held = TaskContext.get().partitionId(), 0, [], [], 0

        def block(n: int) -> pa.RecordBatch:
            whole = np.ascontiguousarray(np.concatenate(bins, 1))
            row = {"part": [part], "start": [start], "n": [n], "bins": [whole.tobytes()], "label": [np.concatenate(labels).tobytes()]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("bins", pa.binary()), ("label", pa.binary())]))

        for b in batches:
            columns = [b.column(f).to_numpy(zero_copy_only=False) for f in [*features, "label"]]
            if not all(np.isfinite(c).all() for c in columns):
                raise ValueError("features and labels of a fit must be finite numbers")
            label = columns.pop()
            if classifier and not np.isin(label, (0, 1)).all():
                raise ValueError("labels of a classifier must be 0 or 1")
            bins.append(np.stack([np.searchsorted(t, c).astype(np.uint8) for t, c in zip(bounds, columns)]))
            labels.append((2 * label - 1).astype(np.int8) if classifier else label)
            held += len(label)
            if held >= BLOCK_ROWS:
                yield block(held)
                start, bins, labels, held = start + held, [], [], 0
        if held:
            yield block(held)

    def opened(row) -> Block:
        bins = np.frombuffer(row["bins"], np.uint8).reshape(len(features), -1)
        label = np.frombuffer(row["label"], np.int8 if classifier else np.float64)
        taken = drawn(seed + row["part"] + 1, row["start"], row["n"], share)
        return Block(row["part"], row["start"], bins, label, np.zeros(row["n"]), taken)

    schema = "part int, start long, n int, bins binary, label binary"
    return parts.mapInArrow(packed, schema).rdd.map(opened)


def _moved(block: Block, routes: list, leaves: np.ndarray, weight: float, seed: int, share: float) -> Block:
    """The block after a round: the tree's part of the predictions, and the next sample."""
    more = np.concatenate(
        [leaves.take(_places(block.bins, np.arange(s.start, s.stop), routes)) for s in _chunks(len(block.label))]
    )
    taken = drawn(seed + block.part + 1, block.start, len(block.label), share)
    return Block(block.part, block.start, block.bins, block.label, block.prediction + weight * more, taken)


def _dropped(spark: SparkSession, path: str | None) -> None:
    if path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def boosted(
    parts: DataFrame, n: int, features: list[str], classifier: bool, rounds: int, depth: int, rate: float, share: float, seed: int
) -> tuple[list[Tree], list[np.ndarray]]:
    """All trees, and the bounds of the features' bins, of ``n`` rows that lie in the parts of a fit.

    Labels of a classifier are 0 and 1. A round keeps the blocks with their new predictions, in
    memory or on the executors' disks. Every ``KEPT_ROUNDS`` rounds they go to the shared folder, so
    that a lost block is a few rounds of work, and the blocks written before go from it.
    """
    if not n:
        raise ValueError("a fit needs rows")
    spark = parts.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    jvm_rows = spark._jsparkSession.createDataFrame(parts._jdf.javaRDD(), parts._jdf.schema())
    parts = DataFrame(jvm_rows, spark)  # rows are dealt once; both passes read what was dealt
    bounds = _bounds(parts, n, features, seed)
    blocks = _blocks(parts, features, bounds, classifier, seed, share).persist(StorageLevel.MEMORY_AND_DISK)
    n_parts, trees, before, written = blocks.getNumPartitions(), [], None, None
    for m in range(rounds):
        trees.append(grown(blocks, n_parts, depth, classifier, m == 0))  # its first pass keeps the blocks
        if before:
            before.unpersist()
        if blocks.isCheckpointed():
            _dropped(spark, written)
            written = blocks.getCheckpointFile()
        if m + 1 < rounds:
            step = (trees[-1].routes(depth), trees[-1].leaves(depth), rate if m else 1.0, seed + m + 1, share)
            before, blocks = blocks, blocks.map(lambda b, step=step: _moved(b, *step)).persist(StorageLevel.MEMORY_AND_DISK)
            if (m + 1) % KEPT_ROUNDS == 0:
                blocks.checkpoint()
    blocks.unpersist()
    _dropped(spark, written)
    return trees, bounds


def _nodes(tree: Tree, number: int, bounds: list[np.ndarray]) -> list[tuple]:
    """The tree's rows in a saved model, numbered from the root, left before right.

    Two leaves of one prediction under a node become one, as the library does.
    """
    found: list[tuple] = []
    values, impurity = tree.values(), _impurity(tree.stats)

    def same(node: int) -> float | None:
        """The one prediction of all leaves below."""
        if tree.feature[node] < 0:
            return values[node]
        left, right = same(2 * node + 1), same(2 * node + 2)
        return left if left is not None and left == right else None

    def add(node: int) -> None:
        own, at, one = [float(x) for x in tree.stats[node]], len(found), same(node)
        about = (float(values[node] if one is None else one), float(impurity[node]), own, int(own[0]))
        found.append(())
        if one is not None:
            found[at] = (number, (at, *about, -1.0, -1, -1, (-1, [], -1)))
            return
        add(2 * node + 1)
        right = len(found)
        add(2 * node + 2)
        f = int(tree.feature[node])
        split = (f, [float(bounds[f][tree.bin[node]])], -1)
        found[at] = (number, (at, *about, float(tree.gain[node]), at + 1, right, split))

    add(0)
    return found


def as_model(
    spark: SparkSession, booster: Estimator, trees: list[Tree], bounds: list[np.ndarray], rate: float
) -> Model:
    """The library's model of these trees, with the booster's settings: written as it saves its
    own, and read by it. What it says about itself comes from a model of two rows."""
    path = f"{shared_folder(spark)}/harborline-model-{uuid4().hex}"
    tiny = spark.createDataFrame([(Vectors.dense([0.0] * len(bounds)), float(i)) for i in range(2)], ["features", "label"])
    small = booster.copy({booster.maxIter: 1}).fit(tiny)
    small.write().save(f"{path}/small")
    about = json.loads(spark.read.text(f"{path}/small/metadata").first()[0])
    about["numTrees"] = len(trees)
    about["paramMap"]["maxIter"] = booster.getMaxIter()
    of_tree = spark.read.parquet(f"{path}/small/treesMetadata")
    text = of_tree.first()[1]
    listed = [(i, text, rate if i else 1.0) for i in range(len(trees))]
    nodes = [row for i, t in enumerate(trees) for row in _nodes(t, i, bounds)]
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/whole/metadata")
    spark.createDataFrame(listed, of_tree.schema).write.parquet(f"{path}/whole/treesMetadata")
    kind = spark.read.parquet(f"{path}/small/data").schema
    spark.createDataFrame(nodes, kind).coalesce(1).write.parquet(f"{path}/whole/data")
    return type(small).load(f"{path}/whole")
