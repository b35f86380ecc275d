import os
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from harborline.operators import boosting
from harborline.operators.draws import drawn, first_int
from harborline.sources.durable import shared_folder, stored

NAMES = ["a", "b", "c", "d"]


def _rows(spark, n, classifier):
    """Continuous, coarse, rarely other than 0 and constant inputs."""
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), rng.integers(0, 5, n).astype(float)
    c = np.where(rng.random(n) < 0.1, rng.normal(size=n) * 3, 0.0)
    y = a + b * np.where(a > 0, 1, -1) + c + rng.normal(size=n)
    label = (y > 1).astype(float) if classifier else y
    rows = [tuple(map(float, r)) for r in zip(a, b, c, np.full(n, 7.0), label)]
    made = stored(spark.createDataFrame(rows, [*NAMES, "label"]))
    return made.repartition(3, "a").sortWithinPartitions(*made.columns)


@pytest.mark.parametrize("classifier, n", [(True, 3000), (False, 3000), (False, 24000)])
def test_fit_equals_the_librarys(spark, monkeypatch, classifier, n):
    """The same trees as the library's, also over several blocks of a part and from a sample of the bounds."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 700)
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 3)
    parts = _rows(spark, n, classifier)
    kind = GBTClassifier if classifier else GBTRegressor
    booster = kind(
        featuresCol="features", labelCol="label", maxIter=8, maxDepth=4, stepSize=0.2, subsamplingRate=0.7, seed=42
    )
    found = boosting.boosted(parts, n, NAMES, classifier, 8, 4, 0.2, 0.7, 42)
    with ThreadPoolExecutor(1) as pool:  # models are fitted in threads, which have no active session
        own = pool.submit(boosting.as_model, spark, booster, *found, 0.2).result()
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(parts)
    other = booster.fit(vectors)
    assert own.getNumTrees == other.getNumTrees == 8 and own.getMaxIter() == 8
    assert own.treeWeights == other.treeWeights and own.totalNumNodes == other.totalNumNodes
    assert np.allclose(own.featureImportances.toArray(), other.featureImportances.toArray(), atol=1e-9)
    column = "rawPrediction" if classifier else "prediction"
    text = F.col(column).cast("string") if not classifier else F.col(column)
    mine = [r[0] for r in own.transform(vectors).select(text).collect()]
    theirs = [r[0] for r in other.transform(vectors).select(text).collect()]
    values = lambda held: np.array([x[1] if classifier else float(x) for x in held])
    assert len(mine) == n and np.allclose(values(mine), values(theirs), atol=1e-9)
    kept = shared_folder(spark).removeprefix("file://")
    left = [d for d, _, files in os.walk(kept) if "/rdd-" in d and files]
    assert not left  # blocks written on the way are gone


def test_draws_follow_the_stream_from_any_row():
    whole = drawn(43, 0, 5000, 0.8)
    assert 0.75 < whole.mean() < 0.85
    for start, n in ((0, 1), (1, 1), (700, 700), (4096, 904), (4999, 1)):
        assert (drawn(43, start, n, 0.8) == whole[start : start + n]).all()
    assert (drawn(44, 0, 5000, 0.8) != whole).any() and not len(drawn(43, 9, 0, 0.8))
    assert -(2**31) <= first_int(42) < 2**31


def test_a_fit_refuses_what_is_no_number(spark):
    rows = [(1.0, 1.0, 1.0, 1.0, None if i == 5 else float(i % 2)) for i in range(20)]
    parts = spark.createDataFrame(rows, [*NAMES, "label"]).coalesce(1)
    with pytest.raises(Exception, match="finite"):
        boosting.boosted(parts, 20, NAMES, False, 1, 2, 0.1, 1.0, 42)
    with pytest.raises(ValueError, match="rows"):
        boosting.boosted(parts.limit(0), 0, NAMES, False, 1, 2, 0.1, 1.0, 42)


def test_only_the_smaller_of_two_children_is_added_up(monkeypatch):
    """A round reads all rows once, and at most half of them on each further level."""
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 32, (3, 4000)).astype(np.uint8)
    label = bins[0] * 1.0 + (bins[1] > 9) * 20 + rng.normal(size=4000)
    block = boosting.Block(0, 0, bins, label, np.zeros(4000), np.ones(4000, bool))
    counted = []

    def level(blocks, n_parts, *about):
        found = next(boosting._sums(blocks, *about))
        counted.append(found[:, 0, :, 0].sum())
        return found

    monkeypatch.setattr(boosting, "_level", level)
    tree = boosting.grown([block], 1, 4, False, True)
    assert counted[0] == 4000 and len(counted) == 4 and all(n <= 2000 for n in counted[1:])
    leaves = SimpleNamespace(place=boosting._places(bins, np.arange(4000), tree.routes(4)), value=tree.leaves(4))
    for place in np.unique(leaves.place):
        assert np.isclose(leaves.value[place], label[leaves.place == place].mean())
